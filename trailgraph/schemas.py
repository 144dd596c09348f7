"""Schemas of the tables that operators exchange, as DDL strings, and the bits of edge flags."""

from __future__ import annotations

WAYS = "way_id long, nodes array<long>, tags map<string,string>"
NODES = "osm_id long, lat double, lon double"
POINT = "struct<lat_e7:int,lon_e7:int>"
SCENIC_FEATURES = "osm_id long, lat_e7 int, lon_e7 int, kind string"
FUEL_STATIONS = "osm_id long, lat_e7 int, lon_e7 int"
GRAPH_NODES = "node_id long, lat_e7 int, lon_e7 int"
GRAPH_EDGES = f"edge_id long, src long, dst long, cost float, length_m float, flags int, scenic_score int, polyline array<{POINT}>"
USFS_RECORDS = (
    "record_id long, ROUTE_STAT string, OPER_MAINT string, OPENFORUSE string, OBJECTIVE_ string, SURFACE_TY string, NAME string, "
    "parts array<array<struct<lon:double,lat:double>>>"
)
REQUESTS = (
    "request_id long, from_lat double, from_lon double, to_lat double, to_lon double, tank_range_km float, avoid_paved boolean, avoid_fords boolean, "
    "prefer_scenic boolean, scenic_weight float, alternatives int, diversity float, max_detour float, lambda float, fuel_buffer float, vehicle string"
)
ROUTES = (
    "request_id long, found int, nodes array<long>, edges array<long>, length_m double, cost double, unpaved_fraction double, ford_count int, fourwd_only_count int"
)
FUEL_STOPS = "request_id long, rank int, stop_no int, at_distance_m double, lat_e7 int, lon_e7 int, osm_id long"
META = "format_version int, fingerprint string, pbf_timestamp timestamp"

# Bits of the flags column.
PAVED, FORD, FOURWD_ONLY, SEASONAL, PRIVATE, TRAIL, ROUGH, VERY_ROUGH = (1 << i for i in range(8))
