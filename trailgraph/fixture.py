"""A road network derived from the star-schema tables by integer arithmetic, so that queries have road data to run on.

Customers are nodes of a jittered grid, orders are ways along its rows and
columns, parts are scenic features and forest roads, suppliers fuel stations
and route requests, events points to snap.  A fixed share of orders, parts and
suppliers becomes ways, features and stations, so that the network has the
density of a real one; every query reads the whole network.  The formulas are SQL texts with the placeholders {n}
(number of nodes) and {w} (width of the grid); the SQL counterparts of the
queries read the same texts, so both sides start from the same rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.scenic import KINDS

LAT = "cast(440000000 + ({id} div {w}) * 90000 + (({id} * 7919) % 1000 - 500) * 10 as int)"
LON = "cast(-1220000000 + ({id} % {w}) * 120000 + (({id} * 104729) % 1000 - 500) * 10 as int)"

NODE_TAGS = {
    "tourism": "case when osm_id % 17 = 0 then 'viewpoint' end",
    "natural": "case osm_id % 11 when 0 then 'peak' when 1 then 'saddle' when 2 then 'water' when 3 then 'glacier' when 4 then 'cliff' when 5 then 'wood' end",
    "waterway": "case osm_id % 7 when 0 then 'river' when 1 then 'stream' end",
    "amenity": "case when osm_id % 13 = 0 then 'fuel' when osm_id % 13 = 1 then '' end",
}
WAY_BASE = {
    "k": "o_orderkey",
    "c": "o_custkey",
    "len": "1 + (o_orderkey div 20) % 4",
    "st": "case when (o_orderkey div 80) % 2 = 0 then 1 else {w} end",
    "h": "(o_orderkey * 7919 + 13) % 1009",
    "g": "(o_orderkey * 104729 + 7) % 997",
}
WAY_WHERE = "o_orderkey % 20 < 3"
WAY_TAGS = {
    "highway": "case when h % 10 < 4 then 'track' when h % 10 < 6 then 'unclassified' when h % 10 = 6 then 'tertiary' when h % 10 = 7 then 'secondary' when h % 10 = 8 then 'primary' else 'path' end",
    "surface": "case g % 6 when 0 then 'asphalt' when 1 then 'gravel' when 2 then 'dirt' when 3 then 'sand' when 4 then 'cobblestone' end",
    "smoothness": "case (g div 6) % 8 when 0 then 'very_bad' when 1 then 'horrible' when 2 then 'bad' when 3 then 'good' end",
    "tracktype": "case when h % 10 < 4 then concat('grade', cast(1 + (h div 10) % 5 as string)) end",
    "ford": "case when (k * 31 + 5) % 23 = 0 then 'yes' end",
    "4wd_only": "case when (k * 17 + 3) % 11 = 0 then 'yes' end",
    "oneway": "case when (k * 13 + 1) % 19 = 0 then 'yes' end",
    "seasonal": "case when (k * 29) % 37 = 0 then 'yes' end",
    "access": "case (k * 41 + 2) % 29 when 0 then 'private' when 1 then 'no' end",
    "motor_vehicle": "case when (k * 43 + 9) % 53 = 0 then 'no' end",
    "vehicle": "case when (k * 47 + 4) % 61 = 0 then 'no' end",
    "landuse": "case when k % 60 = 0 then 'forest' end",
    "boundary": "case when k % 60 = 21 then 'protected_area' end",
    "leisure": "case when k % 60 = 42 then 'nature_reserve' end",
}
USFS_WHERE = "p_partkey % 10 = 3"
USFS = {
    "record_id": "p_partkey",
    "ROUTE_STAT": "case when p_partkey % 7 = 0 then 'CN - CONVERTED' else ' EX - EXISTING' end",
    "OPER_MAINT": "case p_partkey % 9 when 0 then '1 - BASIC CUSTODIAL CARE (CLOSED)' when 1 then '2 - HIGH CLEARANCE VEHICLES' when 2 then '3 - SUITABLE FOR PASSENGER CARS' "
    "when 3 then '4 - MODERATE DEGREE OF USER COMFORT' when 4 then '5 - HIGH DEGREE OF USER COMFORT' when 5 then 'NA - NOT APPLICABLE' when 6 then '0 - UNKNOWN' when 7 then null else '' end",
    "OPENFORUSE": "case p_partkey % 4 when 0 then 'ADMIN' when 1 then ' ADMIN ' when 2 then 'ALL' end",
    "OBJECTIVE_": "case when p_partkey % 13 = 0 then 'D - DECOMMISSION' else '3 - SUITABLE' end",
    "SURFACE_TY": "case p_partkey % 8 when 0 then 'AGG - CRUSHED AGGREGATE' when 1 then 'NAT - NATIVE MATERIAL' when 2 then 'ASPH - ASPHALT' when 3 then 'GRAV - GRAVEL' when 4 then 'BST - BITUMINOUS' when 5 then '' end",
    "NAME": "case when p_partkey % 3 = 0 then concat(' ', p_name, ' ') end",
}
REQUEST = {
    "request_id": "s_suppkey",
    "tank_range_km": "cast(case when s_suppkey % 3 = 0 then null else 30 + (s_suppkey % 4) * 20 end as float)",
    "avoid_paved": "s_nationkey % 2 = 0",
    "avoid_fords": "s_suppkey % 2 = 0",
    "prefer_scenic": "s_suppkey % 5 <> 0",
    "scenic_weight": "cast(1.0 as float)",
    "alternatives": "cast(1 + s_suppkey % 3 as int)",
    "diversity": "cast(0.35 as float)",
    "max_detour": "cast(1.6 as float)",
    "lambda": "cast(1.5 as float)",
    "fuel_buffer": "cast(0.2 as float)",
    "vehicle": "case s_nationkey % 5 when 0 then 'stock-suv' when 1 then 'high-clearance' when 2 then '4x4' when 3 then 'dirtbike' else 'bicycle' end",
}
#: Vehicles that events ask for, where they stand for requests that are not routed.
EVENT_VEHICLE = "case user_id % 5 when 0 then 'stock-suv' when 1 then 'high-clearance' when 2 then '4x4' when 3 then 'dirtbike' else 'bicycle' end"


def request_places(key: str = "s_suppkey") -> dict[str, str]:
    """Both ends of a request, some metres off two nodes."""
    places = {}
    for end, node in (("from", f"(({key} * 97 + 11) % {{n}})"), ("to", f"(({key} * 389 + {{n}} div 2) % {{n}})")):
        places[f"{end}_lat"] = f"({LAT.replace('{id}', node)} + 2000) / 1e7"
        places[f"{end}_lon"] = f"({LON.replace('{id}', node)} - 1500) / 1e7"
    return places


def usfs_places() -> dict[str, str]:
    """Coordinates of three vertices near three neighbouring nodes."""
    places, start = {}, "((p_partkey * 53) % {n})"
    for i in range(3):
        node = f"least({start} + {i}, ({start} div {{w}}) * {{w}} + {{w}} - 1, {{n}} - 1)"
        places[f"lat{i}"] = f"({LAT.replace('{id}', node)} + ((p_partkey * {17 + i}) % 11 - 5) * 1000) / 1e7"
        places[f"lon{i}"] = f"({LON.replace('{id}', node)} + ((p_partkey * {31 + i}) % 11 - 5) * 1000) / 1e7"
    return places


def offset_point(key: str, factor: int) -> tuple[str, str]:
    node = f"(({key} * 37) % {{n}})"
    return (
        f"cast({LAT.replace('{id}', node)} + (({key} * 6151) % 2001 - 1000) * {factor} as int)",
        f"cast({LON.replace('{id}', node)} + (({key} * 3571) % 2001 - 1000) * {factor} as int)",
    )


class Network:
    """The derived tables over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.n = self.read("customer").count()
        self.w = max(1, isqrt(self.n))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, text: str) -> str:
        return text.replace("{n}", str(self.n)).replace("{w}", str(self.w))

    def _columns(self, texts: dict[str, str]) -> list[str]:
        return [f"{self._sql(text)} as `{name}`" for name, text in texts.items()]

    def _map(self, texts: dict[str, str]) -> str:
        return "map_filter(map(" + ", ".join(f"'{name}', {self._sql(text)}" for name, text in texts.items()) + "), (k, v) -> v is not null)"

    def nodes(self) -> DataFrame:
        lat, lon = (self._sql(t.replace("{id}", "c_custkey")) for t in (LAT, LON))
        return self.read("customer").selectExpr("c_custkey as osm_id", f"{lat} / 1e7 as lat", f"{lon} / 1e7 as lon")

    def tagged_nodes(self) -> DataFrame:
        return self.nodes().selectExpr("osm_id", "lat", "lon", f"{self._map(NODE_TAGS)} as tags")

    def ways(self) -> DataFrame:
        base = self.read("orders").where(WAY_WHERE).selectExpr(*self._columns(WAY_BASE))
        nodes = self._sql("filter(transform(sequence(cast(0 as bigint), len), i -> c + i * st), x -> x = c or (x < {n} and (st <> 1 or x div {w} = c div {w})))")
        return base.selectExpr("k as way_id", f"{nodes} as nodes", f"{self._map(WAY_TAGS)} as tags")

    def scenic_features(self) -> DataFrame:
        lat, lon = map(self._sql, offset_point("p_partkey", 100))
        kinds = F.get(F.array(*map(F.lit, KINDS)), F.expr("(osm_id div 25) % 11").cast("int"))
        return self.read("part").where("p_partkey % 25 = 0").selectExpr("p_partkey as osm_id", f"{lat} as lat_e7", f"{lon} as lon_e7").withColumn("kind", kinds)

    def fuel_stations(self) -> DataFrame:
        lat, lon = map(self._sql, offset_point("s_suppkey", 60))
        return self.read("supplier").where("s_suppkey % 5 = 0").selectExpr("s_suppkey as osm_id", f"{lat} as lat_e7", f"{lon} as lon_e7")

    def usfs_records(self) -> DataFrame:
        """Roads of one or two parts; every third has a part of a single point."""
        rows = self.read("part").where(USFS_WHERE).selectExpr(*self._columns(USFS), *self._columns(usfs_places()))
        point = lambda i: f"named_struct('lon', lon{i}, 'lat', lat{i})"
        middle = "named_struct('lon', (lon0 + lon1) / 2, 'lat', (lat0 + lat1) / 2)"
        first, second = f"array({point(0)}, {middle}, {point(1)})", f"array({point(1)}, {point(2)})"
        parts = f"case record_id % 3 when 0 then array({first}, {second}) when 1 then array({first}) else array({second}, array({point(2)})) end"
        return rows.selectExpr(*(f"`{c}`" for c in USFS), f"{parts} as parts")

    def requests(self) -> DataFrame:
        """A request for each supplier."""
        return self.read("supplier").selectExpr(*self._columns(REQUEST), *self._columns(request_places()))

    def event_ends(self) -> DataFrame:
        """Two points for each event: event_id, side, lat, lon."""
        placed = self.read("events").selectExpr("event_id", *self._columns(request_places("event_id")))
        ends = F.array(*(F.struct(F.lit(e).alias("side"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for e in ("from", "to")))
        return placed.select("event_id", F.explode(ends).alias("p")).select("event_id", "p.*")
