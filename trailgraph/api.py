"""What users call: build from files, answer requests, inspect a graph, print a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.storage import materialise
from .functions.tags import WayFilter, scenic_kind
from .operators import fuel, requests, routes, scenic, ways
from .operators.ways import Graph
from .plans.build import build
from .plans.profile import Profile, load_profile, report
from .sources import gpx, osm_pbf, shapefile, store

VERSION = "0.1.0"


def build_from_files(
    spark: SparkSession, pbf: str, out: str, profile: str | None = None, bbox: str | None = None, keep_private: bool = False, simplify: bool = True, usfs: str | None = None, usfs_snap_m: float = 50.0
) -> DataFrame:
    """Build a graph from an extract (and forest roads), store it at ``out`` and return its summary."""
    from .functions.geo import parse_bbox

    settings = load_profile(profile)
    box = parse_bbox(bbox) if bbox else None
    all_ways = osm_pbf.read(spark, pbf, "way")
    wanted = WayFilter(settings.allowed, keep_private=keep_private).keep(F.col("tags"))
    kind = scenic_kind(F.col("tags"), on_way=True)
    relevant = materialise(all_ways.where(wanted | kind.isNotNull()))
    points = osm_pbf.read(spark, pbf, "node")
    marked = materialise(points.where(F.size("tags") > 0).where(scenic_kind(F.col("tags"), on_way=False).isNotNull() | (F.try_element_at("tags", F.lit("amenity")) == "fuel")))
    nodes = materialise(ways.needed_coordinates(points.select("osm_id", "lat", "lon"), relevant))
    features = scenic.node_features(marked).unionByName(scenic.way_features(relevant, nodes))
    records = None
    if usfs is not None:
        records = shapefile.read(spark, usfs)
        if box is None:  # forest roads are cut to what the map covers
            found = ways.derived_bbox(nodes).first()
            box_usfs = (found["min_lon"], found["min_lat"], found["max_lon"], found["max_lat"])
            if None not in box_usfs:
                records = records.where(F.exists("parts", lambda p: F.exists(p, lambda x: x["lat"].between(box_usfs[1], box_usfs[3]) & x["lon"].between(box_usfs[0], box_usfs[2]))))
    graph = build(relevant, nodes, settings, materialise(features), ways.fuel_stations(marked), records, box, keep_private, simplify, usfs_snap_m)
    store.save(graph, out, settings.fingerprint())
    return store.inspect(spark, out)


def answer(bodies: DataFrame, graph: Graph, profile: Profile | None = None) -> DataFrame:
    """request_id, status, content_type, body for JSON request bodies (request_id, body): GPX, or a JSON error."""
    profile = profile or load_profile()
    asked = materialise(requests.decode(bodies))
    found, errors = routes.plan_routes(asked, graph, profile)
    found = materialise(found.join(asked.select("request_id", "tank_range_km", "fuel_buffer"), "request_id"))
    stops = materialise(fuel.fuel_stops(found, graph))
    good = gpx.documents(found, stops, graph).select("request_id", F.lit(200).alias("status"), F.lit(gpx.CONTENT_TYPE).alias("content_type"), F.col("gpx").alias("body"))
    bad = errors.select("request_id", "status", F.lit("application/json").alias("content_type"), F.to_json(F.struct("error")).alias("body"))
    return good.unionByName(bad)


def health() -> dict[str, str]:
    return {"status": "ok", "version": VERSION}


def inspect(spark: SparkSession, path: str) -> DataFrame:
    return store.inspect(spark, path)


def tags(spark: SparkSession, profile: str | None = None) -> DataFrame:
    return report(spark, load_profile(profile))
