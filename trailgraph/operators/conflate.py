"""Forest roads: from records to ways and nodes, snapped to mapped nodes; mapped ways that they cover are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, in_bbox
from ..functions.storage import dense_ids, materialise
from ..functions.tags import TRACK_CLASSES, existing, tag_in, usfs_tags
from .spatial import cell_join
from .ways import segments

#: Cells for snapping, in degrees; a snap radius beyond a cell's width finds nothing more.
SNAP_STEP = 0.001
METRES_PER_DEGREE = 111000.0
RADIUS_M, MIN_COVERAGE, SNAP_M = 50.0, 0.5, 50.0
#: Decimal places at which vertices count as one.
VERTEX_PLACES = 1e6


def road_parts(records: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """record_id, part_no, points, tags of the parts of existing roads that have two points and, given a box, one inside."""
    tags = usfs_tags(*(F.col(c) for c in ("OPER_MAINT", "OPENFORUSE", "OBJECTIVE_", "SURFACE_TY", "NAME")))
    parts = records.where(existing(F.col("ROUTE_STAT"))).select("record_id", tags.alias("tags"), F.posexplode("parts").alias("part_no", "points"))
    parts = parts.where(F.size("points") >= 2)
    if bbox is not None:
        parts = parts.where(F.exists("points", lambda p: in_bbox(p["lat"], p["lon"], bbox)))
    return parts


def vertices(parts: DataFrame) -> DataFrame:
    """A row for each vertex, with its place and whether it is an end."""
    rows = parts.select("record_id", "part_no", F.size("points").alias("n"), F.posexplode("points").alias("pos", "p"))
    return rows.select("record_id", "part_no", "pos", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).alias("is_end"))


def snap_ends(ends: DataFrame, nodes: DataFrame, snap_m: float = SNAP_M) -> DataFrame:
    """record_id, part_no, pos and the nearest mapped node (then the lowest id) of the ends that have one near."""
    key = ["record_id", "part_no", "pos"]
    near = cell_join(nodes.select("osm_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), ends.select(*key, "lat", "lon"), SNAP_STEP, "r_lat", "r_lon", "lat", "lon")
    near = near.withColumn("_d", haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("_d") <= snap_m)
    return near.groupBy(*key).agg(F.min(F.struct("_d", "osm_id")).alias("b")).select(*key, F.col("b.osm_id").alias("osm_id"))


def vertex_key(lat: Column, lon: Column) -> list[Column]:
    return [F.round(lat * VERTEX_PLACES).cast("long").alias("key_lat"), F.round(lon * VERTEX_PLACES).cast("long").alias("key_lon")]


def road_ways(records: DataFrame, nodes: DataFrame, snap_m: float = SNAP_M, bbox: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Ways and new nodes of forest roads; their ids are negative, in the order of records.

    Ends go to a mapped node within ``snap_m``; other vertices that agree to
    six decimals are one node, at the coordinates of the first.
    """
    order = ["record_id", "part_no"]
    parts = dense_ids(road_parts(records, bbox), [F.col(c) for c in order], "way_id", start=-1, step=-1)
    points = materialise(vertices(parts))
    snapped = snap_ends(points.where("is_end"), nodes, snap_m)
    rows = points.join(snapped, [*order, "pos"], "left")
    free = rows.where("osm_id is null").select(*order, "pos", "lat", "lon", *vertex_key(F.col("lat"), F.col("lon")))
    first = free.groupBy("key_lat", "key_lon").agg(F.min(F.struct(*order, "pos", "lat", "lon")).alias("f"))
    made = dense_ids(first, [F.col("f.record_id"), F.col("f.part_no"), F.col("f.pos")], "new_id", start=-1, step=-1)
    new_nodes = made.select(F.col("new_id").alias("osm_id"), F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"))
    keyed = rows.select(*order, "pos", "osm_id", *vertex_key(F.col("lat"), F.col("lon"))).join(made.select("key_lat", "key_lon", "new_id"), ["key_lat", "key_lon"], "left")
    lists = keyed.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("osm_id", "new_id").alias("id")))).alias("l"))
    ways = parts.join(lists, order).select("way_id", F.transform("l", lambda x: x["id"]).alias("nodes"), "tags")
    return ways, new_nodes


def coverage(ways: DataFrame, nodes: DataFrame, road_nodes: DataFrame, radius_m: float = RADIUS_M, grid_step: float = 0.001) -> DataFrame:
    """way_id and the share of its segments (both ends known) whose midpoint has a road vertex near; ways without such segments are missing."""

    def end(name: str) -> DataFrame:
        return nodes.select(F.col("osm_id").alias(name), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))

    placed = segments(ways).join(end("a"), "a").join(end("b"), "b")
    middle = placed.select("way_id", "pos", ((F.col("a_lat") + F.col("b_lat")) * 0.5).alias("lat"), ((F.col("a_lon") + F.col("b_lon")) * 0.5).alias("lon"))
    spread = F.lit(radius_m) / (F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians("lat")), F.lit(0.1)))
    near = (
        (F.abs(F.col("r_lat") - F.col("lat")) <= radius_m / METRES_PER_DEGREE)
        & (F.abs(F.col("r_lon") - F.col("lon")) <= spread)
        & (haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= radius_m)
    )
    spots = road_nodes.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    covered = cell_join(middle, spots, grid_step, how="left_semi", condition=near).select("way_id", "pos").withColumn("hit", F.lit(1.0))
    return middle.join(covered, ["way_id", "pos"], "left").groupBy("way_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("coverage"))


def uncovered(ways: DataFrame, nodes: DataFrame, road_nodes: DataFrame, radius_m: float = RADIUS_M, min_coverage: float = MIN_COVERAGE, grid_step: float = 0.001) -> DataFrame:
    """The ways without those of low classes that forest roads cover."""
    low = ways.where(tag_in(F.col("tags"), "highway", TRACK_CLASSES))
    gone = coverage(low, nodes, road_nodes, radius_m, grid_step).where(F.col("coverage") >= min_coverage)
    return ways.join(gone, "way_id", "left_anti")


def counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """kept and dropped: one row."""
    marked = before.select("way_id").join(after.select("way_id", F.lit(True).alias("stays")), "way_id", "left")
    return marked.agg(F.count_if(F.col("stays")).alias("kept"), F.count_if(F.col("stays").isNull()).alias("dropped"))
