"""Scenic features and the scenic score of segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, from_e7, haversine_m, in_bbox, to_e7
from ..functions.tags import scenic_kind

#: Radius in metres and weight of each kind.
KINDS = {
    "Viewpoint": (5000.0, 0.30),
    "Peak": (4000.0, 0.20),
    "Saddle": (3000.0, 0.12),
    "Water": (1500.0, 0.16),
    "River": (1200.0, 0.14),
    "Stream": (600.0, 0.08),
    "Forest": (12000.0, 0.18),
    "ProtectedArea": (15000.0, 0.22),
    "NatureReserve": (10000.0, 0.20),
    "Glacier": (8000.0, 0.24),
    "Cliff": (4000.0, 0.14),
}
MAX_SCORE = 0.9
#: Half the side of the box, in degrees on both axes, that is searched around a midpoint.
BOX = 15000.0 / 111000.0
#: Metres of a cell's side in the finest grid.
FINEST_M = 600.0


def _table(place: int, kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for name, values in KINDS.items() for x in (name, values[place]))), kind)


def radius(kind: Column) -> Column:
    return _table(0, kind)


def weight(kind: Column) -> Column:
    return _table(1, kind)


def node_features(nodes: DataFrame) -> DataFrame:
    """Scenic features among tagged nodes (osm_id, lat, lon, tags)."""
    kind = scenic_kind(F.col("tags"), on_way=False)
    return nodes.withColumn("kind", kind).where("kind is not null").select("osm_id", to_e7(F.col("lat")).alias("lat_e7"), to_e7(F.col("lon")).alias("lon_e7"), "kind")


def way_features(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The centre of each scenic way over the nodes that are known; the id is the negated way id."""
    kinds = ways.withColumn("kind", scenic_kind(F.col("tags"), on_way=True)).where("kind is not null")
    places = kinds.select("way_id", "kind", F.explode("nodes").alias("osm_id")).join(nodes.select("osm_id", "lat", "lon"), "osm_id")
    centre = places.groupBy("way_id", "kind").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return centre.select((-F.col("way_id")).alias("osm_id"), to_e7(F.col("lat")).alias("lat_e7"), to_e7(F.col("lon")).alias("lon_e7"), "kind")


def grid(radius_m: float) -> int:
    """The grid of a radius: the widest whose cells are no wider than it."""
    return math.floor(math.log2(radius_m / FINEST_M))


def _width(number: Column) -> Column:
    """Degrees of a cell's side."""
    return F.pow(F.lit(2.0), number) * math.degrees(FINEST_M / EARTH_RADIUS_M)


def candidates(midpoints: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of midpoints (lat, lon) and places (f_lat, f_lon, radius) of which each place's circle may hold the midpoint; none is left out, none comes twice."""
    by_radius = F.create_map(*(F.lit(x) for r in sorted({r for r, _ in KINDS.values()}) for x in (r, grid(r))))
    north = F.degrees(F.col("radius") / EARTH_RADIUS_M)
    across = F.sin(F.col("radius") / EARTH_RADIUS_M) / F.greatest(F.cos(F.radians("f_lat")), F.lit(1e-12))
    east = F.when(across < 1, F.least(F.degrees(F.asin(across)), F.lit(BOX))).otherwise(F.lit(BOX))

    def touched(at: str, reach: Column) -> Column:
        side, margin = _width(F.col("grid")), F.lit(1e-7)
        return F.explode(F.sequence(*(F.floor((F.col(at) + sign * (reach + margin)) / side).cast("long") for sign in (-1, 1))))

    filed = places.withColumn("grid", by_radius[F.col("radius")]).withColumn("ci", touched("f_lat", north)).withColumn("cj", touched("f_lon", east))
    grids = F.array(*(F.lit(g) for g in sorted({grid(r) for r, _ in KINDS.values()})))
    own = midpoints.withColumn("grid", F.explode(grids))
    own = own.withColumns({c: F.floor(F.col(at) / _width(F.col("grid"))).cast("long") for c, at in (("ci", "lat"), ("cj", "lon"))})
    return own.join(filed, ["grid", "ci", "cj"]).drop("grid", "ci", "cj")


def scores(midpoints: DataFrame, features: DataFrame, key: list[str], bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``key`` and scenic_score (0 to 255) of the midpoints (key, lat, lon) that have features near; others score 0.

    Each kind has a grid whose cells are between half and all of its radius
    wide.  A feature is filed under the cells that its circle may touch, a
    midpoint under its own cell of each grid, so that few pairs are tested
    that are not near.  A crowded cell is a skewed key of a plain join, which
    adaptive execution splits.
    """
    places = features.select(from_e7(F.col("lat_e7")).alias("f_lat"), from_e7(F.col("lon_e7")).alias("f_lon"), radius(F.col("kind")).alias("radius"), weight(F.col("kind")).alias("weight"))
    if bbox is not None:
        places = places.where(in_bbox(F.col("f_lat"), F.col("f_lon"), bbox))
    box = F.lit(BOX)
    near = candidates(midpoints, places)
    inside = F.col("f_lat").between(F.col("lat") - box, F.col("lat") + box) & F.col("f_lon").between(F.col("lon") - box, F.col("lon") + box)
    near = near.where(inside).withColumn("_d", haversine_m(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"))).where(F.col("_d") <= F.col("radius"))
    total = F.sum(F.col("weight") * (F.lit(1.0) - F.col("_d") / F.col("radius")))
    return near.groupBy(*key).agg(F.round(F.least(total, F.lit(MAX_SCORE)) / F.lit(MAX_SCORE) * 255).cast("int").alias("scenic_score"))
