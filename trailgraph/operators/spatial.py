"""Spatial joins without an index: grid cells turn them into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell, degree_distance, haversine_m
from ..functions.storage import materialise


def around(i: Column, j: Column) -> Column:
    """A cell and its eight neighbours."""
    return F.array(*(F.struct((i + a).alias("ci"), (j + b).alias("cj")) for a in (-1, 0, 1) for b in (-1, 0, 1)))


def cell_join(left: DataFrame, right: DataFrame, step: float, lat: str = "lat", lon: str = "lon", right_lat: str = "r_lat", right_lon: str = "r_lon", how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Rows of both sides whose cells touch.  The right side, which should be the smaller, is filed under nine cells."""
    own = left.withColumns({"ci": cell(F.col(lat), step), "cj": cell(F.col(lon), step)})
    filed = right.withColumn("_c", F.explode(around(cell(F.col(right_lat), step), cell(F.col(right_lon), step)))).select("*", F.col("_c.ci").alias("r_ci"), F.col("_c.cj").alias("r_cj")).drop("_c")
    on = (F.col("ci") == F.col("r_ci")) & (F.col("cj") == F.col("r_cj"))
    joined = own.join(filed, on if condition is None else on & condition, how)
    return joined.drop("ci", "cj", "r_ci", "r_cj")


#: Targets of one list at most; where cells hold more, hits are joined row by row.
LISTED = 10_000


def _met(points: DataFrame, key: str, targets: DataFrame, step: float) -> DataFrame:
    """The points with ``best``: d, t_id, t_lat, t_lon of the nearest target in their cell and its neighbours, null without any.

    Targets are listed by cell, so that a point meets one row and is shuffled
    once, and nothing is sorted or grouped by hits.
    """
    offer = lambda t: F.struct(degree_distance(F.col("lat"), F.col("lon"), t["t_lat"], t["t_lon"]).alias("d"), t["t_id"].alias("t_id"), t["t_lat"].alias("t_lat"), t["t_lon"].alias("t_lon"))
    filed = targets.withColumn("_c", F.explode(around(cell(F.col("t_lat"), step), cell(F.col("t_lon"), step))))
    counts = filed.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if counts <= LISTED:
        lists = filed.groupBy(F.col("_c.ci").alias("r_ci"), F.col("_c.cj").alias("r_cj")).agg(F.collect_list(F.struct("t_id", "t_lat", "t_lon")).alias("_t"))
        own = points.withColumns({"ci": cell(F.col("lat"), step), "cj": cell(F.col("lon"), step)})
        joined = own.join(lists, (F.col("ci") == F.col("r_ci")) & (F.col("cj") == F.col("r_cj")), "left")
        return joined.select(*points.columns, F.array_min(F.transform("_t", offer)).alias("best"))
    hits = cell_join(targets, points, step, "t_lat", "t_lon", "lat", "lon").select(key, offer({c: F.col(c) for c in ("t_id", "t_lat", "t_lon")}).alias("b"))
    return points.join(hits.groupBy(key).agg(F.min("b").alias("best")), key, "left")


def nearest(points: DataFrame, key: str, targets: DataFrame, step: float = 0.05, limit: Column | None = None) -> DataFrame:
    """The nearest target of each point in degrees, then the lowest id.

    points: ``key``, lat, lon (``key`` unique); targets: t_id, t_lat, t_lon.
    Returns the points with t_id, t_lat, t_lon; none without targets.  With a
    ``limit`` in degrees (an expression over the points), points without a
    target that near may be left out.

    Targets are filed under nine cells, points under their own.  A hit is final
    if it lies within one cell's width, as every closer target then lies in the
    nine cells.  What stays open is searched again with cells four times as
    wide, up to its limit, at last with cells wider than the globe.
    """
    found, rest, columns, targets = None, points, points.columns, materialise(targets)
    while True:
        met = materialise(_met(rest, key, targets, step))
        done = F.col("best").isNotNull()
        if step <= 360:
            done &= F.col("best.d") <= step * step
        final = met.where(done)
        found = final if found is None else found.unionByName(final)
        if step > 360:
            break
        rest = met.where(~done).select(*columns)
        rest = rest if limit is None else rest.where(limit > step)
        if rest.isEmpty():
            break
        step = step * 4 if step < 20 else 361.0
    return found.select(*columns, F.col("best.t_id").alias("t_id"), F.col("best.t_lat").alias("t_lat"), F.col("best.t_lon").alias("t_lon"))


def distance(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> Column:
    return haversine_m(F.col(lat_a), F.col(lon_a), F.col(lat_b), F.col(lon_b))
