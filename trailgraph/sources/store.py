"""The graph store: nodes, edges and fuel stations as Parquet with a meta table."""

from __future__ import annotations

import warnings
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ways import Graph
from ..schemas import FUEL_STATIONS, META

FORMAT_VERSION = 1
MAX_AGE = timedelta(days=180)


class StoreError(ValueError):
    """The folder holds no graph that can be used."""


def save(graph: Graph, path: str, fingerprint: str, pbf_timestamp: datetime | None = None) -> None:
    """Replace the graph at ``path``; the meta table is written last, so a broken write is noticed."""
    spark = graph.nodes.sparkSession
    fuel = graph.fuel_stations if graph.fuel_stations is not None else spark.createDataFrame([], FUEL_STATIONS)
    for name, table in (("nodes", graph.nodes), ("edges", graph.edges), ("fuel_stations", fuel)):
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    meta = spark.range(1).select(F.lit(FORMAT_VERSION).alias("format_version"), F.lit(fingerprint).alias("fingerprint"), F.lit(pbf_timestamp).cast("timestamp").alias("pbf_timestamp"))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str):
    try:
        meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    except AnalysisException as error:
        raise StoreError(f"no graph at {path}; please rebuild") from error
    if meta is None or meta["format_version"] != FORMAT_VERSION:
        raise StoreError(f"graph at {path} has format {meta and meta['format_version']}, not {FORMAT_VERSION}; please rebuild")
    return meta


def load(spark: SparkSession, path: str, fingerprint: str | None = None) -> Graph:
    """The stored graph; an error if it was built with another profile than ``fingerprint`` says, a warning if its map is old."""
    meta = read_meta(spark, path)
    if fingerprint is not None and meta["fingerprint"] != fingerprint:
        raise StoreError(f"graph at {path} was built with another profile; please rebuild")
    if meta["pbf_timestamp"] is not None and datetime.now() - meta["pbf_timestamp"] > MAX_AGE:
        warnings.warn(f"the map data of {path} are older than {MAX_AGE.days} days", stacklevel=2)
    return Graph(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "fuel_stations")))


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """path, nodes, edges, fuel_stations, fingerprint, pbf_timestamp of a stored graph: one row."""
    meta = read_meta(spark, path)
    graph = load(spark, path)
    counts = [t.agg(F.count(F.lit(1)).alias(n)) for t, n in ((graph.nodes, "nodes"), (graph.edges, "edges"), (graph.fuel_stations, "fuel_stations"))]
    about = spark.range(1).select(F.lit(path).alias("path"), F.lit(meta["fingerprint"]).alias("fingerprint"), F.lit(meta["pbf_timestamp"]).cast("timestamp").alias("pbf_timestamp"))
    return about.join(counts[0]).join(counts[1]).join(counts[2])
