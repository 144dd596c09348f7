"""Materialising intermediate tables where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of monotonically_increasing_id() within one partition: its lower 33 bits.
_LOW = (1 << 33) - 1


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is configured, a temporary one, but only on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="trailgraph-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder, so that loops and lost executors cost nothing twice."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dense_ids(df: DataFrame, order: list[Column], name: str, start: int = 0, step: int = 1) -> DataFrame:
    """Gapless ids in the order of ``order`` (which must be total), without a single task that sees all rows.

    Rows are range-partitioned and sorted; an id is the partition's offset
    plus the row's place in it.  The driver sees one count for each partition.
    """
    tagged = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).cast("int")
    counts = dict(tagged.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    offset = F.get(F.split(F.lit(",".join(map(str, offsets or [0]))), ",").cast("array<long>"), part)
    return tagged.withColumn(name, F.lit(start) + (offset + F.col("_row").bitwiseAND(F.lit(_LOW))) * step).drop("_row")
