"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import checkpoint_dir, materialise, shared_path  # noqa: F401

#: Short rows to a file of an intermediate table.
ROWS_A_FILE = 1 << 14

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word of the contracts that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


cut = materialise


def cut_few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``cut`` for tables of short rows, in few files: one to so many rows where their number is known, else four to a core.

    Every file that an executor begins starts a process, so hundreds of files
    of a few rows each cost more than the rows.
    """
    files = 4 * df.sparkSession.sparkContext.defaultParallelism if rows is None else -(-rows // ROWS_A_FILE)
    return cut(df.coalesce(max(1, files)))


def quoted(name: str) -> str:
    """A column's name, for use in expressions."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with as many underscores before each as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with plain column names, for functions that take no others; ``toDF`` brings the names back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that Python workers hold, by rows and by bytes: whole texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> Iterator[None]:
    """``small_batches`` for the jobs within, after which the session has its own settings again."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n, None) for n in names]
    small_batches(spark, rows, size)
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"
