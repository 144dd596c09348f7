"""Hash buckets that are counted by all tasks and become a bitmap of fixed size, which can be broadcast.

A task's counters stop at the least count that matters, so they are a byte for
each bucket; they travel compressed, in chunks, and are added up chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks that counters travel in.
CHUNKS = 256


def has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits at the places are set."""
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1) != 0


class Counters:
    """Counts of hash buckets that stop at ``most``."""

    def __init__(self, buckets: int, most: int) -> None:
        self.most, self.counts = most, np.zeros(buckets, dtype=np.uint8 if most < 256 else np.uint32)

    def add(self, places: np.ndarray) -> None:
        own, n = np.unique(places, return_counts=True)
        self.counts[own] = np.minimum(self.counts[own] + n, self.most)

    def chunks(self) -> list[pa.Array]:
        """Numbers and compressed counts of the chunks that hold anything."""
        parts = [(i, pa.compress(pa.py_buffer(part), codec="zstd", asbytes=True)) for i, part in enumerate(np.split(self.counts, CHUNKS)) if part.any()]
        return [pa.array([i for i, _ in parts], type=pa.int32()), pa.array([data for _, data in parts], type=pa.binary())]


def bitmap(rows: DataFrame, least: int, buckets: int) -> np.ndarray:
    """The buckets whose counts in rows (chunk, data), added up over all tasks, reach ``least``: ``buckets`` packed bits."""
    kind, width = np.uint8 if least < 256 else np.uint32, buckets // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], type=pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["chunk", "bits"])

        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, total = c, np.zeros(width, dtype=np.uint32)
                own = pa.decompress(data, decompressed_size=width * np.dtype(kind).itemsize, codec="zstd", asbytes=True)
                total = np.minimum(total + np.frombuffer(own, dtype=kind), np.uint32(least))
        if chunk is not None:
            yield done()

    added = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, bits binary")
    bits = np.zeros(buckets // 8, dtype=np.uint8)
    for row in added.collect():  # at most CHUNKS rows, as many bits together as there are buckets
        bits[row.chunk * width // 8 : (row.chunk + 1) * width // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


def marks(numbers: DataFrame, buckets: int, least: int = 1) -> np.ndarray:
    """The bitmap of the numbers (one column of longs), modulo ``buckets``, that ``least`` rows have or that share a bit with so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(buckets, least)
        for batch in batches:
            counters.add(batch.column(0).to_numpy() % buckets)
        yield pa.RecordBatch.from_arrays(counters.chunks(), names=["chunk", "data"])

    return bitmap(numbers.mapInArrow(run, "chunk int, data binary"), least, buckets)


def marked(bits: np.ndarray, spark: SparkSession) -> Callable[[Column], Column]:
    """Whether the bit of a number is set, as a column: only the numbers go through Python."""
    shared, buckets = spark.sparkContext.broadcast(bits), 8 * len(bits)

    @F.pandas_udf("boolean")
    def test(numbers: pd.Series) -> pd.Series:
        return pd.Series(has(shared.value, numbers.to_numpy() % buckets))

    return test
