"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance.

Exact copies share a fingerprint and are folded first.  Fingerprints that
differ in two bits at most agree in all but two of any blocks of their bits, so
each is filed under its bits without two of four blocks (six keys), and such
pairs meet.  Under a key, fingerprints are compared bit-sliced: bit planes are
stored vertically, 64 distances to a machine word; carry-save counters add one
plane after another; blocks are abandoned once all their distances exceed the
radius.  A key yields a star forest of its links, never all pairs.

Fingerprints of a key that has more than ``RUN`` of them are filed again, by
eight smaller blocks, and at last by sixteen: a key is then 56 of the 64 bits,
and there are 256 fingerprints at most that share it.  So every comparison is
bit-sliced and bounded, however alike the fingerprints are, and no task ever
receives a larger run.

Components come from alternating large-star and small-star rounds over the
links, each round written to the shared checkpoint folder.

Defined cases
-------------
* null, empty or blank text: fingerprint zero, linked like any other;
* null id: the row is returned with null id; it lends its component no id;
* repeated rows and ties: same fingerprint, same component; ``keep_one`` keeps one row of them;
* empty table: empty result;
* very long text: whole, in chunks of shingles;
* extra columns, with whatever names: ``components`` returns its own columns only, ``keep_one`` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_few, fresh, own_columns, small_batches

BITS = 64
RADIUS = 2
#: Blocks that fingerprints are cut into, to be filed without any two of them: at first, and where keys are too full.
LEVELS = (4, 8, 16)
SHINGLE = 3
SEED = 42
#: Fingerprints under one key that are compared directly; those of fuller keys are filed again.
RUN = 8192
#: Runs up to here are compared together with others, pair by pair of positions.
SHORT = 64
_CHUNK = 1 << 16


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    if text is None:
        return 0
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones, digest, join = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest, b" ".join
    for first in range(0, n, _CHUNK):
        last = min(n, first + _CHUNK)
        columns = [words[first + k : last + k] for k in range(min(shingle, len(words)))]
        hashes = np.fromiter((digest(join(s), SEED) for s in zip(*columns, strict=False)), dtype=np.uint64, count=last - first)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of ``keep`` and the (signed) fingerprint ``fp`` of each row."""
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, fp long")


# ------------------------------------------------------- bit-sliced comparison


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 values, stored vertically: row b has bit b of 64 values in each word."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Carry-save counters of differing bits, 64 to a word, that remember an overflow."""

    def __init__(self, shape: tuple[int, ...], radius: int) -> None:
        self.radius = radius
        self.levels = [np.zeros(shape, dtype=np.uint64) for _ in range((radius + 1).bit_length())]
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, plane: np.ndarray) -> None:
        carry = plane
        for i, level in enumerate(self.levels):
            self.levels[i], carry = level ^ carry, level & carry
        self.over |= carry

    def beyond(self) -> np.ndarray:
        """Bits whose count exceeds the radius."""
        more, equal = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for i in reversed(range(len(self.levels))):
            if self.radius >> i & 1:
                equal &= self.levels[i]
            else:
                more |= equal & self.levels[i]
                equal &= ~self.levels[i]
        return self.over | more

    def keep(self, rows: np.ndarray) -> None:
        self.levels = [x[rows] for x in self.levels]
        self.over = self.over[rows]


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def near(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each query (uint64), a row of words whose bits say which of the planes' values are within the radius."""
    words = planes.shape[1]
    result = np.zeros((len(queries), words), dtype=np.uint64)
    alive = np.arange(len(queries))
    count = Counters((len(queries), words), radius)
    masks = np.where(queries[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1), _ALL, np.uint64(0))
    for bit in range(BITS):
        count.add(planes[bit][None, :] ^ masks[alive, bit][:, None])
        if bit % 8 == 7:
            open_rows = (count.beyond() != _ALL).any(axis=1)
            if not open_rows.all():  # abandon a query's block: every distance exceeds the radius
                alive = alive[open_rows]
                count.keep(open_rows)
                if not len(alive):
                    return result
    result[alive] = ~count.beyond()
    return result


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which positions of two equally long arrays are within the radius."""
    planes = planes_of(a ^ b)
    count = Counters((planes.shape[1],), radius)
    alive = np.arange(planes.shape[1])
    result = np.zeros(planes.shape[1], dtype=np.uint64)
    for bit in range(BITS):
        count.add(planes[bit, alive])
        if bit % 8 == 7:
            open_words = count.beyond() != _ALL
            if not open_words.all():
                alive = alive[open_words]
                count.keep(open_words)
    result[alive] = ~count.beyond()
    return np.unpackbits(result.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component, given links between positions."""
    while True:
        least = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _short_runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between positions of equal key, at all lags."""
    left, right = [], []
    lag, at = 1, np.arange(len(keys))
    while len(at := at[at + lag < len(keys)]) and len(at := at[keys[at] == keys[at + lag]]):
        hit = near_pairs(values[at], values[at + lag])
        left.append(at[hit])
        right.append(at[hit] + lag)
        lag += 1
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _long_run(values: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Least position of each value's component in one run, from a matrix of bits."""
    planes, n = planes_of(values), len(values)
    matrix = np.concatenate([near(values[i : i + chunk], planes) for i in range(0, n, chunk)])
    labels = np.arange(n)
    while True:
        before = labels.copy()
        for i in range(0, n, chunk):
            bits = np.unpackbits(matrix[i : i + chunk].view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
            labels[i : i + chunk] = np.minimum(labels[i : i + chunk], np.where(bits, labels[None, :], n).min(axis=1))
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _stars(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least of its component) under whole runs of equal keys."""
    values = fps.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    short = np.repeat((lengths > 1) & (lengths <= SHORT), lengths)
    k, f, v = keys[short], fps[short], values[short]
    a, b = _short_runs(k, v)
    labels = _forest(np.arange(len(k)), a, b)
    moved = np.flatnonzero(labels != np.arange(len(k)))
    child, parent = [f[moved]], [f[labels[moved]]]
    for start, length in zip(starts[lengths > SHORT], lengths[lengths > SHORT], strict=True):
        own = fps[start : start + length]
        labels = _long_run(own.view(np.uint64))
        moved = np.flatnonzero(labels != np.arange(length))
        child.append(own[moved])
        parent.append(own[labels[moved]])
    return np.concatenate(child), np.concatenate(parent)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) rows in, links out; a run of equal keys is held whole."""
    empty = np.zeros(0, dtype=np.int64)
    keys, fps, waiting, held = empty, empty, [], 0

    def gathered(last: bool) -> pa.RecordBatch:
        nonlocal keys, fps, waiting, held
        keys, fps = np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([fps, *(f for _, f in waiting)])
        waiting, held = [], 0
        ends = len(keys) if last or not len(keys) else np.searchsorted(keys, keys[-1], "left")
        child, parent = _stars(keys[:ends], fps[:ends]) if ends else (empty, empty)
        keys, fps = keys[ends:], fps[ends:]
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)], names=["a", "b"])

    for batch in batches:
        waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held >= _CHUNK:
            yield gathered(False)
    yield gathered(True)


# ------------------------------------------------------------------- relations


def _keys(fp: Column, blocks: int) -> Column:
    """A key for each two of the blocks: the other bits, and which two."""
    width = BITS // blocks
    masks = []
    for i, j in combinations(range(blocks), 2):
        mask = ((1 << BITS) - 1) ^ ((1 << width) - 1) << width * i ^ ((1 << width) - 1) << width * j
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m, n: F.xxhash64(n, fp.bitwiseAND(m)))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that join the fingerprints of ``distinct`` (column fp, no repeats) into their components."""
    found = []
    for blocks in LEVELS:
        keyed = distinct.select(F.explode(_keys(F.col("fp"), blocks)).alias("key"), "fp")
        full = None
        if blocks != LEVELS[-1]:
            full = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RUN).select("key"))
            full = None if full.isEmpty() else full
        if full is not None:
            distinct = cut(keyed.join(full, "key", "left_semi").select("fp").distinct())
            keyed = keyed.join(full, "key", "left_anti")
        found.append(cut(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare, "a long, b long")))
        if full is None:
            break
    return _ordered(reduce(DataFrame.unionByName, found)).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) for each linked node a but the least b of its component."""
    edges = cut_few(edges)
    rows, state = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(own, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = cut_few(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), rows)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first()
        if now == state:
            return edges
        rows, state = now[0], now


def component_map(fps: DataFrame) -> DataFrame:
    """fp, component_id (least doc_id reachable) and group (least fingerprint reachable) for each different fingerprint of (doc_id, fp) rows."""
    first = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    star = stars(links(first.select("fp")))
    member = star.select(F.col("a").alias("fp"), F.col("b").alias("group")).unionByName(star.select(F.col("b").alias("fp"), F.col("b").alias("group")).distinct())
    linked = cut(member.join(first, "fp").select("fp", "group", "first_id"))
    least = linked.groupBy("group").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(least, "group").select("fp", "group", "least_id")
    return first.join(linked, "fp", "left").select(
        "fp", F.when(F.col("group").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"), F.coalesce("group", "fp").alias("group")
    )


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    fps = cut(fingerprints(docs, "doc_id"))
    groups = cut(component_map(fps).select("fp", "component_id"))
    return fps.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_key() -> Column:
    """What tells rows apart by id and text."""
    return F.xxhash64("doc_id", "text")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the least id, then of the least hash.  All columns are kept; texts are shuffled once."""
    own = docs.select("doc_id", "text", row_key().alias("_k"))
    fps = cut(fingerprints(own, "doc_id", "_k"))
    groups = cut(component_map(fps).select("fp", "group"))
    return keep_least(docs, fps.join(groups, "fp").select("doc_id", "_k", "group"))


def keep_least(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``members`` (doc_id, _k, group): that of the least id, then of the least _k."""
    k, key, least = fresh(docs, "_k", "_key", "_least")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_k").alias("k"))
    kept = members.groupBy("group").agg(F.min(rank).alias("r")).select(F.col("r.k").alias(key), F.col("r.i").alias(least))
    same = F.when(F.col("doc_id").isNull(), F.col(least).isNull()).otherwise(F.col("doc_id") == F.col(least))  # not a join key, so that texts are shuffled once
    return docs.withColumn(k, row_key()).join(kept, F.col(k) == F.col(key)).where(same).dropDuplicates([k]).select(*own_columns(docs))
