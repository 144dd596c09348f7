"""Exact joins of documents by the Jaccard similarity of their shingle sets, with skipping by relations between sets.

Equal sets are folded first, by 128 bits of their contents.  Each different set
is filed under its prefix, the shingles that come first in one order of all
shingles (rarest first, as estimated from a part of the texts; any order is
right): two similar sets share a shingle of their prefixes, so no pair is missed.

*Index-level skipping.*  The list of a shingle is sorted by the shingle's position
in a set, then by the set's size.  Entries that agree in both form a block.  Size
and position bound what a set can share with any entry of a block from there on,
so a block is kept or skipped whole, before its entries are looked at.  Shingles
that only one prefix has make no list: a bitmap of hash buckets keeps most of
them from the shuffle.

*Answer-level skipping.*  In each list the first set guides those that follow, and
where a set is similar to its guide, its differences from it are stored.  Sets that guides already join into one component ask the index for
nothing more of each other.  Other candidates are answered through their guides:
the guides' sets are intersected once, and the answers of the sets that follow
them are derived by adding and taking off their differences; a bound by the
sizes of the differences skips most.

Lists that the estimate finds long are dealt out in parts, whose guides are
compared in a second round.  Components come from ``simhash.stars``.

Shingles are 64-bit hashes.  Defined cases
------------------------------------------
* null, empty or blank text: the empty set, of size 0; it is similar to no other, and whether such rows are one is the caller's choice;
* a text of fewer words than a shingle: one shingle of all its words;
* null ids: rows take part, and lend their component no id; repeated rows and ties: one set;
* extra columns: not looked at; empty table: empty result; very long texts: whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import Counters, bitmap, has, marked, marks
from .common import cut, cut_few, small_batches
from .simhash import row_key, stars

#: One text of so many is read for the order; so many shingles are put last; lists that are estimated longer than LIST are dealt out in parts.
PART, FREQUENT, LIST = 8, 1 << 16, 1 << 15
_FLUSH = 1 << 21
#: Classes of size between a set and the smallest one that can be similar to it.
CLASSES = 4
#: Buckets that entries of lists are counted in (8 MB to broadcast, 64 MB to count in); beyond them more entries are shuffled.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 26
#: Hash ranges of a sketch; bits of the map that tells whose texts are read again.
RANGES, WANTED = 256, 1 << 24
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_NONE = np.zeros(0, dtype=np.uint64)


@dataclass(frozen=True)
class Measure:
    """Words of a shingle, the least similarity as a fraction, buckets for each entry of a list (more keep more of them from the shuffle), and whether a set is compared with all its guides at once or with one first: the latter reads fewer whole sets, the former leaves fewer pairs for later."""

    shingle: int
    similar: int
    of: int
    buckets: int = 4
    all_guides: bool = True

    def shingles(self, text: str | bytes | None) -> np.ndarray:
        """The sorted hashes (uint64) of a text's different shingles."""
        if text is None:
            return _NONE
        if isinstance(text, str):
            text = text.encode("utf-8", "surrogatepass")
        words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
        if not words:
            return _NONE
        own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        size = min(self.shingle, len(own))
        n = len(own) - size + 1
        h = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            h = h * _FACTOR + own[k : k + n]
        h = (h ^ (h >> np.uint64(33))) * _MIX
        return np.unique(h ^ (h >> np.uint64(33)))

    def prefix_length(self, n: int) -> int:
        return n - -(-self.similar * n // self.of) + 1 if n else 0

    def holds(self, common: int, n: int, m: int) -> bool:
        return self.of * common >= self.similar * (n + m - common)

    def sizes(self, n: Column, m: Column) -> Column:
        """Sizes that allow the similarity."""
        return self.similar * F.greatest(n, m) <= self.of * F.least(n, m)

    def room(self, n, i, m, j):
        """Whether sets of n and m shingles, with their first common one in places i and j, can still be similar; for columns and arrays."""
        both, needed = self.similar + self.of, self.similar * (n + m)
        return (both * (n - i) >= needed) & (both * (m - j) >= needed)

    def size_class(self, n: Column) -> Column:
        """Similar sizes are at most CLASSES classes apart."""
        return F.floor(F.log(n.cast("double")) * (CLASSES / math.log(self.of / self.similar))).cast("int")


def _name(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _known(own: np.ndarray, last: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of shingles, 0 where they are not known."""
    if not len(last):
        return np.zeros(len(own), dtype=np.int64)
    at = np.minimum(np.searchsorted(last, own), len(last) - 1)
    return np.where(last[at] == own, counts[at], 0)


def _sketch(own: np.ndarray) -> bytes:
    """How many shingles are in each hash range; nothing where a byte is too small for it."""
    counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _frequent(measure: Measure, docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a part hold, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, names, held = [], set(), 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(waiting) if waiting else _NONE, return_counts=True)
            return pa.RecordBatch.from_arrays([_long(h[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.large_binary()):
                own = measure.shingles(t.as_py())
                if (name := _name(own)) not in names:
                    names.add(name)
                    waiting.append(own)
                    held += len(own)
            if held > _FLUSH:
                yield flush()
                waiting, names, held = [], set(), 0
        yield flush()

    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0).select("text")
    top = part.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    h = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], top["n"].to_numpy(dtype=np.int64)[by]


def sets_of(measure: Measure, docs: DataFrame, order: Broadcast) -> DataFrame:
    """doc_id, _k, the name of each row's set, its size n, sketch and prefix (by count where it is known, then by hash), and the row's number s, which stays once the rows are written."""
    names = ["doc_id", "_k", "name", "n", "sketch", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sketches, prefixes = [], [], [], [_NONE]
            for t in batch.column(2).cast(pa.large_binary()):
                own = measure.shingles(t.as_py())
                keys.append(_name(own))
                sizes.append(len(own))
                sketches.append(_sketch(own))
                prefixes.append(own[np.argsort(_known(own, *order.value), kind="stable")[: measure.prefix_length(len(own))]])
            offsets = pa.array(np.cumsum([len(p) for p in prefixes]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, _long(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, type=pa.binary()), pa.array(np.array(sizes, dtype=np.int32)), pa.array(sketches, type=pa.binary()), lists], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_k", "text").mapInArrow(run, f"doc_id {kind}, _k long, name binary, n int, sketch binary, prefix array<long>").withColumn("s", F.monotonically_increasing_id())


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row for each different set that is not empty, numbered by the s of one of its rows: equal sets are folded, and later tables carry numbers instead of names.

    A bitmap tells most names that one row alone has, so that their prefixes are not shuffled.
    """
    spark, name = rows.sparkSession, F.xxhash64("name")
    known = rows.where("n > 0")
    several = marked(marks(known.select(name), WANTED, 2), spark)(name)
    first = [F.first(c).alias(c) for c in ("n", "sketch", "prefix")]
    folded = cut(known.where(several).groupBy("name").agg(F.min("_k").alias("_k"), F.min("s").alias("s"), *first))
    return known.where(~several).select(*folded.columns).unionByName(folded)


def _entries(measure: Measure, sets: DataFrame, order: Broadcast) -> DataFrame:
    """Rows (key, part, n, i, s) of the lists' entries, without most that would be alone in theirs.

    The buckets that prefixes fill twice or more make a bitmap; other shingles
    are in no other prefix.  Lists that the estimate finds longer than LIST have
    parts 1, 2 and so on; a whole one is part 0.
    """
    total = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (measure.buckets * total).bit_length()))
    width = np.uint64(64 - buckets.bit_length() + 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(buckets, 2)
        for batch in batches:
            counters.add((batch.column(0).flatten().to_numpy().view(np.uint64) >> width).astype(np.int64))
        yield pa.RecordBatch.from_arrays(counters.chunks(), names=["chunk", "data"])

    shared = sets.sparkSession.sparkContext.broadcast(bitmap(sets.select("prefix").mapInArrow(fill, "chunk int, data binary"), 2, buckets))  # MOST_BUCKETS bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            key, sizes = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(s)), sizes)
            place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(has(shared.value, (key >> width).astype(np.int64)))
            key, row, place = key[keep], row[keep], place[keep]
            parts = (_known(key, *order.value) * PART // LIST).astype(np.uint64)
            mixed = (s[row].view(np.uint64) * _FACTOR) >> np.uint64(32)
            part = np.where(parts > 0, 1 + mixed % (parts + np.uint64(1)), 0)
            yield pa.RecordBatch.from_arrays([_long(key), pa.array(part.astype(np.int32)), pa.array(n[row]), pa.array(place.astype(np.int32)), pa.array(s[row])], names=["key", "part", "n", "i", "s"])

    return sets.select("s", "n", "prefix").mapInArrow(run, "key long, part int, n int, i int, s long")


def guided(measure: Measure, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, n, i, s) of lists, sorted by key, part, i, n, s; those of lists with several rows, or in parts, out, with their guide s0 where their block leaves room for it.

    The guide of a list is the set that has the shingle first: it has the
    fewest rarer ones, so it is close to most others, and of a group of near
    copies it is the same one in most lists.  It is all that is kept from batch
    to batch.
    """
    names = ["key", "part", "n", "i", "s", "s0"]
    tail, told = None, False  # the guide of the list at hand, and whether it has been put out
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks().to_batches()[0]
        key, part, n, i = (rows.column(c).to_numpy().astype(np.int64) for c in range(4))
        same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        starts = np.flatnonzero(np.r_[True, ~same])
        lengths = np.diff(np.r_[starts, len(key)])
        several = np.repeat(lengths > 1, lengths) | (part > 0)  # a part of a list may have one row
        if tail is not None and told:
            several[: lengths[0]] = True
        guide = np.repeat(starts, lengths)
        # blocks: rows of one list that agree in place and size
        block = np.flatnonzero(np.r_[True, ~same | (n[1:] != n[:-1]) | (i[1:] != i[:-1])])
        b, g = block, guide[block]
        fits = measure.room(n[b], i[b], n[g], i[g]) & (measure.similar * np.maximum(n[b], n[g]) <= measure.of * np.minimum(n[b], n[g]))
        near = np.repeat(fits, np.diff(np.r_[block, len(key)])) & (guide != np.arange(len(key)))
        show = several.copy()
        if tail is not None and told:
            show[0] = False
        s0 = rows.column(4).take(pa.array(np.where(near, guide, 0), mask=~near))
        out = pa.RecordBatch.from_arrays([*rows.columns[:5], s0], names=names).filter(pa.array(show))
        tail, told = rows.slice(int(guide[-1]), 1), bool(several[-1])
        if out.num_rows:
            yield out


_LISTED = "key long, part int, n int, i int, s long, s0 long"


def _listed(measure: Measure, rows: DataFrame) -> DataFrame:
    return rows.select("key", "part", "n", "i", "s").repartition("key", "part").sortWithinPartitions("key", "part", "i", "n", "s").mapInArrow(lambda b: guided(measure, b), _LISTED)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("s", "t").alias("a"), F.least("s", "t").alias("b")).distinct()


def candidates(measure: Measure, mixed: DataFrame) -> DataFrame:
    """Pairs (s, t) of sets of different components g that share a list, from the pairs of its blocks that leave room.

    The larger set asks for the classes of size that its place allows; the
    smaller one is filed where its place allows one of its own size.
    """
    both, similar, of = measure.similar + measure.of, measure.similar, measure.of
    n, i = F.col("n"), F.col("i")
    blocks = mixed.groupBy("key", "n", "i").agg(F.min("g").alias("g"), (F.min("g") != F.max("g")).alias("open"))
    least, most = F.ceil(n * (similar / of) - 1e-9).cast("int"), F.least(n, F.floor((both * (n - i)) / similar).cast("int") - n)
    asking = blocks.where(least <= most).withColumn("size", F.explode(F.sequence(measure.size_class(least), measure.size_class(most))))
    filed = blocks.where(both * (n - i) >= 2 * similar * n).select("key", n.alias("m"), i.alias("j"), F.col("g").alias("h"), F.col("open").alias("also"), measure.size_class(n).alias("size"))
    met = asking.join(filed, ["key", "size"]).where((F.col("m") <= n) & measure.sizes(n, F.col("m")) & measure.room(n, i, F.col("m"), F.col("j")) & (F.col("open") | F.col("also") | (F.col("g") != F.col("h"))))
    met = met.select("key", "n", "i", "m", "j")
    left, right = mixed.select("key", "n", "i", "s", "g"), mixed.select("key", n.alias("m"), i.alias("j"), F.col("s").alias("t"), F.col("g").alias("h"))
    return met.join(left, ["key", "n", "i"]).join(right, ["key", "m", "j"]).where("g != h").select("s", "t")


def _possible(measure: Measure, pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) whose sketches leave room for the similarity: no hash range holds more common shingles than the lesser count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            room = []
            for x, y, n, m in zip(*batch.columns[2:], strict=True):
                x, y = x.as_py(), y.as_py()
                common = int(np.minimum(np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)).sum(dtype=np.int64)) if x and y else 0
                room.append(not (x and y) or measure.holds(common, n.as_py(), m.as_py()))
            yield batch.select(["a", "b", "n", "m"]).filter(pa.array(room, type=pa.bool_()))

    x, y = (brief.select(F.col("s").alias(k), F.col("sketch").alias(v), F.col("n").alias(c)) for k, v, c in (("a", "x", "n"), ("b", "y", "m")))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long, n int, m int")


def _whole_sets(measure: Measure, docs: DataFrame, brief: DataFrame, wanted: DataFrame) -> DataFrame:
    """s and its whole set, from the text of one row each.  A bitmap keeps most other rows from the shuffle, the join drops the rest."""
    wanted = cut_few(wanted.distinct().join(brief.select("s", "_k"), "s"))
    shared = docs.sparkSession.sparkContext.broadcast(marks(wanted.select("_k"), WANTED))  # WANTED bits, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(has(shared.value, batch.column(0).to_numpy() % WANTED)))
            own = [measure.shingles(t.as_py()).tobytes() for t in some.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(own, type=pa.binary())], names=["_k", "own"])

    sets = cut(docs.select("_k", "text").mapInArrow(run, "_k long, own binary").join(wanted, "_k").select("s", "own").dropDuplicates(["s"]))
    shared.unpersist()
    return sets


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.join(sets.select(F.col("s").alias(b), F.col("own").alias("y")), b).join(sets.select(F.col("s").alias(a), F.col("own").alias("x")), a)


def _array(value: pa.Scalar) -> np.ndarray:
    held = value.as_py()
    return np.frombuffer(held, dtype=np.uint64) if held else _NONE


def _followed(measure: Measure, pairs: DataFrame, docs: DataFrame, brief: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and its guide that are similar, with the set's differences: what it has more, and what it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, more, less = [], [], []
            for x, y in zip(*batch.columns[2:], strict=True):
                x, y = _array(x), _array(y)
                common = np.intersect1d(x, y, assume_unique=True)
                keep.append(measure.holds(len(common), len(x), len(y)))
                if keep[-1]:
                    more.append(np.setdiff1d(x, common, assume_unique=True).tobytes())
                    less.append(np.setdiff1d(y, common, assume_unique=True).tobytes())
            own = batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(more, type=pa.binary()), pa.array(less, type=pa.binary())], names=["a", "b", "more", "less"])

    sets = _whole_sets(measure, docs, brief, pairs.select(F.explode(F.array("a", "b")).alias("s")))
    return _with_sets(pairs, sets, "a", "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, more binary, less binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0


def answers(measure: Measure, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: two guides with their whole sets, then the pairs of sets that follow them, with differences.  The similar pairs out."""
    guides = None
    for batch in batches:
        a, b = [], []
        for row in range(batch.num_rows):
            pair = (batch.column("ga")[row].as_py(), batch.column("gb")[row].as_py())
            if not batch.column("asks")[row].as_py():
                x, y = _array(batch.column("x")[row]), _array(batch.column("y")[row])
                guides = pair, x, y, _common(x, y)
                continue
            assert guides is not None and guides[0] == pair
            _, x, y, shared = guides
            n, m = batch.column("n")[row].as_py(), batch.column("m")[row].as_py()
            more_a, less_a, more_b, less_b = (_array(batch.column(c)[row]) for c in ("more_a", "less_a", "more_b", "less_b"))
            if not measure.holds(shared + len(more_a) + len(more_b), n, m):
                continue
            common = shared - _common(less_a, y) - _common(less_b, x) + _common(less_a, less_b)
            common += _common(more_a, y) - _common(more_a, less_b) + _common(more_b, x) - _common(more_b, less_a) + _common(more_a, more_b)
            if measure.holds(common, n, m):
                a.append(batch.column("a")[row].as_py())
                b.append(batch.column("b")[row].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


def _answered(measure: Measure, pairs: DataFrame, followed: DataFrame, docs: DataFrame, brief: DataFrame) -> DataFrame:
    """The similar ones of the pairs (a, b), through their guides.  A set without a guide is its own."""
    pairs = cut_few(_possible(measure, pairs, brief))
    guide = followed.groupBy("a").agg(F.min(F.struct(F.length("more") + F.length("less"), "b", "more", "less")).alias("f")).select("a", "f.b", "f.more", "f.less")
    for side in ("a", "b"):
        own = guide.select(F.col("a").alias(side), F.col("b").alias("g"), F.col("more").alias(f"more_{side}"), F.col("less").alias(f"less_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"g{side}", F.coalesce("g", side)).drop("g")
    pairs = cut(pairs)
    met = pairs.select("ga", "gb").distinct()
    sets = _whole_sets(measure, docs, brief, met.select(F.explode(F.array("ga", "gb")).alias("s")))
    columns = ["ga", "gb", "asks", "x", "y", "a", "b", "n", "m", "more_a", "less_a", "more_b", "less_b"]
    rows = pairs.withColumn("asks", F.lit(True)).unionByName(_with_sets(met, sets, "ga", "gb").withColumn("asks", F.lit(False)), allowMissingColumns=True).select(*columns)
    return rows.repartition("ga", "gb").sortWithinPartitions("ga", "gb", "asks").mapInArrow(lambda batches: answers(measure, batches), "a long, b long")


def groups(measure: Measure, docs: DataFrame, sets: DataFrame, order: Broadcast) -> DataFrame:
    """(a, b) for each of the different sets a but the least b of its component."""
    listed = cut(_listed(measure, _entries(measure, sets, order)))
    over = _listed(measure, listed.where("part > 0 AND s0 IS NULL").withColumn("part", F.lit(0)))
    led = cut_few(listed.unionByName(over).where("s0 IS NOT NULL").groupBy(F.col("s").alias("a"), F.col("s0").alias("b")).agg(F.count(F.lit(1)).alias("lists")))
    direct = _possible(measure, led.select("a", "b"), sets).select("a", "b")
    if not measure.all_guides:  # the one of most lists; what this leaves apart is met below
        best = F.max(F.struct("lists", (-F.col("b")).alias("b"))).alias("best")
        direct = direct.join(led, ["a", "b"]).groupBy("a").agg(best).select("a", (-F.col("best.b")).alias("b"))
    direct = cut_few(direct)
    tried = led if measure.all_guides else direct
    followed = cut(_followed(measure, direct, docs, sets))
    near = followed.select("a", "b")
    star = stars(near)
    label = listed.join(star.select(F.col("a").alias("s"), F.col("b").alias("g")), "s", "left").select("key", "s", "n", "i", F.coalesce("g", "s").alias("g"))
    mixed = cut(label.join(label.groupBy("key").agg((F.min("g") != F.max("g")).alias("open")).where("open").select("key"), "key"))
    known = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = _ordered(candidates(measure, mixed)).join(known, ["a", "b"], "left_anti")
    return stars(near.unionByName(_answered(measure, rest, followed, docs, sets)))


def components_of(docs: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _k, name, n), and the name and component g of each different set that is not empty."""
    small_batches(docs.sparkSession)
    named = docs.select("doc_id", "text", row_key().alias("_k"))
    order = docs.sparkSession.sparkContext.broadcast(_frequent(measure, named))  # FREQUENT entries at most
    rows = cut(sets_of(measure, named, order))
    sets = distinct_sets(rows)
    star = groups(measure, named, sets, order).select(F.col("a").alias("s"), F.col("b").alias("g"))
    return rows.select("doc_id", "_k", "name", "n"), sets.select("name", "s").join(star, "s", "left").select("name", F.coalesce("g", "s").alias("g"))


def components(docs: DataFrame, measure: Measure) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, itself included) of every row; rows without words are linked with nothing."""
    rows, member = components_of(docs, measure)
    first = cut(rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least")).join(member, "name"))
    least = first.groupBy("g").agg(F.min("least").alias("component_id"))
    own = first.join(least, "g").select("name", "component_id")
    return rows.join(own, "name", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
