"""Phrase collocations by hashed passes: bucket counts of the next length, bitmaps, Apriori pruning, exact counts.

Pass k reads all texts once.  It counts the phrases of k words that can still
be frequent, exactly, and on the way counts hash buckets of phrases of k + 1
words.  What is frequent in pass k, and which buckets are full enough, become
two bitmaps, at most ``MOST_BUCKETS`` bits each, which are broadcast for pass
k + 1: there a phrase is counted only if its bucket is full and both phrases of
k words in it have their bits set.  Bits let a few phrases too many through and
never lose one, so the counts, which are grouped by the words themselves, are
exact.  There is a bucket to every ``BYTES_A_BUCKET`` bytes of text up to that
bound; beyond it more phrases pass, with the same result.  Bucket counts stop at the least count that matters, so a task's counters
are one byte for each bucket, are compressed and shuffled in chunks, and are
added up chunk by chunk.

Everything is by language.  A phrase cut after its first words scores
``floor(SCALE * a * a / (l * r))``, in decimals of 38 digits, which is exact up
to 10**16 occurrences; the lowest cut counts.

Defined cases
-------------
* null language: ``und``, together with rows that say ``und``; the empty string is a language;
* null or empty text, text of separators only: no words;
* repeated rows, ties: each row counts; ties between cuts go to the shortest first part;
* null or repeated ids, extra columns: not looked at;
* very long texts: whole, in chunks that end between pieces;
* empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import Counters, bitmap, has
from .common import arrow_batches, cut, shared_path

#: Least count, longest phrase, share of a phrase (in hundredths) that lies in a longer one, phrases of a language.
MIN_COUNT, MAX_WORDS, INSIDE, TOP = 10, 3, 50, 2000
SCALE = 1_000_000
#: Buckets, and bits of a bitmap: a power of two, one to so many bytes of text, within these bounds (16 MB to broadcast, 128 MB to count in).
BYTES_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 16, 1 << 27
#: Bytes of text that are taken apart at once, counted phrases that a task holds; languages are ranked in so many parts before the last ranking.
_TEXT, _HELD, _SALT = 4 << 20, 1 << 19, 16
_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes(ord("a") + c - ord("A") if ord("A") <= c <= ord("Z") else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_ROWS = "lang string, gram binary, n long, chunk int, data binary"


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but their last words."""
    h = (h ^ word) * _FACTOR
    return (h ^ (h >> np.uint64(32))) * _MIX


def _place(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int32)


def _chunks(texts: list[bytes]) -> Iterator[bytes]:
    """Translated text, a separator around each piece, in chunks that end at one."""
    held = _END + _END.join(t.translate(_TABLE) for t in texts) + _END
    start = 0
    while start < len(held) - 1:
        end = held.rfind(_END, start + 1, start + _TEXT)
        end = held.find(_END, start + _TEXT) if end < 0 else end
        end = len(held) - 1 if end < 0 else end
        yield held[start : end + 1]
        start = end


def _words(chunk: bytes) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words in order, 0 between pieces, and the words by code."""
    own = pa.array(chunk.replace(_END, b" \xff ").split(), type=pa.binary()).dictionary_encode()
    return own.indices.to_numpy(zero_copy_only=False), own.dictionary


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    lang = batch.column(0).fill_null("und").dictionary_encode()
    codes, texts = lang.indices.to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary())
    for code, name in enumerate(lang.dictionary.to_pylist()):
        yield name, [t.as_py() for t in texts.take(pa.array(np.flatnonzero(codes == code))) if t.is_valid]


def _batch(lang, gram, n, chunk, data) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip((lang, gram, n, chunk, data), kinds, strict=True)], names=["lang", "gram", "n", "chunk", "data"])


def _counted(lang: str, codes: np.ndarray, words: pa.Array, at: np.ndarray, size: int) -> pa.RecordBatch:
    """Phrases of ``size`` words that start at the positions ``at``, and how often each occurs."""
    own = codes[at].astype(np.int64)
    for k in range(1, size):
        own = np.unique(own, return_inverse=True)[1] * len(words) + codes[at + k]
    _, first, n = np.unique(own, return_index=True, return_counts=True)
    parts = [words.take(pa.array(codes[at[first] + k])) for k in range(size)]
    gram = pc.binary_join_element_wise(*parts, pa.scalar(b" ", type=pa.binary())) if size > 1 else parts[0]
    return _batch(pa.array([lang], type=pa.string()).take(pa.array(np.zeros(len(n), dtype=np.int32))), gram, n.astype(np.int64), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same counts in fewer rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > 2 * _HELD:
            own = _summed(held)
            held, rows = own.to_batches(), own.num_rows
            if rows > _HELD:
                yield from held
                held, rows = [], 0
    yield from _summed(held).to_batches() if held else ()


def _summed(batches: list[pa.RecordBatch]) -> pa.Table:
    own = pa.Table.from_batches(batches).group_by(["lang", "gram"], use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    return pa.table({"lang": own["lang"], "gram": own["gram"], "n": own["n_sum"], "chunk": pa.nulls(len(own), pa.int32()), "data": pa.nulls(len(own), pa.binary())})


def _pass(texts: DataFrame, size: int, last: bool, least: int, buckets: int, maps) -> DataFrame:
    """Rows (lang, gram, n) of phrases of ``size`` words, and rows (chunk, data) of the buckets of longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None if last else Counters(buckets, least)
        yield from _merged(counted(batches, counters))
        if counters is not None:
            chunk, data = counters.chunks()
            yield _batch(pa.nulls(len(chunk), pa.string()), pa.nulls(len(chunk), pa.binary()), pa.nulls(len(chunk), pa.int64()), chunk, data)

    def counted(batches: Iterator[pa.RecordBatch], counters: Counters | None) -> Iterator[pa.RecordBatch]:
        shorter, full = maps.value if maps is not None else (None, None)
        for batch in batches:
            for lang, own in _by_language(batch):
                for chunk in _chunks(own):
                    codes, words = _words(chunk)
                    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words))[codes]
                    open_, h, before = codes != 0, _longer(np.full(len(codes), _seed(lang)), hashes), None
                    for k in range(1, size):
                        before, h = h, _longer(h[:-1], hashes[k:])
                        open_ = open_[:-1] & open_[1:]  # each phrase within a piece has both phrases within it
                    if shorter is not None:
                        sub = has(shorter, _place(before, buckets))
                        open_ = open_ & sub[:-1] & sub[1:] & has(full, _place(h, buckets))
                    if counters is not None:
                        both = np.flatnonzero(open_[:-1] & open_[1:])
                        counters.add(_place(_longer(h[both], hashes[both + size]), buckets))
                    yield _counted(lang, codes, words, np.flatnonzero(open_), size)

    return texts.mapInArrow(run, _ROWS)


def _set_bits(grams: DataFrame, buckets: int) -> DataFrame:
    """Rows (chunk, data) with a bit, as a count of one, for each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(buckets, 1)
        for batch in batches:
            h = np.zeros(batch.num_rows, dtype=np.uint64)
            for i, (lang, gram) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = _seed(lang)
                with np.errstate(over="ignore"):
                    for word in gram.split(b" "):
                        own = _longer(own, np.uint64(xxhash.xxh64_intdigest(word)))
                h[i] = own
            counters.add(_place(h, buckets))
        yield pa.RecordBatch.from_arrays(counters.chunks(), names=["chunk", "data"])

    return grams.select("lang", "gram").mapInArrow(run, "chunk int, data binary")


def buckets_for(docs: DataFrame) -> int:
    """Buckets by the size of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (size // BYTES_A_BUCKET).bit_length()))


def frequent(docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, size, n) of every phrase that occurs ``least`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs)
    texts, found, total, maps = docs.select("lang", "text"), [], None, None
    for size in range(1, max_words + 1):
        path = shared_path(spark, f"phrases-{size}")
        with arrow_batches(spark):
            _pass(texts, size, size == max_words, least, buckets, maps).write.parquet(path)
        if maps is not None:
            maps.unpersist()
        rows = spark.read.schema(_ROWS).parquet(path)
        counts = rows.where("gram IS NOT NULL")
        if size == 1:
            total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
        own = cut(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        found.append(own.select("lang", "gram", F.lit(size).alias("size"), "n"))
        if size < max_words:
            shorter = bitmap(_set_bits(own, buckets), 1, buckets)
            maps = spark.sparkContext.broadcast((shorter, bitmap(rows.where("chunk IS NOT NULL").select("chunk", "data"), least, buckets)))
    result = found[0]
    for own in found[1:]:
        result = result.unionByName(own)
    return result, total


def _part(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(words, start, n)).cast("binary")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (l * r)) in decimals: 16 digits of a, 33 of its square, 38 of all."""
    a, left, right = (x.cast("decimal(16,0)") for x in (a, left, right))
    return F.call_function("div", (a * a).cast("decimal(32,0)") * F.lit(SCALE).cast("decimal(6,0)" if SCALE < 10**6 else "decimal(7,0)"), left * right).cast("long")


def collocations(docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, inside: int = INSIDE, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    known, total = frequent(docs, least, max_words, buckets)
    split = F.split(F.col("gram").cast("string"), " ", -1)
    long = known.where("size > 1").select("lang", "gram", "size", F.col("n").alias("a"), split.alias("w"))
    # both parts of each cut; a part is frequent, as the phrase is
    asked = long.select("lang", "gram", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), _part(F.col("w"), F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("p"),
        "gram", "a", "k",
    )
    asked = asked.select("lang", F.col("p.part").alias("part"), F.col("p.side").alias("side"), "gram", "a", "k")
    sizes = asked.join(known.select("lang", F.col("gram").alias("part"), "n"), ["lang", "part"])
    cuts = sizes.groupBy("lang", "gram", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    lowest = cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("c"))
    # shorter phrases within each longer one
    inner = long.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1), lambda i: _part(F.col("w"), i, F.col("m")))).alias("gram"))
    cover = inner.groupBy("lang", "gram").agg(F.max("a").alias("longer"))
    kept = lowest.join(cover, ["lang", "gram"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = [F.col("c.score").desc(), F.col("a").desc(), F.col("gram")]
    few = kept.withColumn("_salt", F.pmod(F.xxhash64("gram"), F.lit(_SALT))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", F.col("gram").cast("string").alias("phrase"), "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
