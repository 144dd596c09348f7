"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (ten consecutive words, or the whole of a shorter item) are
sets of short shingles in fixed positions.  Shingles are ordered by rarity;
for full containment the necessary prefix of a window is its rarest shingle
alone, so a document meets a window only where it has that shingle.  The
length bound (the window must fit into the document) and the positional bound
(the shingle's place fixes the window's start) leave one place to verify, and
verification compares the words of the window exactly.

Words become numbers by the vocabulary of the benchmark block; every other
word is 0 and never matches.  The benchmark is read in blocks of bounded
size; an item that is longer is cut into parts that overlap by a window less
one word.  A pass over the documents broadcasts a bounded number of blocks, and
they are released before the next pass is built; between passes each row
carries a bit for each of its words and the items found.  Nothing is shuffled.

Defined cases
-------------
* null or empty text: no words, so no hits; null or empty item: no windows;
* null item id: named ``null``; items with one id are one item; repeated rows and ties count alike;
* empty documents: empty result; empty benchmark: every document is clean;
* very long texts: whole; memory follows the longest text of a batch;
* extra columns, with whatever names: ``scan`` returns its own columns only, ``clean`` keeps all.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, small_batches

WINDOW = 10
SHINGLE = 3
#: Benchmark text that one block may hold, about, and blocks that one pass broadcasts.
BLOCK_BYTES = 4 << 20
BLOCKS_PER_PASS = 4
#: Words that one part of an item may hold; a block of up to four parts stays within the 20 bits of a word's number.
PART_WORDS = 1 << 18

#: A-Z to a-z; what is no digit, letter or byte of a non-ASCII character becomes a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_TABLE).split()


@dataclass
class Index:
    """One block of the benchmark.  By (window length, shingle length): sorted prefix shingles, and for each its window and place."""

    vocabulary: dict[bytes, int]
    groups: list[tuple] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    #: items of window w: ``items[first[w] : first[w + 1]]``, as places in ``names``
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    items: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))


def _codes(ids: np.ndarray, length: int, base: int) -> np.ndarray:
    """A number for each shingle of ``length`` words; exact while base ** length < 2 ** 63."""
    n = len(ids) - length + 1
    code = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(length):
        code = code * base + ids[k : k + len(code)]
    return code


def build_index(items: list[tuple[str, str | None]], window: int = WINDOW, shingle: int = SHINGLE) -> Index:
    index = Index({})
    windows: dict[tuple[int, ...], set[int]] = defaultdict(set)
    place_of: dict[str, int] = {}
    for name, text in items:
        number = place_of.setdefault(name, len(place_of))
        ids = [index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in words(text)]
        if ids:
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                windows[tuple(ids[i : i + size])].add(number)
    base = len(index.vocabulary) + 1
    if base**shingle >= 1 << 63:
        raise ValueError("shingles of that many words do not fit a number; use shorter ones")
    by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for w in sorted(windows):
        by_length[len(w)].append(w)
    index.names = list(place_of)
    listed: list[list[int]] = []
    for size, own in sorted(by_length.items()):
        length = min(shingle, size)
        matrix = np.array(own, dtype=np.int64)
        codes = np.stack([_codes(row, length, base) for row in matrix])
        frequency = Counter(codes.ravel().tolist())
        rarity = np.vectorize(frequency.__getitem__, otypes=[np.int64])(codes)
        place = rarity.argmin(axis=1)  # the necessary prefix: the rarest shingle, the first among equals
        prefix = codes[np.arange(len(own)), place]
        order = np.argsort(prefix, kind="stable")
        index.groups.append((size, length, prefix[order], place[order].astype(np.int32), (order + len(listed)).astype(np.int32), matrix[order].astype(np.int32)))
        listed += [sorted(windows[w]) for w in own]
    index.first = np.cumsum([0, *map(len, listed)])
    index.items = np.fromiter((i for own in listed for i in own), dtype=np.int32)
    return index


def match(index: Index, text: str | bytes | None) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, which of them are hit, and the items with occurring windows."""
    own = words(text)
    hit = np.zeros(len(own), dtype=bool)
    found: set[str] = set()
    if not own:
        return 0, hit, found
    get = index.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in own), dtype=np.int64, count=len(own))
    base = len(index.vocabulary) + 1
    codes: dict[int, np.ndarray] = {}
    for size, length, prefix, place, window, matrix in index.groups:
        if len(ids) < size:  # length bound
            continue
        if length not in codes:
            codes[length] = _codes(ids, length, base)
        code = codes[length]
        low = np.searchsorted(prefix, code, "left")
        at = np.flatnonzero((low < len(prefix)) & (prefix[np.minimum(low, len(prefix) - 1)] == code))
        if not len(at):
            continue
        counts = np.searchsorted(prefix, code[at], "right") - low[at]
        position = np.repeat(at, counts)
        entry = np.repeat(low[at], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = position - place[entry]
        fits = (start >= 0) & (start + size <= len(ids))  # positional bound
        start, entry = start[fits], entry[fits]
        for k in range(size):
            same = ids[start + k] == matrix[entry, k]
            start, entry = start[same], entry[same]
        for k in range(size):
            hit[start + k] = True
        for w in np.unique(window[entry]).tolist():
            found.update(index.names[i] for i in index.items[index.first[w] : index.first[w + 1]].tolist())
    return len(own), hit, found


def parts(text: str, window: int, part_words: int = PART_WORDS) -> Iterator[str]:
    """A text in overlapping parts that have the same windows; a short one as it is."""
    own = words(text)
    if len(own) <= part_words:
        yield text
        return
    for first in range(0, len(own), part_words):
        if first == 0 or len(own) - first >= window:
            yield b" ".join(own[first : first + part_words + window - 1]).decode("utf-8", "surrogatepass")


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, part_words: int = PART_WORDS) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size, never more than one at a time in the driver."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").where(F.col("text").isNotNull())
    block, size, n = [], 0, 0
    for name, text in rows.toLocalIterator():
        for part in parts(text, window, part_words):
            own = len(words(part))
            if block and (size >= block_bytes or n + own >= 4 * PART_WORDS - 1):
                yield block
                block, size, n = [], 0, 0
            block.append((name, part))
            size += len(part.encode("utf-8", "surrogatepass"))
            n += own
    if block:
        yield block


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_bytes: int) -> Iterator[tuple[list, bool]]:
    """Broadcast indexes by pass, and whether it is the last; at least one pass, maybe without any.  Those of a pass are released when the next one is asked for."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    ahead = blocks(benchmark, window, block_bytes)
    block = next(ahead, None)
    while True:
        shared = []
        while block is not None and len(shared) < BLOCKS_PER_PASS:
            shared.append(broadcast(build_index(block, window, shingle)))
            block = next(ahead, None)
        yield shared, block is None
        if block is None:
            return
        for index in shared:
            index.destroy()


def _marks(text: bytes | None, indexes: list) -> tuple[np.ndarray, set[str]]:
    """Which words any of the blocks hits, and the items found."""
    hit, found = None, set()
    for index in indexes:
        _, own, items = match(index.value, text)
        hit = own if hit is None else hit | own
        found |= items
    return (np.zeros(len(words(text)), dtype=bool) if hit is None else hit), found


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, "text")

    def run(indexes: list, last: bool):
        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).cast(pa.large_binary())
                made = []
                for i, text in enumerate(texts):
                    hit, found = _marks(text.as_py(), indexes)
                    if batch.num_columns > 2:  # what earlier passes have found
                        hit |= np.unpackbits(np.frombuffer(batch.column(2)[i].as_py(), dtype=np.uint8))[: len(hit)].astype(bool)
                        found.update(batch.column(3)[i].as_py())
                    made.append((len(hit), int(hit.sum()), len(found), digest(found), bool(hit.any())) if last else (np.packbits(hit).tobytes(), sorted(found)))
                fields = _RESULT if last else _STATE
                columns = list(zip(*made, strict=True)) or [[]] * len(fields)
                arrays = [pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)]
                kept = batch.columns[: 1 if last else 2]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[key, "text"][: len(kept)] + [n for n, _ in fields])

        return marked

    for indexes, last in _passes(docs, benchmark, window, shingle, block_bytes):
        if last:
            break
        rows = cut(rows.mapInArrow(run(indexes, False), f"{key} {kind}, text string, hits binary, found array<string>"))
    return rows.mapInArrow(run(indexes, True), f"{key} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_RESULT = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()))
_STATE = (("hits", pa.binary()), ("found", pa.list_(pa.string())))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a single hit word, with all their columns."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    rows = numbered(docs)

    def run(indexes: list):
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not any(match(i.value, text.as_py())[1].any() for i in indexes) for text in batch.column(place).cast(pa.large_binary())]
                yield batch.filter(pa.array(keep, type=pa.bool_()))

        return kept

    for indexes, last in _passes(docs, benchmark, window, shingle, block_bytes):
        if last:
            break
        rows = cut(rows.mapInArrow(run(indexes), rows.schema))
    return rows.mapInArrow(run(indexes), rows.schema).toDF(*docs.columns)
