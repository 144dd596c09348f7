"""Periodic runs of words: heavy/light lag counting, then island scans of the lags that match often enough.

A stretch of period q is an island of consecutive positions whose words equal
those q further on, so a lag can hold a run only if it has as many matches as
the shortest island: ``MIN_TIMES - 1`` periods.  Matches of all lags are counted
at once.  Words that occur at least about sqrt(n log n) times are heavy: their
indicator vectors are correlated by FFT, whose rounded sums are exact.  Those
that occur less often are light: the differences of their positions are counted
pair by pair.

A lag whose count suffices is scanned in steps of the shortest island, which hits
every island that is long enough, and hits are followed to both ends.  Matches
that multiples of a known period explain are taken off a lag's count first, so a
text of one word repeated scans one lag, and all scans together look at about
n log n positions.

Defined cases
-------------
* null, empty or blank text: no words, no runs, an empty collapsed text;
* null ids, repeated rows, ties: each row stands for itself;
* a period and its multiples: the run counts once, with its smallest period; runs may overlap;
* very long texts: whole; extra columns: not returned; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: A run has so many words and so many periods at least.
MIN_LENGTH, MIN_TIMES = 6, 4

RUN = "struct<start: long, length: long, period: long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _need(lag: np.ndarray | int) -> np.ndarray | int:
    """Positions of the shortest island that is a run of this period."""
    return np.maximum(MIN_LENGTH - lag, (MIN_TIMES - 1) * lag)


def heavy_from(n: int) -> int:
    """Occurrences from which the FFT costs less than the pairs."""
    return max(16, int((n * np.log2(n + 1)) ** 0.5))


def lag_counts(ids: np.ndarray, most: int, heavy: int | None = None) -> np.ndarray:
    """For each lag up to ``most``, how many positions hold the same word as the one so much further on."""
    n, counts = len(ids), np.zeros(most + 1, dtype=np.int64)
    often = np.bincount(ids)
    rank = heavy_from(n) if heavy is None else heavy
    light = np.flatnonzero((often[ids] < rank) & (often[ids] > 1))
    at_word = light[np.argsort(ids[light], kind="stable")]
    word, at, ahead = ids[at_word], np.arange(len(at_word)), 1
    while len(at := at[at + ahead < len(at_word)]) and len(at := at[word[at + ahead] == word[at]]):
        apart = at_word[at + ahead] - at_word[at]
        at, apart = at[apart <= most], apart[apart <= most]  # the word's later places are further away
        np.add.at(counts, apart, 1)
        ahead += 1
    frequent = np.flatnonzero(often >= rank)
    if len(frequent):
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for w in frequent:
            spectrum = np.fft.rfft(ids == w, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return counts


def _end(ids: np.ndarray, lag: int, i: int) -> int:
    """The first position from i on that does not match at the lag."""
    last, step = len(ids) - lag, 16
    while i < last:
        to = min(i + step, last)
        differ = ids[i:to] != ids[i + lag : to + lag]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = to, 2 * step
    return last


def _begin(ids: np.ndarray, lag: int, i: int) -> int:
    """The first position of the island that i is in."""
    step = 16
    while i > 0:
        to = max(i - step, 0)
        differ = (ids[to:i] != ids[to + lag : i + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, step = to, 2 * step
    return 0


def _islands(ids: np.ndarray, lag: int, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the islands that are long enough and in no known run whose period divides the lag."""
    last = len(ids) - lag

    def same(at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < last)
        at = np.where(inside, at, 0)
        return inside & (ids[at] == ids[at + lag])

    hits = np.arange(0, last, int(_need(lag)))
    hits = hits[same(hits)]
    hits = hits[same(hits + 1) & same(hits + 2) | same(hits - 1) & same(hits - 2)]  # five in a row at least
    for start, length, _ in known:
        hits = hits[(hits < start) | (hits + lag >= start + length)]
    done = -1
    for i in hits.tolist():
        if i > done:
            first, done = _begin(ids, lag, i), _end(ids, lag, i)
            if done - first >= _need(lag):
                yield first, done


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    most = len(ids) // MIN_TIMES
    if len(ids) < MIN_LENGTH or most == 0:
        return []
    counts, found, longer = lag_counts(ids, most), [], []
    lags = np.arange(most + 1)
    for lag in np.flatnonzero((counts >= _need(lags)) & (lags > 0)).tolist():
        longer = [r for r in longer if r[1] > lag]
        known = [r for r in longer if lag % r[2] == 0]
        if counts[lag] - sum(r[1] - lag for r in known) >= _need(lag):
            own = [(first, end - first + lag, lag) for first, end in _islands(ids, lag, known)]
            found += own
            longer += own
    return sorted(found, key=lambda r: (r[0], r[2]))


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; of equals the first, then the one of the least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def detect(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), best (the run of most periods) and the collapsed text of every row.

    ``edit`` may change a row's words before they are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, best, texts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()  # of bytes: ASCII white space only
                words = edit(doc_id, words) if edit is not None else words
                own = runs_of(pa.array(words, type=pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)) if words else []
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                best.append(dict(zip(("start", "length", "period"), highest(own), strict=True)) if own else None)
                texts.append(collapsed(words, own))
            made = [pa.array(sizes, type=pa.int64()), pa.array(runs, type=pa.list_(_RUN)), pa.array(best, type=_RUN), pa.array(texts, type=pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")
