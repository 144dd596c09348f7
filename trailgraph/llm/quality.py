"""Quality classifier: a factorisation machine over hashed words, structure statistics and size metadata.

Pairwise interactions have low rank: feature i has a factor v_i, and the pair
(i, j) weighs <v_i, v_j>.  The sum over all pairs is taken in linear time by
the sum-of-squares identity, half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2.

The machine is fitted in the driver on a bounded number of labelled rows
(``MAX_TRAIN``, chosen by a hash of the id); everything else reads all rows.

Defined cases
-------------
* null or empty text: features of an empty text, and a score like any other;
* null id: never in the training set, never held out; no label, conflicting labels (a mean of one half) or null labels: not used;
* repeated rows and ties: scored alike; of a labelled id with several texts, the one of the least hash is learned from; empty table or no labels of one kind: the score is the labels' mean, one half without any;
* very long text: whole;
* extra columns, with whatever names: ``score`` returns its own columns only, ``accept`` keeps all.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, small_batches

#: Hash space of words; structure statistics follow behind it.
WORD_SPACE = 1 << 14
RANK = 8
#: Labelled rows that the machine is fitted on at most.
MAX_TRAIN = 8000
FOLDS, HELD_OUT = 3, 1
SEED = 7

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_BLANK = b" \t\n\r\x0b\x0c"
_MARKS = b".,;:'\"-()?"
_LINE = re.compile(rb"[^\n]*\S[^\n]*")
N_STATS = 20


def features(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a text's features."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    size = max(1, len(data))
    words = data.split()
    n = max(1, len(words))
    counts = Counter(data.lower().split())
    lines = _LINE.findall(data)

    def share(chars: bytes) -> float:
        return (len(data) - len(data.translate(None, chars))) / size

    upper, lower, digit, blank, marks = (share(c) for c in (_UPPER, _LOWER, _DIGIT, _BLANK, _MARKS))
    other = len(data.translate(None, bytes(range(128)))) / size
    symbols = 1 - upper - lower - digit - blank - marks - other
    top = sorted(counts.values(), reverse=True)[:5]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    short = sum(len(w) <= 2 for w in words) / n
    long = sum(len(w) >= 15 for w in words) / n
    ends = Counter(w[-1:] for w in words)
    loud = sum(c for e, c in ends.items() if e and e in b"!*#$%&@^~|=+<>_") / n
    closed = sum(line.rstrip()[-1:] in b".!?" for line in lines) / max(1, len(lines))
    size_bin = np.log1p(len(words)) / 8
    stats = (
        1.0, size_bin, np.log1p(len(lines)) / 6, upper * 4, digit * 10, blank * 3, marks * 5, symbols * 8, other * 2,
        len(data) / n / 10, len(counts) / n, (top[0] if top else 0) / n * 4, sum(top) / n * 2, repeats * 5, short * 2, long * 4, loud * 4,
        closed, len(set(lines)) / max(1, len(lines)), float(len(words) < 20),
    )
    index = np.fromiter((zlib.crc32(w) % WORD_SPACE for w in counts), dtype=np.int64, count=len(counts))
    value = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    value /= max(1e-9, float(np.sqrt((value**2).sum())))
    where = np.concatenate([index, WORD_SPACE + np.arange(N_STATS)])
    return where, np.concatenate([value, np.clip(np.array(stats, dtype=np.float64), -4, 4)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        if not rows:
            return np.zeros(0)
        index, value, starts = _flat(rows)
        return _sigmoid(self.bias + _margin(self.linear, self.factors, index, value, starts)[0])


def _flat(rows):
    starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts


def _margin(linear, factors, index, value, starts):
    spread = factors[index] * value[:, None]
    total = np.add.reduceat(spread, starts)
    squares = np.add.reduceat((spread**2).sum(axis=1), starts)
    return np.add.reduceat(linear[index] * value, starts) + 0.5 * ((total**2).sum(axis=1) - squares), spread, total


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-5) -> Machine:
    """Adam on the logistic loss; the same rows in the same order give the same machine."""
    rng = np.random.default_rng(SEED)
    dims, y = WORD_SPACE + N_STATS, np.array(labels, dtype=np.float64)
    machine = Machine(0.0, np.zeros(dims), rng.normal(0, 0.05, (dims, RANK)))
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Machine(float(np.log(mean / (1 - mean))), machine.linear, np.zeros((dims, RANK)))
    theta = [machine.factors, machine.linear, np.array([np.log(y.mean() / (1 - y.mean()))])]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(order), batch):
            chosen = order[first : first + batch]
            index, value, starts = _flat([rows[i] for i in chosen])
            margin, spread, total = _margin(theta[1], theta[0], index, value, starts)
            error = (_sigmoid(theta[2][0] + margin) - y[chosen]) / len(chosen)
            row = np.repeat(np.arange(len(chosen)), np.diff(np.r_[starts, len(index)]))
            pull = error[row] * value
            grads = [
                np.stack([np.bincount(index, pull * (total[row, k] - spread[:, k]), minlength=dims) for k in range(RANK)], axis=1) + decay * theta[0],
                np.bincount(index, pull, minlength=dims) + decay * theta[1],
                np.array([error.sum()]),
            ]
            step += 1
            now = rate * (0.7**epoch)
            for t, g, mm, ss in zip(theta, grads, m, s, strict=True):
                mm += 0.1 * (g - mm)
                ss += 0.01 * (g * g - ss)
                t -= now * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-8)
    return Machine(float(theta[2][0]), theta[1], theta[0])


def fold(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on ``max_train`` labelled rows outside the held-out fold at most."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    known = known.where((fold() != HELD_OUT) & (F.col("q") != 0.5)).select(F.col("doc_id").alias("_id"), (F.col("q") > 0.5).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                names=["id", "y", "i", "v"],
            )

    # at most max_train ids: that bounds the broadcast, and the rows that are collected
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    own = own.groupBy(F.col("_id").cast("string").alias("_id"), "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = own.mapInArrow(run, "id string, y int, i binary, v binary").collect()
    got.sort(key=lambda r: (zlib.crc32(r["id"].encode()), r["id"]))
    rows = [(np.frombuffer(r["i"], dtype=np.int32).astype(np.int64), np.frombuffer(r["v"])) for r in got]
    return fit(rows, [r["y"] for r in got])


def _scores(docs: DataFrame, machine: Machine, place: int) -> DataFrame:
    """``docs`` with a column ``score``; the text is the column at ``place``."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.large_binary())
            made = [model.value.score([features(t.as_py()) for t in texts[i : i + 64]]) for i in range(0, len(texts), 64)]
            score = pa.array(np.concatenate(made) if made else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    scored = _scores(docs.select("doc_id", "text"), machine, 1)
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that the machine takes for good, with all their columns."""
    return _scores(numbered(docs), machine, docs.columns.index("text")).where(F.col("score") >= 0.5).drop("score").toDF(*docs.columns)
