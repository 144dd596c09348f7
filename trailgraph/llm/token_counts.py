"""Token counts kept as delta-maintained rollups.

Every change is a signed row: an insert adds a document's count, a delete
takes away what the log holds for the document, a revision does both.  Totals
by source, language and tokenizer version are sums over signed rows, so a
batch only ever adds its own delta.  A batch is written under its id (log,
then delta, then a ledger entry); writing it again replaces the same files,
and a batch in the ledger is never applied twice.

Inside a batch, an id that is only inserted keeps all its inserts.  Where it is
revised or deleted too, what earlier batches hold of it goes, and its last
change alone decides: a deletion leaves nothing, any other one document with
that row's text.  The last change is the one of the highest ``seq`` (a column
that changes may have), then by kind (insert, revise, delete), then by hash.

The log is partitioned by a hash of the id, so that a deletion reads the parts
of its ids alone.  ``compact`` folds all batches into one, which covers them:
their ids stay known, their files are read no more.

All files lie in one folder that driver and executors share, written and read
by Spark alone.

Defined cases
-------------
* null or empty text: a document of 0 tokens; null source or language: a group of its own;
* null id: counted by inserts and revisions; it cannot be deleted;
* repeated rows: each insert counts, a repeated revision or deletion counts once; a delete takes away all that its id holds; deleting an unknown id does nothing; unknown kinds of change do nothing;
* empty batch: committed, without effect; empty rollup: no totals;
* very long text: encoded whole; extra columns: not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

INSERT, DELETE, REVISE = "insert", "delete", "revise"
_GROUP = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
_LOG = f"doc_id long, {_DELTA}, bucket int"
#: Parts of the log of a batch.
BUCKETS = 64
#: What the ids of folded batches start with.
_FOLDED = "folded-"

_encodings: dict = {}


def load_vocabulary(name: str, folder: str = TOKENIZERS) -> bytes:
    """A vocabulary file's bytes, read by the driver; its size is that of the tokenizer, not of the data."""
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return file.read()


def encoding(name: str, data: bytes):
    """The tokenizer, built once for each worker process."""
    key = (name, len(data), hash(data))
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encodings[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def count_tokens(docs: DataFrame, vocabularies: dict[str, bytes]) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: a row for each row of ``docs`` and each tokenizer version."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for name, data in shared.value.items():
                encode = encoding(name, data).encode_ordinary
                counts = pa.array([len(encode(t)) if t else 0 for t in texts], type=pa.int64())
                names = pa.array([name] * len(texts), type=pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], names, counts], names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return own.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def _netted(changes: DataFrame) -> DataFrame:
    """The changes that count: all inserts of ids that are only inserted, and of other ids the last change (an insert after a deletion as a revision)."""
    seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
    known = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", seq.alias("seq"))
    known = known.where(F.col("op").isin(INSERT, REVISE) | ((F.col("op") == DELETE) & F.col("doc_id").isNotNull()))
    touched = known.where(F.col("op").isin(DELETE, REVISE) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    plain = known.where(F.col("op") == INSERT).join(touched, "doc_id", "left_anti").select("op", "doc_id", "text", "source", "lang")
    nameless = known.where((F.col("op") == REVISE) & F.col("doc_id").isNull()).select(F.lit(INSERT).alias("op"), "doc_id", "text", "source", "lang")
    kind = F.when(F.col("op") == DELETE, 2).when(F.col("op") == REVISE, 1).otherwise(0)
    order = F.struct(F.coalesce("seq", F.lit(-(1 << 63))), kind, F.xxhash64("text", "source", "lang"))
    last = known.join(touched, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct("op", "text", "source", "lang"), order).alias("c"))
    decided = last.select(F.when(F.col("c.op") == DELETE, DELETE).otherwise(REVISE).alias("op"), "doc_id", "c.text", "c.source", "c.lang")
    return plain.unionByName(nameless).unionByName(decided)


class Rollup:
    """Totals that batches of changes maintain; ``root`` is a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, vocabularies: dict[str, bytes]) -> None:
        self.spark, self.root, self.vocabularies = spark, root.rstrip("/"), vocabularies

    def _ledger(self) -> list[tuple[str, list[str]]]:
        """The batches that count, each with those that it covers: a short row for each."""
        try:
            rows = self.spark.read.schema("batch_id string, covers array<string>").parquet(f"{self.root}/ledger/*").collect()
        except AnalysisException:  # no ledger yet
            return []
        covered = {c for r in rows for c in r["covers"]}
        return sorted((r["batch_id"], sorted(r["covers"])) for r in rows if r["batch_id"] not in covered)

    def committed(self) -> list[str]:
        """Ids of all batches that were committed."""
        own = self._ledger()
        return sorted(b for b in {x for b, covers in own for x in (b, *covers)} if not b.startswith(_FOLDED))

    def _read(self, kind: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{kind}/batch={b}" for b in batches)).select(*(f.split(" ")[0] for f in schema.split(", ")))

    def _write(self, batch_id: str, log: DataFrame, covers: list[str]) -> None:
        """Log, then delta, then ledger; what is there already under that id is replaced."""
        path = f"batch={batch_id}"
        placed = log.select("doc_id", *_GROUP, "docs", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/log/{path}")
        own = self._read("log", _LOG, [batch_id])
        own.groupBy(*_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/delta/{path}")
        entry = self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.array(*map(F.lit, covers)).cast("array<string>").alias("covers"))
        entry.write.mode("overwrite").parquet(f"{self.root}/ledger/{path}")

    def _held(self, log: DataFrame) -> DataFrame:
        """What the log holds of each document, without what adds up to nothing."""
        held = log.groupBy("doc_id", *_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return held.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, text, source, lang, maybe seq) once; False if the batch was there already."""
        if batch_id.startswith(_FOLDED):
            raise ValueError(f"ids that start with {_FOLDED} are those of folded batches")
        if batch_id in self.committed():
            return False
        changes = _netted(changes)
        log = count_tokens(changes.where(F.col("op") != DELETE), self.vocabularies).withColumn("docs", F.lit(1).cast("long"))
        gone = cut(changes.where(F.col("op").isin(DELETE, REVISE) & F.col("doc_id").isNotNull()).select("doc_id").distinct())
        buckets = [r[0] for r in gone.select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        if buckets:
            before = self._read("log", _LOG, [b for b, _ in self._ledger()]).where(F.col("bucket").isin(buckets))
            back = self._held(before.join(gone, "doc_id", "left_semi")).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})
            log = log.unionByName(back)
        self._write(batch_id, log, [])
        return True

    def compact(self) -> None:
        """Fold all batches into one that covers them; totals and what is known stay the same."""
        own = self._ledger()
        if len(own) > 1:
            known = self.committed()
            self._write(f"{_FOLDED}{len(known)}", self._held(self._read("log", _LOG, [b for b, _ in own])), sorted({*known, *(b for b, _ in own)}))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, from the deltas alone; groups that became empty are left out."""
        deltas = self._read("delta", _DELTA, [b for b, _ in self._ledger()])
        return deltas.groupBy(*_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where((F.col("docs") != 0) | (F.col("tokens") != 0))
