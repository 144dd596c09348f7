"""Sharding over fixed virtual slots.

Records are hashed, by id and text, into a fixed, large number of virtual
slots; bytes are summed per slot; a small versioned map, which is stored, says
which shard owns each slot.  Rebalancing edits the map, so only the records of
the edited slots move.

Records that agree in id and text would all fall into one slot.  Where they
hold more than an even share of a slot, their row number joins the hash, which
spreads them; there can be no more such groups than slots.

Defined cases
-------------
* null text: no bytes, so its size is the record overhead; its CRC is that of the empty string;
* null id: hashed as the word ``null`` with its text;
* repeated ids: spread by their texts; equal texts under different ids: spread by id;
* rows that agree in both: one slot, unless they are too many for one (see above); their order inside a slot is by size, CRC;
* empty table: empty result; every slot has an owner all the same;
* very long text: one record is never split, so one record may outweigh a shard's share;
* extra columns, with whatever names: never read by ``assign``; ``attach`` keeps them, and adds or replaces ``virtual_slot`` and ``shard``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

VIRTUAL_SLOTS = 8192
RECORD_OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each virtual slot; ``owner`` has one entry for each slot."""

    version: int
    n_shards: int
    owner: tuple[int, ...]

    def loads(self, slot_bytes: dict[int, int]) -> list[int]:
        total = [0] * self.n_shards
        for slot, size in slot_bytes.items():
            total[self.owner[slot]] += size
        return total


def pack(slot_bytes: dict[int, int], n_shards: int, n_slots: int = VIRTUAL_SLOTS, version: int = 1) -> SlotMap:
    """First map: the heaviest slot goes to the lightest shard, again and again; empty slots are dealt in turn."""
    heap = [(0, shard) for shard in range(n_shards)]
    owner = [slot % n_shards for slot in range(n_slots)]
    for slot in sorted(slot_bytes, key=lambda s: (-slot_bytes[s], s)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + slot_bytes[slot], shard))
    return SlotMap(version, n_shards, tuple(owner))


def rebalance(old: SlotMap, slot_bytes: dict[int, int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots leave the heaviest shard for the lightest until loads are within ``tolerance`` of the mean, or no move helps."""
    n_shards = n_shards or old.n_shards
    if n_shards < old.n_shards:
        raise ValueError("a map can only grow or keep its number of shards")
    owner = list(old.owner)
    slots: list[list[int]] = [[] for _ in range(n_shards)]
    loads = [0] * n_shards
    for slot, shard in enumerate(owner):
        if slot_bytes.get(slot, 0):
            slots[shard].append(slot)
            loads[shard] += slot_bytes[slot]
    mean = sum(loads) / n_shards
    while True:
        high = max(range(n_shards), key=lambda s: (loads[s], -s))
        low = min(range(n_shards), key=lambda s: (loads[s], s))
        gap = loads[high] - loads[low]
        fits = [s for s in slots[high] if slot_bytes[s] < gap]
        if loads[high] <= mean * (1 + tolerance) and loads[low] >= mean * (1 - tolerance) or not fits:
            return SlotMap(old.version + 1, n_shards, tuple(owner))
        slot = min(fits, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
        slots[high].remove(slot)
        slots[low].append(slot)
        loads[high] -= slot_bytes[slot]
        loads[low] += slot_bytes[slot]
        owner[slot] = low


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add this version to the stored maps; writing a version again replaces it."""
    rows = spark.range(1).select(
        F.lit(slot_map.n_shards).alias("n_shards"),
        F.posexplode(_literal(slot_map.owner, "int")).alias("slot", "shard"),
    )
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest by default.  A map has a fixed number of rows."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    rows = maps.where(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def _literal(values, kind: str) -> Column:
    """A constant array; ``split`` of a literal is folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def record_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hash and number of each row; the text goes no further."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        record_hash(F.col("doc_id"), text).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )


def crowded(rows: DataFrame, n_slots: int = VIRTUAL_SLOTS) -> list[int]:
    """Hashes of several rows that together hold more than an even share of a slot: at most as many as there are slots."""
    own = rows.groupBy("_hash").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    return sorted(r[0] for r in own.where((F.col("n") > 1) & (F.col("bytes") > total / n_slots)).select("_hash").collect())


def virtual_slot(record: Column, row: Column, hot: list[int], n_slots: int = VIRTUAL_SLOTS) -> Column:
    """The slot of a record; rows of ``hot`` hashes are spread by their number."""
    alone = F.pmod(record, F.lit(n_slots))
    if not hot:
        return alone.cast("int")
    buckets: list[list[int]] = [[] for _ in range(2 * len(hot))]
    for h in hot:
        buckets[h % len(buckets)].append(h)
    table = F.from_json(F.lit(str(buckets)), "array<array<bigint>>")
    is_hot = F.array_contains(F.get(table, F.pmod(record, F.lit(len(buckets))).cast("int")), record)
    return F.when(is_hot, F.pmod(F.xxhash64(record, row), F.lit(n_slots))).otherwise(alone).cast("int")


def slot_totals(rows: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows for each virtual slot: as many rows as there are slots at most."""
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r[0]: r[1] for r in totals}, {r[0]: r[2] for r in totals}


def current_map(spark: SparkSession, slot_bytes: dict[int, int], n_shards: int, n_slots: int = VIRTUAL_SLOTS, path: str | None = None) -> SlotMap:
    """The map to place by.

    With a ``path``: its latest version, edited for ``slot_bytes`` where loads
    have drifted apart or shards have come, and then stored as the next one;
    where nothing is stored yet, a first version is packed and stored.
    """
    if path is None:
        return pack(slot_bytes, n_shards, n_slots)
    try:
        old = load_map(spark, path)
    except AnalysisException:  # none stored yet
        save_map(spark, pack(slot_bytes, n_shards, n_slots), path)
        old = load_map(spark, path)
    new = rebalance(old, slot_bytes, n_shards)
    if (new.owner, new.n_shards) == (old.owner, old.n_shards):
        return old
    save_map(spark, new, path)
    return new


def assign(docs: DataFrame, n_shards: int = 24, slot_map: SlotMap | None = None, n_slots: int = VIRTUAL_SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Shard and gapless position of every row, by ``slot_map`` or else the map stored at ``path``.

    The position is the slot's offset in its shard plus the row's number in
    its slot, so no task ever orders a whole shard.
    """
    rows = cut(records(docs))
    rows = rows.withColumn("virtual_slot", virtual_slot(F.col("_hash"), F.col("_row"), crowded(rows, n_slots), n_slots))
    slot_bytes, slot_rows = slot_totals(rows)
    slot_map = slot_map or current_map(docs.sparkSession, slot_bytes, n_shards, n_slots, path)
    offset, filled = [0] * n_slots, [0] * slot_map.n_shards
    for slot, shard in enumerate(slot_map.owner):
        offset[slot] = filled[shard]
        filled[shard] += slot_rows.get(slot, 0)
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("_n", F.row_number().over(place)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.get(_literal(slot_map.owner, "int"), F.col("virtual_slot")).alias("shard"),
        (F.get(_literal(offset, "long"), F.col("virtual_slot")) + F.col("_n") - 1).alias("slot"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )
    return placed, slot_map


def attach(docs: DataFrame, n_shards: int = 24, slot_map: SlotMap | None = None, n_slots: int = VIRTUAL_SLOTS, path: str | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``virtual_slot`` added (replaced, where such columns exist); no shuffle of texts."""
    rows = cut(records(docs))
    hot = crowded(rows, n_slots)
    if slot_map is None:
        rows = rows.withColumn("virtual_slot", virtual_slot(F.col("_hash"), F.col("_row"), hot, n_slots))
        slot_map = current_map(docs.sparkSession, slot_totals(rows)[0], n_shards, n_slots, path)
    row = fresh(docs, "_row")[0]
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    slot = virtual_slot(record_hash(F.col("doc_id"), F.col("text")), F.col(row), hot, n_slots)
    return numbered.withColumn("virtual_slot", slot).withColumn("shard", F.get(_literal(slot_map.owner, "int"), F.col("virtual_slot"))).drop(row)
