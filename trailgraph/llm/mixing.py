"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the budget by its weight; a source is clamped at
``max_epochs`` times its size, and what it cannot take is dealt to the others
by weight until no source is above its clamp.  The level rises from round to
round; a round is one aggregate over the table of sources, which is never
brought into one task.

A source's target is met by whole repetitions of all its documents plus one
more of those that come first in a seeded order, a hash of id and text.  That
order is cut by hash range: sums for each (source, range) locate the range
where the target falls, and only keys of that range are ordered one by one.
Where the key at the target is that of several rows, which then agree in id and
text, rows are counted by input partition and numbered in a single one.

Defined cases
-------------
* null or empty text: size 0, never counted, repeated like its source;
* null source: a source of its own, last; null id: ordered as the word ``null``;
* repeated ids: ordered by their texts as well; rows that agree in both: in the order of the input, taken one by one;
* empty table: empty result; a source of size 0 has target 0;
* very long text: the cut is made where the row's middle passes the target, so the miss is half a row at most;
* extra columns, with whatever names: ``plan`` reads none; ``mix`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import dense_ids
from .common import WORD, cut, fresh, own_columns

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 17
#: The seeded hash has 60 bits; its upper 12 give the range.
RANGE_SHIFT = 48
#: A row's number has its input partition in the bits from here on.
PART_SHIFT = 33
#: Up to here a table with a row for each source is broadcast.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def level(sources: DataFrame, budget: float) -> float:
    """What a weight of one gets of the budget, from (source_size, cap, weight) rows: clamped sources give their cap, the others share the rest."""
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    reached, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(reached) > F.col("cap")
        row = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if row[0] == clamped or not row[2]:
            return reached
        clamped, reached = row[0], max(0.0, total - (row[1] or 0)) / row[2]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> target.  One row for each source in and out."""
    turn = F.pmod(F.col("_turn"), F.lit(len(weights))).cast("int")
    dealt = dense_ids(sizes, [F.col("source").asc_nulls_last()], "_turn").select("source", "source_size", F.get(F.array(*map(F.lit, weights)), turn).alias("weight"))
    capped = cut(dealt.withColumn("cap", F.col("source_size") * F.lit(max_epochs)))
    reached = level(capped, budget)
    return capped.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(reached) * F.col("weight")).alias("target"))


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, size, _order, _row) rows, one row for each source: its target, whole repetitions, and the last (_order, size, _row) that is taken once more.

    Rows before range ``_cut`` are taken once more, rows of that range up to
    ``_last``, and no later ones.
    """
    rows = rows.withColumn("_range", F.shiftright("_order", RANGE_SHIFT))
    up_to = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = cut(rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum")).withColumn("_end", F.sum("_sum").over(up_to)))
    goal = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, budget, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("_whole", F.floor(epochs)).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    goal = goal.withColumnRenamed("source", "_s")
    located = (
        ranges.withColumnRenamed("source", "_r")
        .join(goal.select("_s", "_need"), F.col("_r").eqNullSafe(F.col("_s")))
        .where(F.col("_end") >= F.col("_need"))
        .groupBy("_r")
        .agg(F.min("_range").alias("_cut"), F.min_by(F.col("_end") - F.col("_sum"), "_range").alias("_before"))
    )
    goal = cut(goal.join(located, F.col("_s").eqNullSafe(F.col("_r")), "left").drop("_r"))
    at_cut = rows.join(small(goal), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_cut")))
    keys = at_cut.groupBy("_s", "_before", "_need", "_order", "size").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("_s").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("_n") * F.col("size")
    placed = keys.withColumn("_from", F.col("_before") + F.sum(own).over(inside) - own)
    # of equal rows, those whose middle comes before the target
    fit = F.greatest(F.lit(0), F.least(F.col("_n"), F.ceil((F.col("_need") - F.col("_from")) / F.greatest(F.lit(1), "size") - 0.5)))
    taken = placed.withColumn("_take", F.when(F.col("size") > 0, fit).otherwise(F.when(F.col("_from") < F.col("_need"), F.col("_n")).otherwise(F.lit(0))))
    last = cut(taken.where("_take > 0").groupBy("_s").agg(F.max(F.struct("_order", "size", "_take", "_n")).alias("_l")).select(F.col("_s").alias("_p"), "_l.*"))
    split = last.where("_take < _n")
    bounds = last.select("_p", "_order", "size", F.lit((1 << 63) - 1).alias("_row")).where(F.col("_take") == F.col("_n"))
    bounds = bounds.unionByName(_within(rows, split)).select(F.col("_p").alias("_b"), F.struct("_order", "size", "_row").alias("_last"))
    return cut(goal.join(bounds, F.col("_s").eqNullSafe(F.col("_b")), "left").drop("_b", "_before"))


def _within(rows: DataFrame, split: DataFrame) -> DataFrame:
    """The last row taken of each group of equal rows that is taken in part: counts by input partition find the partition, and only its rows are numbered."""
    key = split.select("_p", F.col("_order").alias("_o"), F.col("size").alias("_z"), "_take")
    same = F.col("source").eqNullSafe(F.col("_p")) & (F.col("_order") == F.col("_o")) & (F.col("size") == F.col("_z"))
    hit = cut(rows.join(small(key), same).select("_p", "_order", "size", "_take", "_row", F.shiftright("_row", PART_SHIFT).alias("_part")))
    counts = hit.groupBy("_p", "_take", "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_p").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("_end", F.sum("_n").over(upto)).where("_end >= _take").groupBy("_p").agg(F.min(F.struct("_part", (F.col("_end") - F.col("_n")).alias("_behind"))).alias("f"))
    found = found.select(F.col("_p").alias("_q"), F.col("f._part").alias("_at"), F.col("f._behind").alias("_behind"))
    number = F.row_number().over(Window.partitionBy("_p").orderBy("_row"))
    there = hit.join(small(found), F.col("_p").eqNullSafe(F.col("_q")) & (F.col("_part") == F.col("_at"))).withColumn("_k", number + F.col("_behind"))
    return there.where("_k <= _take").groupBy("_p", "_order", "size").agg(F.max("_row").alias("_row"))


def small(goal: DataFrame) -> DataFrame:
    """Broadcast a (materialised) table with a row for each source only while it is small; else Spark's skew join deals with hot sources."""
    return F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    size, order = words(F.col("text")), seeded(F.col("doc_id"), F.col("text"), seed)
    return docs.select("doc_id", "source", size.alias("size"), order.alias("_order"), F.monotonically_increasing_id().alias("_row"))


def _copies(order: Column, size: Column, row: Column, goal: Column) -> Column:
    """Repetitions of a row, given ``goal``: the columns of ``cuts`` as a struct."""
    key, place = F.struct(order.alias("_order"), size.alias("size"), row.alias("_row")), F.shiftright(order, RANGE_SHIFT)
    more = (place < goal["_cut"]) | ((place == goal["_cut"]) & (key <= goal["_last"]))
    return (goal["_whole"] + F.coalesce(more & (goal["_need"] > 0), F.lit(False)).cast("long")).cast("long")


_GOAL = ("_whole", "_need", "_cut", "_last")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``."""
    rows = cut(_narrow(docs, seed))
    goal = small(cuts(rows, weights, budget, max_epochs)).select("_s", "source_size", "target", F.struct(*_GOAL).alias("_goal"))
    copies = _copies(F.col("_order"), F.col("size"), F.col("_row"), F.col("_goal"))
    return rows.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; texts are never shuffled.

    ``docs`` is read twice and should come from a table: of rows that agree in
    id and text, the first ones in the order of the input are taken.
    """
    rows = cut(_narrow(docs, seed).drop("doc_id"))
    s, goal, row, copies, copy = fresh(docs, "_s", "_goal", "_row", "_copies", "_copy")
    dealt = small(cuts(rows, weights, budget, max_epochs)).select(F.col("_s").alias(s), F.struct(*_GOAL).alias(goal))
    own = _copies(seeded(F.col("doc_id"), F.col("text"), seed), words(F.col("text")), F.col(row), F.col(goal))
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(dealt, F.col("source").eqNullSafe(F.col(s)))
    repeated = joined.withColumn(copies, own).where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return repeated.select(*own_columns(docs))
