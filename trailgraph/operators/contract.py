"""Contraction of chains of pass-through nodes by pointer doubling.

A node is passed through if it has exactly two distinct neighbours.  A state
is a half-edge (a, b); if b is passed through, its successor is (b, c) with c
the other neighbour.  Each round doubles the reach of every pointer, so a
chain of n segments takes log2 n rounds, each materialised; no path is walked
edge by edge and no chain is ever in one task.

Where several chains join the same pair of ends, only the one with the lowest
interior node is contracted.  A chain that can be travelled in neither
direction stays as it is, so that connectivity is never lost; pure cycles
have no ends and stay too; a chain back to its start becomes a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import dense_ids, materialise
from .ways import Graph, numbered_edges, undirected_degrees


def first_edges(edges: DataFrame) -> DataFrame:
    """The lowest edge of each (src, dst)."""
    return edges.groupBy("src", "dst").agg(F.min_by(F.struct("edge_id", "cost", "length_m", "flags", "scenic_score"), "edge_id").alias("e")).select("src", "dst", "e.*")


def chain_walks(edges: DataFrame) -> DataFrame:
    """a, b, pos, first_a, first_b, last_a, last_b for every step of every directed walk between chain ends.

    (first_a, first_b) is the walk's first half-edge and (last_a, last_b) its
    last; pos counts steps from 0.
    """
    half = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    half = materialise(half)
    through = materialise(undirected_degrees(edges).where("degree = 2").select("node_id"))
    # half-edges that touch a pass-through node, with marks on both sides
    marked = (
        half.join(through.select(F.col("node_id").alias("a"), F.lit(True).alias("a_in")), "a", "left")
        .join(through.select(F.col("node_id").alias("b"), F.lit(True).alias("b_in")), "b", "left")
        .select("a", "b", F.coalesce("a_in", F.lit(False)).alias("a_in"), F.coalesce("b_in", F.lit(False)).alias("b_in"))
        .where("a_in or b_in")
    )
    marked = materialise(marked)
    following = marked.where("a_in").select(F.col("a").alias("n_a"), F.col("b").alias("n_b"))
    successor = marked.where("b_in").join(following, (F.col("b") == F.col("n_a")) & (F.col("n_b") != F.col("a"))).select("a", "b", "n_a", "n_b")
    # a pointer ahead (to), the number of steps it spans, and whether it has reached the last half-edge
    state = marked.join(successor, ["a", "b"], "left").select(
        "a", "b", "a_in", F.coalesce("n_a", "a").alias("to_a"), F.coalesce("n_b", "b").alias("to_b"),
        F.when(F.col("n_a").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("n_a").isNull().alias("done"),
    )
    state = materialise(state)
    open_before = None
    while True:
        left = state.where(~F.col("done")).count()
        if left in (0, open_before):  # what stays open when the reach doubles without effect lies on pure cycles
            break
        open_before = left
        ahead = state.select(F.col("a").alias("x_a"), F.col("b").alias("x_b"), F.col("to_a").alias("y_a"), F.col("to_b").alias("y_b"), F.col("steps").alias("more"), F.col("done").alias("end"))
        moved = state.where(~F.col("done")).join(ahead, (F.col("to_a") == F.col("x_a")) & (F.col("to_b") == F.col("x_b")))
        moved = moved.select("a", "b", "a_in", F.col("y_a").alias("to_a"), F.col("y_b").alias("to_b"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("done"))
        state = materialise(state.where("done").unionByName(moved))
    reached = state.where("done")
    starts = reached.where(~F.col("a_in") & (F.col("steps") > 0)).select(F.col("to_a").alias("last_a"), F.col("to_b").alias("last_b"), F.col("a").alias("first_a"), F.col("b").alias("first_b"), F.col("steps").alias("length"))
    steps = reached.withColumnsRenamed({"to_a": "last_a", "to_b": "last_b"}).join(starts, ["last_a", "last_b"])
    return steps.select("a", "b", (F.col("length") - F.col("steps")).alias("pos"), "first_a", "first_b", "last_a", "last_b")


def chains(graph: Graph) -> DataFrame:
    """The chosen chains, a row for each direction of travel that exists: ends, cost, length, flags, score, interior nodes in order."""
    walks = materialise(chain_walks(graph.edges))
    priced = walks.join(first_edges(graph.edges).withColumnsRenamed({"src": "a", "dst": "b"}), ["a", "b"], "left")
    each = priced.groupBy("first_a", "first_b", "last_a", "last_b").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("edge_id").alias("n_known"),
        F.sum("cost").alias("cost"),
        F.sum("length_m").alias("length_m"),
        F.expr("bit_or(flags)").alias("flags"),
        F.max("scenic_score").alias("scenic_score"),
        F.min(F.when(F.col("pos") > 0, F.col("a"))).alias("lowest"),
        F.max(F.when(F.col("pos") > 0, F.col("a"))).alias("highest"),
        F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", F.col("a").alias("node"))))).alias("inner"),
    )
    each = each.select(
        F.col("first_a").alias("src"), F.col("last_b").alias("dst"), "cost", "length_m", "flags", "scenic_score", "lowest", "first_b",
        F.transform("inner", lambda x: x["node"]).alias("interior"), (F.col("n") == F.col("n_known")).alias("open"),
        F.least("first_a", "last_b").alias("end_1"), F.greatest("first_a", "last_b").alias("end_2"),
    )
    each = materialise(each)
    usable = each.groupBy("end_1", "end_2", "lowest").agg(F.max("open").alias("any_open")).where("any_open")
    chosen = usable.groupBy("end_1", "end_2").agg(F.min("lowest").alias("lowest"))
    return each.join(chosen, ["end_1", "end_2", "lowest"]).where("open").drop("end_1", "end_2", "open")


def contract(graph: Graph) -> Graph:
    """The graph with chosen chains as single edges; nodes and edges are numbered anew, in the old order."""
    found = materialise(chains(graph))
    consumed = found.select(F.explode("interior").alias("node_id")).distinct()
    kept = dense_ids(graph.nodes.join(consumed, "node_id", "left_anti"), [F.col("node_id")], "new_id")
    kept = materialise(kept)
    points = graph.nodes.select("node_id", F.struct("lat_e7", "lon_e7").alias("point"))
    shape = (
        found.select("src", "dst", "first_b", "lowest", F.posexplode("interior").alias("pos", "node_id"))
        .join(points, "node_id")
        .groupBy("src", "dst", "first_b", "lowest")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "point"))).alias("l"))
        .select("src", "dst", "first_b", "lowest", F.transform("l", lambda x: x["point"]).alias("polyline"))
    )
    merged = found.join(shape, ["src", "dst", "first_b", "lowest"]).select(
        "src", "dst", F.col("cost").cast("float").alias("cost"), F.col("length_m").cast("float").alias("length_m"), "flags", "scenic_score", "polyline", F.lit(-1).cast("long").alias("old"), F.col("first_b").alias("tie")
    )
    gone = consumed.withColumnRenamed("node_id", "src")
    plain = graph.edges.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti")
    plain = plain.select("src", "dst", "cost", "length_m", "flags", "scenic_score", "polyline", F.col("edge_id").alias("old"), F.lit(0).cast("long").alias("tie"))
    every = merged.unionByName(plain)
    renumbered = every.join(kept.select(F.col("node_id").alias("src"), F.col("new_id").alias("s")), "src").join(kept.select(F.col("node_id").alias("dst"), F.col("new_id").alias("d")), "dst")
    renumbered = renumbered.select(F.col("s").alias("src"), F.col("d").alias("dst"), "cost", "length_m", "flags", "scenic_score", "polyline", "old", "tie")
    edges = numbered_edges(renumbered, [F.col("old"), F.col("tie")])
    nodes = kept.select(F.col("new_id").alias("node_id"), "lat_e7", "lon_e7")
    return Graph(nodes, edges.select("edge_id", "src", "dst", "cost", "length_m", "flags", "scenic_score", "polyline"), graph.fuel_stations)
