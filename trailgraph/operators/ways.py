"""Ways and nodes to a costed, flagged graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import from_e7_scaled, haversine_m, in_bbox, to_e7
from ..functions.storage import dense_ids, materialise
from ..functions.tags import edge_flags, has_flag, raw_tag
from ..plans.profile import Profile
from ..schemas import FORD, POINT
from . import scenic

BBox = tuple[float, float, float, float]


@dataclass(frozen=True)
class Graph:
    """nodes, edges and fuel_stations as in ``schemas``; adjacency arrays exist inside search kernels only."""

    nodes: DataFrame
    edges: DataFrame
    fuel_stations: DataFrame | None = None


def way_order(way_id: str = "way_id") -> list[Column]:
    """Loading order: mapped ways by id, then synthetic ones (negative ids) in the order of their creation."""
    return [(F.col(way_id) < 0), F.abs(F.col(way_id))]


def needed_nodes(ways: DataFrame) -> DataFrame:
    return ways.select(F.explode("nodes").alias("osm_id")).distinct()


def needed_coordinates(nodes: DataFrame, *way_sets: DataFrame) -> DataFrame:
    """The nodes that any of the way sets refers to."""
    needed = needed_nodes(way_sets[0])
    for other in way_sets[1:]:
        needed = needed.union(needed_nodes(other)).distinct()
    return nodes.join(needed, "osm_id", "left_semi")


def fuel_stations(nodes: DataFrame) -> DataFrame:
    """Nodes (osm_id, lat, lon, tags) that sell fuel."""
    return nodes.where(raw_tag(F.col("tags"), "amenity") == "fuel").select("osm_id", to_e7(F.col("lat")).alias("lat_e7"), to_e7(F.col("lon")).alias("lon_e7"))


def derived_bbox(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def union_ways(ways: DataFrame, more: DataFrame) -> DataFrame:
    return ways.unionByName(more)


def union_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Both node sets; on a common id the second side's coordinates stay."""
    both = nodes.withColumn("_side", F.lit(0)).unionByName(more.withColumn("_side", F.lit(1)))
    return both.groupBy("osm_id").agg(F.max_by(F.struct("lat", "lon"), "_side").alias("p")).select("osm_id", "p.lat", "p.lon")


def segments(ways: DataFrame, *keep: str) -> DataFrame:
    """way_id, pos, a, b (and kept columns) of each pair of consecutive nodes."""
    n = F.size("nodes")
    pairs = F.arrays_zip(F.slice("nodes", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("nodes", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return ways.where(n >= 2).select("way_id", *keep, F.posexplode(pairs).alias("pos", "pair")).select("way_id", *keep, "pos", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))


def segments_by_window(way_nodes: DataFrame) -> DataFrame:
    """The same pairs from exploded rows (way_id, pos, osm_id)."""
    following = F.lead("osm_id").over(Window.partitionBy("way_id").orderBy("pos"))
    return way_nodes.select("way_id", "pos", F.col("osm_id").alias("a"), following.alias("b")).where("b is not null")


def graph_nodes(ways: DataFrame, nodes: DataFrame, bbox: BBox | None = None) -> DataFrame:
    """node_id, osm_id, lat_e7, lon_e7: ids from 0 in the order in which ways first meet the nodes.

    Nodes of ways that are dropped later (private ones) count too.
    """
    met = ways.select(*(c.alias(f"o{i}") for i, c in enumerate(way_order())), F.posexplode("nodes").alias("pos", "osm_id"))
    first = met.groupBy("osm_id").agg(F.min(F.struct("o0", "o1", "pos")).alias("first"))
    places = nodes.select("osm_id", "lat", "lon")
    if bbox is not None:
        places = places.where(in_bbox(F.col("lat"), F.col("lon"), bbox))
    known = first.join(places, "osm_id").select("osm_id", "first", to_e7(F.col("lat")).alias("lat_e7"), to_e7(F.col("lon")).alias("lon_e7"))
    return dense_ids(known, [F.col("first")], "node_id").select("node_id", "osm_id", "lat_e7", "lon_e7")


def costed_ways(ways: DataFrame, profile: Profile, keep_private: bool = False) -> DataFrame:
    """Ways with flags, one-way mark and cost factors, worked out once for each way."""
    tags = F.col("tags")
    if not keep_private:
        ways = ways.where(~F.coalesce(raw_tag(tags, "access") == "private", F.lit(False)))
    flags = edge_flags(tags, profile.routing)
    return ways.select(
        "way_id",
        "nodes",
        F.coalesce(raw_tag(tags, "oneway") == "yes", F.lit(False)).alias("oneway"),
        flags.alias("flags"),
        *(profile.factor(table, F.coalesce(raw_tag(tags, key), F.lit(""))).alias(f"f_{table}") for table, key in (("base", "highway"), ("surface", "surface"), ("tracktype", "tracktype"), ("smoothness", "smoothness"))),
        F.when(has_flag(flags, FORD), F.lit(profile.routing.ford_penalty)).otherwise(F.lit(1.0)).cast("float").alias("f_ford"),
    )


def costed_segments(ways: DataFrame, located: DataFrame, profile: Profile, features: DataFrame | None = None, keep_private: bool = False, bbox: BBox | None = None) -> DataFrame:
    """way_id, pos, src, dst, ends, oneway, cost, length_m, flags, scenic_score of each segment whose ends are both known."""
    factors = ("f_base", "f_surface", "f_tracktype", "f_smoothness", "f_ford")
    parts = segments(costed_ways(ways, profile, keep_private), "oneway", "flags", *factors)

    def end(name: str) -> DataFrame:
        return located.select(F.col("osm_id").alias(name), F.col("node_id").alias(f"{name}_id"), from_e7_scaled(F.col("lat_e7")).alias(f"{name}_lat"), from_e7_scaled(F.col("lon_e7")).alias(f"{name}_lon"))

    placed = parts.join(end("a"), "a").join(end("b"), "b")
    length = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).cast("float")
    placed = placed.withColumn("length_m", length)
    cost = F.col("length_m")
    for factor in factors:
        cost = cost * F.col(factor)
    placed = placed.withColumn("cost", cost).withColumnsRenamed({"a_id": "src", "b_id": "dst"})
    if features is None:
        return placed.withColumn("scenic_score", F.lit(0))
    midpoints = placed.select("way_id", "pos", ((F.col("a_lat") + F.col("b_lat")) * 0.5).alias("lat"), ((F.col("a_lon") + F.col("b_lon")) * 0.5).alias("lon"))
    score = scenic.scores(midpoints, features, ["way_id", "pos"], bbox)
    return placed.join(score, ["way_id", "pos"], "left").withColumn("scenic_score", F.coalesce("scenic_score", F.lit(0)))


def directed(parts: DataFrame) -> DataFrame:
    """A row for each direction of travel: forward, and back unless one-way."""
    forward = F.struct(F.lit(0).alias("dir"), F.col("src").alias("s"), F.col("dst").alias("d"))
    back = F.struct(F.lit(1).alias("dir"), F.col("dst").alias("s"), F.col("src").alias("d"))
    each = parts.withColumn("_e", F.explode(F.when(F.col("oneway"), F.array(forward)).otherwise(F.array(forward, back))))
    return each.withColumns({"src": F.col("_e.s"), "dst": F.col("_e.d"), "dir": F.col("_e.dir")}).drop("_e")


def numbered_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """Edge ids from 0 by source, target and ``order``, which together must be total."""
    return dense_ids(edges, [F.col("src"), F.col("dst"), *order], "edge_id")


def build_graph(ways: DataFrame, nodes: DataFrame, profile: Profile, features: DataFrame | None = None, bbox: BBox | None = None, keep_private: bool = False, fuel: DataFrame | None = None) -> Graph:
    """The routable graph of (already filtered) ways."""
    located = materialise(graph_nodes(ways, nodes, bbox))
    parts = costed_segments(ways, located, profile, features, keep_private, bbox)
    edges = directed(parts).withColumn("polyline", F.expr(f"cast(array() as array<{POINT}>)"))
    edges = numbered_edges(edges, [*way_order(), F.col("pos"), F.col("dir")])
    return Graph(located.select("node_id", "lat_e7", "lon_e7"), edges.select("edge_id", "src", "dst", "cost", "length_m", "flags", "scenic_score", "polyline"), fuel)


def out_degrees(graph: Graph) -> DataFrame:
    """node_id, degree, and the offset of its first edge (edges are numbered by source, so that is the least edge id or the next node's)."""
    degree = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.min("edge_id").alias("first_edge"))
    return graph.nodes.select("node_id").join(degree, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), "first_edge")


def undirected_degrees(edges: DataFrame) -> DataFrame:
    """node_id and the number of its distinct neighbours in either direction."""
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("nbr")).union(edges.select("dst", "src")).distinct()
    return both.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
