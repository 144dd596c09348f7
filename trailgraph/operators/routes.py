"""Route planning for tables of requests: snap, search, rank, statistics."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_RADIUS_M, from_e7, haversine_m
from ..functions.storage import materialise
from ..functions.tags import has_flag
from ..plans.profile import DEFAULT_VEHICLE, Profile
from ..schemas import FORD, FOURWD_ONLY, PAVED, ROUGH, ROUTES, TRAIL, VERY_ROUGH
from . import crossing, overlay, search
from . import requests as req
from .spatial import nearest
from .ways import Graph

SNAP_LIMIT_M = 1000.0
FAR, NO_ROUTE = "the {} is more than 1000 m from any road of the map", "no roads connect the two places"
UNPAVED_WEIGHT, DETOUR_WEIGHT = 0.6, 0.4
#: Shortest lengths are guarded by the least step of a 32-bit float.
EPSILON = float(np.finfo(np.float32).eps)
#: Edges that are broadcast to all executors at most (18 bytes each, and as many again for what is made of them).
BROADCAST_EDGES = 5_000_000
#: The same for requests with prices of their own.  By cells each setting has its own matrices or overlay, which is far more work than a search
#: over the whole graph; so the arrays may be as large as those of 5 million edges were in wide kinds.
PRICED_EDGES = 7_500_000
#: Tasks of a search for each core.
TASKS_PER_CORE = 4
#: Settings of penalties whose counts are broadcast at most.
FEW_SETTINGS = 1024

_COLUMNS = ["edge_id", "src", "dst", "cost", "length_m", "flags", "scenic_score"]


def snap(points: DataFrame, key: str, graph: Graph, step: float = 0.02, limit_m: float = SNAP_LIMIT_M) -> DataFrame:
    """key, node_id, snap_m: the nearest graph node in degrees and its distance in metres, of the points where that is within ``limit_m``."""
    targets = graph.nodes.select(F.col("node_id").alias("t_id"), from_e7(F.col("lat_e7")).alias("t_lat"), from_e7(F.col("lon_e7")).alias("t_lon"))
    # so many degrees, along the parallel, are the limit at most; a little more, as the distance is a curve's
    limit = F.lit(1.01 * math.degrees(limit_m / EARTH_RADIUS_M)) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-9))
    hit = nearest(points.select(key, "lat", "lon"), key, targets, step, limit)
    snapped = hit.select(key, F.col("t_id").alias("node_id"), haversine_m(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")).alias("snap_m"))
    return snapped.where(F.col("snap_m") <= limit_m)


def snap_requests(valid: DataFrame, graph: Graph) -> DataFrame:
    """Requests with from_node and to_node, and ``error`` where an end is too far from any node."""
    ends = valid.select("request_id", F.explode(F.array(*(F.struct(F.lit(e).alias("end"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for e in ("from", "to")))).alias("p"))
    points = ends.select(F.struct("request_id", F.col("p.end").alias("end")).alias("point"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    found = snap(points, "point", graph)
    by_request = found.groupBy(F.col("point.request_id").alias("request_id")).agg(
        *(F.max(F.when(F.col("point.end") == e, F.col("node_id"))).alias(f"{e}_node") for e in ("from", "to"))
    )
    place = {"from": "origin", "to": "destination"}
    error = F.lit(None).cast("string")
    for e in ("to", "from"):
        error = F.when(F.col(f"{e}_node").isNull(), F.lit(FAR.format(place[e]))).otherwise(error)
    return valid.drop("error").join(by_request, "request_id", "left").withColumn("error", error)


_ASKED = ("request_id", "avoid_paved", "avoid_fords", "prefer_scenic", "scenic_weight", "vehicle", "fourwd_only_penalty", "min_smoothness")


def class_penalties(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """request_id, flags, scenic_score, penalty, n: a penalty hangs on an edge's flags and score alone, so each class of n edges has one for each request.

    Flags and scores have eight bits each, which bounds the classes.
    """
    classes = edges.groupBy("flags", "scenic_score").agg(F.count(F.lit(1)).alias("n")).collect()
    if not classes:
        return requests.sparkSession.createDataFrame([], "request_id long, flags int, scenic_score int, penalty double, n long")
    table = F.from_json(F.lit(json.dumps([r.asDict() for r in classes])), "array<struct<flags:int,scenic_score:int,n:bigint>>")
    # a request is few bytes and many rows: dealt to all cores, or one task would make them all
    tasks = TASKS_PER_CORE * requests.sparkSession.sparkContext.defaultParallelism
    met = requests.select(*_ASKED).repartition(tasks, "request_id").select(*_ASKED, F.explode(table).alias("c"))
    return met.select("request_id", "c.flags", "c.scenic_score", req.initial_penalty(F.col("c.flags"), F.col("c.scenic_score")).alias("penalty"), "c.n")


def penalty_counts(requests: DataFrame, edges: DataFrame, places: int) -> DataFrame:
    """request_id, penalty (rounded) and the number of edges with it, counted once for each setting of penalties that requests have."""
    setting = _ASKED[1:]
    numbered = materialise(requests.select(*setting).distinct().withColumn("request_id", F.monotonically_increasing_id()))
    found = class_penalties(numbered, edges).withColumn("penalty", F.round("penalty", places))
    counted = found.groupBy(F.col("request_id").alias("_setting"), "penalty").agg(F.sum("n").alias("n"))
    numbered = numbered.select(F.col("request_id").alias("_setting"), *(F.col(c).alias(f"_{c}") for c in setting))
    asked = requests.select(*_ASKED).join(numbered, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in setting]).select("request_id", "_setting")
    if numbered.count() <= FEW_SETTINGS:  # penalties are hundreds at most, so their counts are few rows
        counted = F.broadcast(counted)
    return asked.join(counted, "_setting").select("request_id", "penalty", "n")


def edge_penalties(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """request_id, edge_id, penalty of every edge for every request: a report.  Searches never use it; they work penalties out inside their own task."""
    own = class_penalties(requests, edges).drop("n")
    return edges.select("edge_id", "flags", "scenic_score").join(own, ["flags", "scenic_score"]).select("request_id", "edge_id", "penalty")


def step_penalties(steps: DataFrame, requests: DataFrame, edges: DataFrame) -> DataFrame:
    """request_id, edge_id, penalty of the edges that routes use."""
    used = steps.select("request_id", "edge_id").distinct().join(edges.select("edge_id", "flags", "scenic_score"), "edge_id").join(requests.select(*_ASKED), "request_id")
    return used.select("request_id", "edge_id", req.initial_penalty(F.col("flags"), F.col("scenic_score")).alias("penalty"))


def penalty_array(flags: np.ndarray, scenic: np.ndarray, request, profile: Profile) -> np.ndarray:
    """The same penalties inside a kernel."""
    vehicle = profile.vehicle.get(request.vehicle) or profile.vehicle[DEFAULT_VEHICLE]
    value = np.ones(len(flags))
    if request.prefer_scenic:
        value = np.where(scenic > 0, np.clip(1 - float(request.scenic_weight) * req.SCENIC_EFFECT * (scenic / 255.0), req.SCENIC_FLOOR, 1.0), 1.0)
    hard = [(TRAIL, req.BLOCKED if request.vehicle != "dirtbike" else None), (FOURWD_ONLY, vehicle.fourwd_only_penalty)]
    hard += [(PAVED, req.AVOID_PAVED if request.avoid_paved else None), (FORD, req.AVOID_FORDS if request.avoid_fords else None)]
    hard += [({"bad": ROUGH, "very_bad": VERY_ROUGH}.get(vehicle.min_smoothness, 0), req.BLOCKED)]
    for bit, penalty in hard:
        if bit and penalty is not None:
            value = np.where((flags & bit) != 0, np.maximum(value, penalty), value)
    return value


def tariff_for(g: search.Arrays, request, profile: Profile) -> search.Tariff:
    """A request's first prices: one penalty for each class of edges."""
    return search.Tariff(g, penalty_array(*g.classes[:2], request, profile))


class Searches:
    """Answers requests; those of one setting share its prices, and the fronts from their destinations are made together."""

    def __init__(self, g: search.Arrays, profile: Profile) -> None:
        self.g, self.profile = g, profile

    def paths(self, request, check: Callable[[], None] = lambda: None, tariff: search.Tariff | None = None, goal: search.Settled | None = None) -> list[search.Path]:
        """Routes of a request (with from_node and to_node) in the order found, as positions in the arrays."""
        start, end = self.g.place(request.from_node), self.g.place(request.to_node)
        if start is None or end is None:
            return []
        tariff = tariff or tariff_for(self.g, request, self.profile)
        goal = goal or search.settled(self.g, tariff, {end: [start]})[end]
        return search.alternatives(
            self.g, start, end, int(request.alternatives), float(request.lambda_), float(request.diversity), float(request.max_detour), search.Prices(self.g, tariff=tariff), goal, check
        )

    def _row(self, request, found: int, p: search.Path) -> tuple:
        g = self.g
        return (request.request_id, found, g.node_ids[p.nodes].tolist(), g.edge_id[p.edges].tolist() if p.edges else [], p.length_m, p.cost, p.unpaved_fraction, p.ford_count, p.fourwd_only_count)

    def rows(self, requests: Iterable) -> Iterator[tuple]:
        """Routes of requests that come by setting and destination."""
        g = self.g
        for _, same in groupby(requests, lambda r: tuple(getattr(r, c) for c in overlay.SETTING)):
            tariff, waiting = None, []
            for _, own in groupby(same, lambda r: r.to_node):
                own = [r for r in own if r.alternatives > 0]
                yield from ((r.request_id, 0, [int(r.from_node)], [], 0.0, 0.0, 0.0, 0, 0) for r in own if r.from_node == r.to_node and g.place(r.from_node) is None)
                own = [r for r in own if g.place(r.from_node) is not None and g.place(r.to_node) is not None]
                if own:
                    tariff = tariff or tariff_for(g, own[0], self.profile)
                    waiting.append(own)
                if len(waiting) >= max(1, min(search.BATCH_FRONTS, search.BATCH_COSTS // len(g.node_ids))):
                    yield from self._batch(waiting, tariff)
                    waiting = []
            if waiting:
                yield from self._batch(waiting, tariff)

    def _batch(self, waiting: list[list], tariff: search.Tariff) -> Iterator[tuple]:
        """Routes of requests of one setting, listed by destination."""
        goals = search.settled(self.g, tariff, {self.g.place(own[0].to_node): [self.g.place(r.from_node) for r in own] for own in waiting})
        for own in waiting:
            for r in own:
                for found, p in enumerate(self.paths(r, tariff=tariff, goal=goals[self.g.place(r.to_node)])):
                    yield self._row(r, found, p)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["request_id", "found", "nodes", "edges", "length_m", "cost", "unpaved_fraction", "ford_count", "fourwd_only_count"])


#: Number of edges and broadcast arrays of graphs that are searched again and again, while the graph is in use.
_resident: WeakKeyDictionary[DataFrame, dict[str, int | Broadcast]] = WeakKeyDictionary()


def resident(graph: Graph, broadcast_edges: int = BROADCAST_EDGES) -> Broadcast | None:
    """The graph as arrays on every executor, made at its first search; None where it has more edges than may be broadcast."""
    known = _resident.setdefault(graph.edges, {})
    if "edges" not in known:
        known["edges"] = graph.edges.count()
    if known["edges"] > broadcast_edges:
        return None
    if "arrays" not in known:
        known["arrays"] = graph.edges.sparkSession.sparkContext.broadcast(_arrays(graph.edges.select(*_COLUMNS).toPandas()))
    return known["arrays"]


def search_routes(snapped: DataFrame, graph: Graph, profile: Profile, broadcast_edges: int = BROADCAST_EDGES, cell_nodes: int = overlay.CELL_NODES) -> DataFrame:
    """Routes (in the order found) of requests whose ends are snapped.

    A graph up to ``broadcast_edges`` edges goes to each executor once, and
    stays there for later requests; a larger one is searched by cells of at
    most ``cell_nodes`` nodes and the overlay between them: requests for one
    route all together, those for several in rounds.
    """
    asked = snapped.select("request_id", "from_node", "to_node", "vehicle", "avoid_paved", "avoid_fords", "prefer_scenic", "scenic_weight", "alternatives", "diversity", "max_detour", F.col("lambda").alias("lambda_"))
    shared = resident(graph, broadcast_edges)
    if shared is not None:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searches = Searches(shared.value, profile)
            for frame in frames:
                yield _frame(list(searches.rows(frame.itertuples(index=False))))

        # dealt by ranges, so that a task meets few settings and has as many requests as any other.
        # The number is given, as requests are few bytes and much work: Spark would join them to one task by their size
        tasks = TASKS_PER_CORE * asked.sparkSession.sparkContext.defaultParallelism
        order = [*overlay.SETTING, "to_node", "request_id"]
        return asked.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(run, ROUTES)

    def price(flags: np.ndarray, scenic: np.ndarray, request) -> np.ndarray:
        return penalty_array(flags, scenic, request, profile)

    asked = materialise(asked)
    found = crossing.search_routes(asked.where("alternatives = 1"), graph, price, cell_nodes)
    several = asked.where("alternatives > 1")
    return found if several.isEmpty() else found.unionByName(overlay.search_routes(several, graph, price, cell_nodes))


def search_costs(snapped: DataFrame, graph: Graph, profile: Profile, broadcast_edges: int = BROADCAST_EDGES, cell_nodes: int = overlay.CELL_NODES) -> DataFrame:
    """request_id and what the cheapest route of each request that has one costs; by cells, no route is put together for that."""
    one = snapped.where("alternatives > 0").withColumn("alternatives", F.lit(1))
    if resident(graph, broadcast_edges) is not None:
        return search_routes(one, graph, profile, broadcast_edges, cell_nodes).select("request_id", "cost")
    asked = materialise(one.select("request_id", "from_node", "to_node", *overlay.SETTING))
    return crossing.search_costs(asked, graph, lambda flags, scenic, request: penalty_array(flags, scenic, request, profile), cell_nodes)


def _arrays(frame: pd.DataFrame) -> search.Arrays:
    return search.Arrays.narrow(*(frame[c].to_numpy() for c in _COLUMNS))


def single_source(graph: Graph, source: int, broadcast_edges: int = BROADCAST_EDGES, cell_nodes: int = overlay.CELL_NODES) -> DataFrame:
    """node_id and the exact cost from ``source`` of every node that can be reached: one search in one task, or rounds over cells on a graph that is too large for that."""
    shared = resident(graph, broadcast_edges)
    if shared is None:
        return overlay.single_source(graph, source, cell_nodes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source in frame["id"]:
                g = shared.value
                start = g.place(source)
                if start is None:
                    yield pd.DataFrame({"node_id": [source], "cost": [0.0]})
                else:
                    cost = search.Front(g, start, search.Prices(g)).settle().left
                    reached = np.isfinite(cost)
                    yield pd.DataFrame({"node_id": g.node_ids[reached], "cost": cost[reached]})

    return graph.edges.sparkSession.range(source, source + 1, 1, 1).mapInPandas(run, "node_id long, cost double")


def score(unpaved: Column, length: Column, shortest: Column) -> Column:
    return unpaved * UNPAVED_WEIGHT - (length / F.greatest(shortest, F.lit(EPSILON)) - 1) * DETOUR_WEIGHT


def rank_routes(routes: DataFrame) -> DataFrame:
    """Adds score and rank (from 1): best score first, then the order found.  Detours count against the first route found."""
    own = Window.partitionBy("request_id")
    first = F.max(F.when(F.col("found") == 0, F.col("length_m"))).over(own)
    scored = routes.withColumn("score", score(F.col("unpaved_fraction"), F.col("length_m"), first))
    return scored.withColumn("rank", F.row_number().over(own.orderBy(F.col("score").desc(), F.col("found"))))


def route_stats(steps: DataFrame, edges: DataFrame, penalties: DataFrame) -> DataFrame:
    """Totals of routes from their steps (request_id, found, pos, edge_id); an edge without penalty counts once."""
    joined = steps.join(edges.select("edge_id", "cost", "length_m", "flags"), "edge_id").join(penalties, ["request_id", "edge_id"], "left")
    unpaved = F.sum(F.when(~has_flag(F.col("flags"), PAVED), F.col("length_m")).otherwise(F.lit(0.0)))
    total = F.sum("length_m")
    return joined.groupBy("request_id", "found").agg(
        total.alias("length_m"),
        F.sum(F.col("cost") * F.coalesce("penalty", F.lit(1.0))).alias("cost"),
        F.when(total > 0, unpaved / total).otherwise(F.lit(0.0)).alias("unpaved_fraction"),
        F.count_if(has_flag(F.col("flags"), FORD)).cast("int").alias("ford_count"),
        F.count_if(has_flag(F.col("flags"), FOURWD_ONLY)).cast("int").alias("fourwd_only_count"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Distance of two edge lists as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.size(F.array_intersect(a, b)) / union)


def route_pairs(routes: DataFrame) -> DataFrame:
    """request_id, found_a, found_b and the Jaccard distance of each pair of a request's routes."""
    a = routes.select("request_id", F.col("found").alias("found_a"), F.col("edges").alias("edges_a"))
    b = routes.select("request_id", F.col("found").alias("found_b"), F.col("edges").alias("edges_b"))
    pairs = a.join(b, "request_id").where("found_a < found_b")
    return pairs.select("request_id", "found_a", "found_b", jaccard(F.col("edges_a"), F.col("edges_b")).alias("distance"))


def plan_routes(requests: DataFrame, graph: Graph, profile: Profile, broadcast_edges: int = PRICED_EDGES) -> tuple[DataFrame, DataFrame]:
    """Ranked routes, and request_id, status, error of the requests without any (422: invalid, 400: no route)."""
    checked, snapped = _snapped(requests, graph)
    routes = materialise(search_routes(snapped.where("error is null"), graph, profile, broadcast_edges))
    return rank_routes(routes), _errors(checked, snapped, routes)


def _snapped(requests: DataFrame, graph: Graph) -> tuple[DataFrame, DataFrame]:
    checked = materialise(req.validate(requests))
    return checked, materialise(snap_requests(checked.where("error is null"), graph))


def _errors(checked: DataFrame, snapped: DataFrame, found: DataFrame) -> DataFrame:
    invalid = checked.where("error is not null").select("request_id", F.lit(422).alias("status"), "error")
    unsnapped = snapped.where("error is not null").select("request_id", F.lit(400).alias("status"), "error")
    lost = snapped.where("error is null").join(found, "request_id", "left_anti").select("request_id", F.lit(400).alias("status"), F.lit(NO_ROUTE).alias("error"))
    return invalid.unionByName(unsnapped).unionByName(lost)


def first_routes(requests: DataFrame, graph: Graph, profile: Profile, broadcast_edges: int = PRICED_EDGES) -> DataFrame:
    """The first route of each request that has one (found = 0), as ``plan_routes`` finds it; later ones are not looked for."""
    snapped = _snapped(requests, graph)[1].where("error is null")
    return search_routes(snapped.withColumn("alternatives", F.least("alternatives", F.lit(1))), graph, profile, broadcast_edges)


def plan_errors(requests: DataFrame, graph: Graph, profile: Profile, broadcast_edges: int = PRICED_EDGES) -> DataFrame:
    """The errors of ``plan_routes``, without the routes: no penalty closes an edge, so a request has a route where there is any way."""
    checked, snapped = _snapped(requests, graph)
    wanted = snapped.where("error is null and alternatives > 0").select("request_id", "from_node", "to_node")
    shared = resident(graph, broadcast_edges)
    if shared is None:
        plain = {"avoid_paved": F.lit(False), "avoid_fords": F.lit(False), "prefer_scenic": F.lit(False), "vehicle": F.lit("dirtbike"), "alternatives": F.lit(1)}
        one = snapped.where("error is null and alternatives > 0").withColumns(plain)
        return _errors(checked, snapped, materialise(search_costs(one, graph, profile, broadcast_edges)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for frame in frames:
            placed = [(r.request_id, g.place(r.from_node), g.place(r.to_node)) for r in frame.itertuples(index=False)]
            own = [(r, a, b) for r, a, b in placed if a is not None and b is not None]
            same = frame["request_id"][frame["from_node"] == frame["to_node"]].tolist()
            good = [r for (r, _, _), ok in zip(own, search.reaches(g, [(a, b) for _, a, b in own]), strict=True) if ok]
            yield pd.DataFrame({"request_id": np.array(sorted({*same, *good}), dtype=np.int64)})

    tasks = wanted.sparkSession.sparkContext.defaultParallelism
    return _errors(checked, snapped, materialise(wanted.repartition(tasks, "request_id").mapInPandas(run, "request_id long")))
