"""Searches by cells and their overlay against searches on the whole graph."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgraph.functions.geo import space_order
from trailgraph.operators import overlay, routes, search
from trailgraph.operators.ways import Graph
from trailgraph.plans.profile import load_profile
from trailgraph.schemas import FORD, GRAPH_EDGES, GRAPH_NODES, PAVED

ASKED = (
    "request_id long, from_node long, to_node long, vehicle string, avoid_paved boolean, avoid_fords boolean, prefer_scenic boolean, scenic_weight float, "
    "alternatives int, diversity float, max_detour float, lambda float"
)
KINDS = {("4x4", False): (True, 0.7), ("dirtbike", True): (False, 0.5)}


def town(spark, side=9, seed=3):
    """A grid with some streets missing and an island of two nodes, all costs different."""
    pick = random.Random(seed)
    nodes = [(r * side + c, 470000000 + r * 100000, -1160000000 + c * 100000) for r in range(side) for c in range(side)]
    island = side * side
    nodes += [(island, 480000000, -1150000000), (island + 1, 480100000, -1150000000)]
    pairs = [(a, a + d) for r in range(side) for c in range(side) for a in [r * side + c] for d, fits in ((1, c + 1 < side), (side, r + 1 < side)) if fits and pick.random() < 0.93]
    rows = []
    for a, b in [*pairs, (island, island + 1)]:
        for s, t in ((a, b), (b, a)):
            flags = pick.choice([0, 0, 0, PAVED, FORD])
            rows.append((len(rows), s, t, pick.uniform(1, 3), pick.uniform(100, 300), flags, pick.choice([0, 40, 200]), []))
    return Graph(spark.createDataFrame(nodes, GRAPH_NODES), spark.createDataFrame(rows, GRAPH_EDGES)), island


def table(frame):
    return {(r.request_id, r.found): (r.nodes, r.edges, pytest.approx(r.length_m), pytest.approx(r.cost), pytest.approx(r.unpaved_fraction), r.ford_count, r.fourwd_only_count) for r in frame.collect()}


@pytest.mark.parametrize("cell_nodes", [7, 25, 1000])
def test_alternatives_over_cells_are_those_of_the_whole_graph(spark, cell_nodes):
    graph, island = town(spark)
    pick, asked = random.Random(5), []
    ends = [(pick.randrange(island), pick.randrange(island)) for _ in range(6)]
    for i, (a, b) in enumerate([*ends, (0, 1), (4, 4), (0, island), (island + 1, island)]):
        (vehicle, fords), (scenic, weight) = pick.choice(list(KINDS.items()))
        asked.append((i, a, b, vehicle, i % 3 == 0, fords, scenic, weight, 3 if i % 2 else 1, 0.2, 2.0, 1.5))
    asked = spark.createDataFrame(asked, ASKED)
    whole = table(routes.search_routes(asked, graph, load_profile()))
    assert len(whole) > 10 and any(found for _, found in whole) and not any(own == 8 for own, _ in whole)
    assert table(routes.search_routes(asked, graph, load_profile(), 0, cell_nodes)) == whole


def test_no_cell_holds_more_than_its_share(spark):
    graph, _ = town(spark)
    cells = overlay.Cells(graph, 20)
    sizes = [r["count"] for r in cells.homes.groupBy("cell").count().collect()]
    assert max(sizes) == 20 and sum(sizes) == 83
    inside = cells.inner.where(F.col("edge_id") >= 0).count()
    assert inside + cells.cut.count() == graph.edges.count() and 0 < cells.cut.count() < inside
    coarse = overlay.Cells(graph, 5, cut_edges=40)
    assert coarse.cut.count() <= 40


def test_arcs_keep_all_costs_between_border_nodes(spark):
    """Of a cell's arcs, those that stay give the same costs as all of them."""
    graph, _ = town(spark)
    cells = overlay.Cells(graph, 30)
    frame = cells.inner.where("cell = 0").toPandas()
    cell = overlay.Cell(frame, [])
    prices = search.Prices(cell.g)
    arcs = list(cell.through(prices))
    full = {(int(a), int(b)): c for a in cell.border for b, c in zip(cell.border, cell.costs(int(a), prices, cell.border), strict=True)}
    assert 0 < len(arcs) < sum(1 for (a, b), c in full.items() if a != b and np.isfinite(c))
    flat = [0] * len(arcs)
    net = search.Arrays.of(range(len(arcs)), *map(list, zip(*arcs, strict=True)), flat, flat, flat, cell.border)
    for (a, b), c in full.items():
        got = search.Front(net, net.place(a), search.Prices(net)).settle().left[net.place(b)]
        assert got == pytest.approx(c) if np.isfinite(c) else np.isinf(got)


def test_an_empty_table_of_requests(spark):
    graph, _ = town(spark, 3)
    assert routes.search_routes(spark.createDataFrame([], ASKED), graph, load_profile(), 0, 4).count() == 0


def test_space_order(spark):
    """Bits of both coordinates by turns, for the ends of the globe too."""
    places = [(0, 0), (900000000, 1800000000), (-900000000, -1800000000), (471234567, -1161234567), (123, 456)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, a int, o int").select("i", space_order(F.col("a"), F.col("o")).alias("z")).collect()
    for r in got:
        lat, lon = ((places[r.i][0] + 900000000) >> 1), ((places[r.i][1] + 1800000000) >> 1)
        assert r.z == sum(((lat >> b) & 1) << (2 * b) | ((lon >> b) & 1) << (2 * b + 1) for b in range(31))


def test_costs_from_one_node_over_cells(spark, cell_nodes=20):
    graph, island = town(spark)
    for source in (40, island):
        want = {r.node_id: r.cost for r in routes.single_source(graph, source).collect()}
        got = {r.node_id: r.cost for r in routes.single_source(graph, source, 0, cell_nodes).collect()}
        assert got == pytest.approx(want) and len(got) == len(want) and (len(got) > 70 or source == island)
    assert [tuple(r) for r in routes.single_source(graph, 999, 0, cell_nodes).collect()] == [(999, 0.0)]


def test_rounds_from_one_node_are_not_its_hops(spark, monkeypatch):
    """A row of 120 nodes in three cells: a few rounds, not one for each hop."""
    nodes = [(i, 470000000, -1160000000 + i * 10000) for i in range(120)]
    rows = [(2 * i + d, i + d, i + 1 - d, 1.0, 100.0, 0, 0, []) for i in range(119) for d in (0, 1)]
    graph = Graph(spark.createDataFrame(nodes, GRAPH_NODES), spark.createDataFrame(rows, GRAPH_EDGES))
    made = []
    for module in (overlay, routes):
        monkeypatch.setattr(module, "materialise", lambda df, cut=module.materialise: made.append(1) or cut(df))
    got = {r.node_id: r.cost for r in routes.single_source(graph, 0, 0, 40).collect()}
    assert got == {i: float(i) for i in range(120)} and len(made) < 20
