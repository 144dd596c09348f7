"""Work that few bytes stand for is dealt to all tasks, and helpers that grew faster than their input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgraph import fixture_files
from trailgraph.catalog import QUERIES
from trailgraph.fixture import Network
from trailgraph.operators import fuel, overlay, routes, search, spatial
from trailgraph.operators.ways import Graph
from trailgraph.plans.profile import load_profile
from trailgraph.schemas import GRAPH_EDGES, GRAPH_NODES

from .conftest import SMALL

ASKED = (
    "request_id long, from_node long, to_node long, vehicle string, avoid_paved boolean, avoid_fords boolean, prefer_scenic boolean, scenic_weight float, "
    "alternatives int, diversity float, max_detour float, lambda float, fourwd_only_penalty float, min_smoothness string"
)


def line(spark, n=20):
    """Nodes in a row, joined both ways, and a request from each to the last."""
    nodes = [(i, 470000000, -1160000000 + i * 10000) for i in range(n)]
    rows = [(2 * i + d, i + d, i + 1 - d, 1.0, 100.0, 0, 0, []) for i in range(n - 1) for d in (0, 1)]
    graph = Graph(spark.createDataFrame(nodes, GRAPH_NODES), spark.createDataFrame(rows, GRAPH_EDGES))
    asked = [(i, i, n - 1, "4x4" if i % 2 else "dirtbike", False, False, False, 1.0, 1, 0.3, 1.5, 1.5, 2.0, "") for i in range(n)]
    return graph, spark.createDataFrame(asked, ASKED).coalesce(1)


def tasks(frame):
    return frame.select(F.spark_partition_id().alias("p")).distinct().count()


def test_searches_are_dealt_to_all_cores(spark):
    graph, asked = line(spark)
    found = routes.search_routes(asked, graph, load_profile())
    assert tasks(found) > 4
    assert {r.request_id: r.cost for r in found.collect()} == {i: 19.0 - i for i in range(20)}


def test_penalties_are_dealt_to_all_cores_and_counted_by_setting(spark):
    graph, asked = line(spark)
    assert tasks(routes.class_penalties(asked, graph.edges)) > 4
    counted = routes.penalty_counts(asked, graph.edges, 6).collect()
    assert sorted((r.request_id, r.penalty, r.n) for r in counted) == [(i, 1.0, 38) for i in range(20)]


@pytest.mark.parametrize("listed", [10_000, 3])
def test_nearest_makes_no_row_for_each_hit(spark, monkeypatch, listed):
    monkeypatch.setattr(spatial, "LISTED", listed)
    points = spark.range(60).selectExpr("id", "44 + (id * 37 % 60) * 0.011 as lat", "-120 + (id * 23 % 60) * 0.013 as lon")
    targets = spark.range(40).selectExpr("id as t_id", "44 + (id * 11 % 20) * 0.03 as t_lat", "-120 + (id * 7 % 20) * 0.03 as t_lon")
    found = {r.id: r.t_id for r in spatial.nearest(points, "id", targets, 0.02).collect()}
    places = targets.collect()
    for p in points.collect():
        assert found[p.id] == min(places, key=lambda t: ((p.lat - t.t_lat) ** 2 + (p.lon - t.t_lon) ** 2, t.t_id)).t_id
    if listed > 3:
        plan = spatial._met(points, "id", targets, 0.02)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == 1  # the lists of targets alone


def test_fuel_stops_have_no_call_for_each_route(spark):
    graph, _ = line(spark)
    stations = spark.createDataFrame([(7, 470000000, -1160000000 + 50000)], "osm_id long, lat_e7 int, lon_e7 int")
    driven = spark.createDataFrame([(i, 1, list(range(20)), 0.9, 0.1) for i in range(3)], "request_id long, rank int, nodes array<long>, tank_range_km float, fuel_buffer float")
    made = fuel.fuel_stops(driven, Graph(graph.nodes, graph.edges, stations))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.request_id for r in made.collect()} == {0, 1, 2}


def test_files_are_made_by_tasks(spark, monkeypatch):
    def refuse(self, *_):
        raise AssertionError("rows of the network went to the driver")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", refuse)
    net = Network(spark, SMALL)
    roads = fixture_files.write_shapes(net)
    from trailgraph.sources import osm_pbf, shapefile

    assert shapefile.read(spark, roads).count() == net.usfs_records().count()
    extract = fixture_files.write_extract(net)
    assert osm_pbf.read(spark, extract, "way").count() == net.ways().count()
    assert osm_pbf.read(spark, extract, "node").count() == net.nodes().count()


def test_requests_of_one_setting_share_rounds_of_fronts(spark, monkeypatch):
    """One batch of fronts for each setting, however many destinations its requests have."""
    graph, asked = line(spark)
    g = routes._arrays(graph.edges.select(*routes._COLUMNS).toPandas())
    rows = asked.withColumn("to_node", (F.col("request_id") * 7) % 20).withColumnRenamed("lambda", "lambda_").toPandas().sort_values(["vehicle", "to_node", "request_id"])
    batches, make = [], search.settled
    monkeypatch.setattr(search, "settled", lambda g, tariff, asked: batches.append(len(asked)) or make(g, tariff, asked))
    found = list(routes.Searches(g, load_profile()).rows(rows.itertuples(index=False)))
    assert batches == [10, 10]
    assert {r[0]: r[5] for r in found} == {i: float(abs(i * 7 % 20 - i)) for i in range(20)}


def test_fronts_of_a_batch_are_exact_as_far_as_they_are_needed():
    pick = random.Random(2)
    pairs = [(pick.randrange(40), pick.randrange(40)) for _ in range(160)]
    ids, costs = list(range(160)), [pick.choice([0.0, 1.0, 2.5, 7.0]) for _ in range(160)]
    zero = [0] * 160
    g = search.Arrays.of(ids, [a for a, _ in pairs], [b for _, b in pairs], costs, costs, zero, zero, range(42))
    tariff = search.Tariff(g, np.ones(1))
    asked = {t: [(t * 3 + i) % 42 for i in range(1 + t % 3)] for t in range(42)}
    for target, goal in search.settled(g, tariff, asked).items():
        full = search.Front(g, target, search.Prices(g), backward=True).settle().left
        assert goal.low == max(full[s] for s in asked[target])
        assert np.array_equal(np.minimum(goal.left, goal.low), np.minimum(full, goal.low))


def test_a_search_ends_at_its_target_though_another_node_costs_nothing_more():
    zero = [0, 0, 0]
    g = search.Arrays.of([0, 1, 2], [2, 1, 0], [1, 0, 1], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0], zero, zero)
    path = search.shortest_path(g, 2, 1)
    assert path.nodes == [2, 1] and path.edges == [2]


def test_a_step_of_a_route_does_not_carry_the_whole_route(spark):
    """What route_path deals by edge is a row for each step; with the route's nodes in it that grew with the square of a route's length."""

    def joins(plan):
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Join":
            yield from (child.schema().simpleString() for child in children)
        for child in children:
            yield from joins(child)

    found = QUERIES["route_path"](spark, SMALL)
    dealt = list(joins(found._jdf.queryExecution().optimizedPlan()))
    assert any("edge_id" in schema for schema in dealt)
    assert not any("array" in schema for schema in dealt)
