"""Every registered road query against its SQL on the smallest tables; the entry module with and without optional parts."""

import importlib
import sys

import pytest

from trailgraph import catalog

from .conftest import SMALL, canonical

SQL = catalog.oracle()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert len(frame.columns)
    if name in SQL:
        assert canonical(frame) == canonical(duck.sql(SQL[name]).df())


def test_kernel_statistics_equal_relational_ones(spark):
    names = ["request_id", "found", "length_m", "unpaved_fraction", "ford_count", "fourwd_only_count"]
    kernel = catalog.QUERIES["k_alternatives"](spark, SMALL).where("n_edges > 0").select(*names)
    assert canonical(kernel.toPandas()) == canonical(catalog.QUERIES["planned_stats"](spark, SMALL).select(*names).toPandas())


def test_alternatives_are_diverse_and_short_enough(spark):
    pairs = catalog.QUERIES["alt_diversity"](spark, SMALL).collect()
    assert pairs and all(r.distance >= r.diversity - 1e-6 for r in pairs)
    lengths = catalog.QUERIES["alt_detour"](spark, SMALL).collect()
    assert any(r.found for r in lengths) and all(r.length_m <= r.longest + 0.01 for r in lengths)


def test_large_graphs(spark):
    """A graph that may not be broadcast gives the same costs and routes."""
    from pyspark.sql import functions as F

    from trailgraph.fixture import Network
    from trailgraph.operators import requests, routes

    graph = catalog._graph(spark, SMALL)
    own = {r.node_id: pytest.approx(r.cost) for r in routes.single_source(graph, 0).collect()}
    assert len(own) > 50 and {r.node_id: r.cost for r in routes.single_source(graph, 0, broadcast_edges=0).collect()} == own
    asked = routes.snap_requests(requests.validate(Network(spark, SMALL).requests()), graph).where("error is null").withColumn("alternatives", F.lit(2))
    some, all_ = (routes.search_routes(asked, graph, catalog.load_profile(), n) for n in (0, routes.BROADCAST_EDGES))
    assert canonical(some.toPandas()) == canonical(all_.toPandas())
    assert routes.resident(graph) is routes.resident(graph)


def test_contraction_preserves_costs(spark):
    """Cheapest costs between nodes that survive are the same in both graphs, where no two edges join the same nodes (chains take the first of those)."""
    from pyspark.sql import functions as F

    from trailgraph.operators import contract, routes, ways

    full = catalog._graph(spark, SMALL)
    single = contract.first_edges(full.edges).withColumn("polyline", F.expr("cast(array() as array<struct<lat_e7:int,lon_e7:int>>)"))
    plain = ways.Graph(full.nodes, single)
    short = contract.contract(plain)
    assert short.nodes.count() < plain.nodes.count()

    def table(graph):
        place = {r.node_id: (r.lat_e7, r.lon_e7) for r in graph.nodes.collect()}
        start = min(i for i, p in place.items() if p == origin)
        return {place[r.node_id]: r.cost for r in routes.single_source(graph, start).collect()}

    first = short.nodes.orderBy("node_id").first()
    origin = (first.lat_e7, first.lon_e7)
    a, b = table(plain), table(short)
    assert b and {k: pytest.approx(a[k], rel=1e-5) for k in b} == b


def test_gpx(spark):
    import xml.etree.ElementTree as ET

    rows = catalog.QUERIES["gpx_tracks"](spark, SMALL).collect()
    assert rows
    for r in rows:
        tags = [e.tag.rpartition("}")[2] for e in ET.fromstring(r.gpx.encode())]
        assert tags[0] == "metadata" and "trk" in tags and tags[1:] == sorted(tags[1:], key=lambda t: t != "wpt")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_parts(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) == set(SQL)


def test_first_costs_and_errors_look_for_no_alternatives(spark, monkeypatch):
    """Costs of first routes and requests without any are those of the whole plan, and take no search for later routes."""
    planned = catalog._planned(spark, SMALL)
    want = [canonical(planned[0].where("found = 0").select("request_id", catalog._d("cost", 2)).toPandas()), canonical(planned[1].toPandas())]
    monkeypatch.setattr(catalog, "_prepared", {k: v for k, v in catalog._prepared.items() if k[2] in ("graph", "contracted")})
    found = catalog.QUERIES["first_route_cost"](spark, SMALL)
    assert [canonical(found.toPandas()), canonical(catalog.QUERIES["route_errors"](spark, SMALL).toPandas())] == want
    assert not any(k[2] == "planned" for k in catalog._prepared)
