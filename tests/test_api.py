"""From files to answers: build, store, requests in JSON, stream, server, command line."""

import json
import re
import threading
import time
import urllib.error
import urllib.request

import pytest

from trailgraph import api, catalog, cli
from trailgraph.plans.profile import load_profile
from trailgraph.resident import Resident, TooLate
from trailgraph.sources import store
from trailgraph.streaming import requests as stream

from .conftest import SMALL
from .test_graph import pbf, write_shapefile

PLACES = {1: (470000000, -1160000000), 2: (471000000, -1161000000), 3: (471000000, -1159000000), 4: (472000000, -1160000000), 5: (471000100, -1161000100)}


@pytest.fixture(scope="module")
def graph_path(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("built")
    nodes = [(i, a, o, [("amenity", "fuel")] if i == 5 else [("tourism", "viewpoint")] if i == 2 else []) for i, (a, o) in PLACES.items()]
    ways = [(10, [1, 2, 4], [("highway", "track")]), (11, [1, 3, 4], [("highway", "track"), ("surface", "asphalt")]), (12, [1, 4], [("highway", "proposed")]), (13, [2, 3], [("landuse", "forest")])]
    pbf(f"{folder}/x.osm.pbf", nodes, [], ways)
    write_shapefile(f"{folder}/roads", [(3, [[(-116.0, 47.2), (-116.0, 47.21)]], {"ROUTE_STAT": "EX - EXISTING", "OPER_MAINT": "3 - X"}), (3, [[(10.0, 10.0), (10.1, 10.1)]], {"ROUTE_STAT": "EX"})])
    summary = api.build_from_files(spark, f"{folder}/x.osm.pbf", f"{folder}/graph", usfs=f"{folder}/roads.shp", simplify=False).first()
    assert (summary["nodes"], summary["edges"], summary["fuel_stations"]) == (5, 10, 1)
    return f"{folder}/graph"


def body(**changes):
    return json.dumps({"from": [47.0, -116.0], "to": [47.2, -116.0], **changes})


def answers(spark, graph, *bodies):
    table = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    return {r.request_id: (r.status, r.content_type, r.body) for r in api.answer(table, graph).collect()}


def test_answers(spark, graph_path):
    got = answers(spark, store.load(spark, graph_path), body(alternatives=2, tank_range_km=10), body(diversity=3), body(**{"from": [10, 10]}), "no json", body())
    assert [got[i][0] for i in range(5)] == [200, 422, 400, 422, 200]
    assert got[0][1] == "application/gpx+xml" and "<trk>" in got[0][2] and "<wpt" in got[0][2] and "fuel_stops=" in got[0][2]
    assert "diversity" in json.loads(got[1][2])["error"] and "1000 m" in json.loads(got[2][2])["error"]
    assert "<wpt" not in got[4][2]


def test_stream(spark, graph_path, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"request_id": 7, "body": body()}) + "\n")
    bodies = spark.readStream.schema("request_id long, body string").json(str(source))
    query = stream.serve(bodies, store.load(spark, graph_path), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    query.awaitTermination(120)
    assert [(r.request_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(7, 200)]


BODIES = (
    body(), body(alternatives=3, tank_range_km=10, diversity=0.1, max_detour=3), body(alternatives=2, avoid_paved=False, vehicle="bicycle", tank_range_km=1e-3), body(alternatives=0), body(alternatives=None, diversity=None),
    body(diversity=3), body(max_detour=-0.25), body(scenic_weight=1e10), body(**{"from": [10, 10]}), body(to=[47.2]), body(to=[471, 0]), body(to="here"), body(vehicle=7, alternatives="2", avoid_fords="x"),
    body(to=[47.0, -116.0]), body(to=[47.0000899, -116.0]), body(**{"from": [47.1, -116.1], "to": [47.1000100, -116.1000100]}), "no json", "[]", "{}", "", "{'from': [47.0, -116.0], 'to': [47.2, -116.0]}", '{"from": [47',
)


def unstamped(rows):
    return [(s, k, re.sub("<time>[^<]*</time>", "", b)) for s, k, b in rows]


def test_resident_answers_are_those_of_the_batch_plan(spark, graph_path):
    graph = store.load(spark, graph_path)
    resident, batch = Resident(graph, load_profile()), answers(spark, graph, *BODIES)
    got = unstamped(resident.answer(b) for b in BODIES)
    assert got == unstamped(batch[i] for i in range(len(BODIES)))
    assert {s for s, _, _ in got} == {200, 400, 422} and sum(s == 200 for s, _, _ in got) >= 7


def test_resident_answers_on_the_derived_network(spark):
    """Every request of the derived network, with alternatives and fuel stops on a contracted graph."""
    graph = catalog._graph(spark, SMALL, contracted=True)
    resident = Resident(graph, load_profile())
    rows = catalog.Network(spark, SMALL).requests().collect()
    names = ("avoid_paved", "avoid_fords", "prefer_scenic", "alternatives", "vehicle")
    bodies = [json.dumps({"from": [r.from_lat, r.from_lon], "to": [r.to_lat, r.to_lon], "tank_range_km": 2, **{n: r[n] for n in names if r[n] is not None}}) for r in rows]
    batch = answers(spark, graph, *bodies)
    got = unstamped(resident.answer(b) for b in bodies)
    assert got == unstamped(batch[i] for i in range(len(bodies)))
    assert any("<wpt" in b for _, _, b in got) and any("route-2" in b for _, _, b in got)
    started = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    first = time.monotonic()
    for b in bodies:
        resident.answer(b)
    assert (time.monotonic() - first) / len(bodies) < 1.6
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == started  # no Spark job
    with pytest.raises(TooLate):
        resident.answer(bodies[0], time.monotonic() - 1)


def test_late_requests_give_their_planner_back(spark, graph_path):
    """A request of the batch plan that has no time gets 408, and its jobs end."""
    server = cli.server(spark, graph_path, "127.0.0.1", 0, timeout_s=0.05, resident_edges=0)
    assert server.resident is None
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for _ in range(2):
            with pytest.raises(urllib.error.HTTPError) as error:
                urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/route", body().encode(), method="POST"), timeout=100)
            assert error.value.code == 408
        server.timeout_s = 100
        reply = urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/route", body().encode(), method="POST"), timeout=100)
        assert reply.status == 200
    finally:
        server.shutdown()


def test_server(spark, graph_path):
    server = cli.server(spark, graph_path, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.load(urllib.request.urlopen(f"{base}/health")) == api.health()
        reply = urllib.request.urlopen(urllib.request.Request(f"{base}/route", body().encode(), method="POST"), timeout=100)
        assert reply.status == 200 and reply.headers["Content-Type"] == "application/gpx+xml"
        for data, status in ((body(scenic_weight=9).encode(), 422), (b"x" * (65 << 10), 413)):
            with pytest.raises((urllib.error.HTTPError, urllib.error.URLError)) as error:
                urllib.request.urlopen(urllib.request.Request(f"{base}/route", data, method="POST"), timeout=100)
            assert getattr(error.value, "code", status) == status
    finally:
        server.shutdown()


def test_command_line():
    given = cli.parser().parse_args(["build", "x.pbf", "--bbox", "1,2,3,4", "--no-simplify"])
    assert given.pbf == "x.pbf" and given.no_simplify and given.usfs_snap == 50.0 and not given.keep_private
    assert cli.parser().parse_args(["serve"]).port == 3000


def test_tags_report(spark):
    rows = [tuple(r)[:2] for r in api.tags(spark).collect()]
    assert rows == sorted(rows) and ("base", "track") in rows
