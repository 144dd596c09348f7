"""Building, scoring, contracting, conflating, storing and reading graphs on small tables."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from trailgraph import schemas
from trailgraph.functions import geo, tags
from trailgraph.operators import conflate, contract, requests, routes, scenic, spatial, ways
from trailgraph.plans.build import build
from trailgraph.plans.profile import load_profile, parse_profile
from trailgraph.sources import osm_pbf, shapefile, store

PROFILE = load_profile()
WAYS, NODES = schemas.WAYS, schemas.NODES


def way_table(spark, *rows):
    return spark.createDataFrame([(i, list(n), t) for i, n, t in rows], WAYS)


def node_table(spark, places):
    return spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in places.items()], NODES)


THREE = {100: (47.0, -116.0), 101: (47.009, -116.0), 102: (47.018, -116.0)}


def graph_of(spark, way_rows, places=THREE, **options):
    return ways.build_graph(way_table(spark, *way_rows), node_table(spark, places), PROFILE, **options)


def edges_of(graph):
    return [r.asDict() for r in graph.edges.orderBy("edge_id").collect()]


# ------------------------------------------------------------------- functions


def test_haversine(spark):
    one = lambda *x: spark.range(1).select(geo.haversine_m(*(F.lit(float(v)) for v in x))).first()[0]
    assert one(0, 0, 0, 0) == 0 and abs(one(0, 0, 1, 0) - 111195) < 100


def test_quantise_cuts_off(spark):
    assert spark.range(1).select(geo.to_e7(F.lit(-1.99999999)), geo.to_e7(F.lit(45.00000009))).first()[:] == (-19999999, 450000000)


def test_parse_bbox():
    assert geo.parse_bbox(" -1, 2 ,3,4.5") == (-1, 2, 3, 4.5)
    for bad in ("1,2,3", "1,2,3,x", ""):
        with pytest.raises(ValueError):
            geo.parse_bbox(bad)


def test_profile():
    assert PROFILE.fingerprint() == load_profile().fingerprint() and len(PROFILE.vehicle) == 4
    assert PROFILE.vehicle["dirtbike"].narrow_path_bonus == 0.5 and PROFILE.vehicle["4x4"].narrow_path_bonus is None
    for bad in ("x.txt", "a/../b.toml"):
        with pytest.raises(ValueError):
            load_profile(bad)
    with pytest.raises(ValueError):
        parse_profile("[base]\ntrack=1.0")
    assert parse_profile("[base]\n[surface]\n[tracktype]\n[smoothness]\n[vehicle]\n").routing.ford_penalty == 3.0


@pytest.mark.parametrize(
    ("own", "options", "kept"),
    [
        ({"highway": "track"}, {}, True), ({}, {}, False), ({"highway": ""}, {}, False), ({"highway": "proposed"}, {}, False),
        ({"highway": "track", "access": "private"}, {}, False), ({"highway": "track", "access": "no"}, {}, False), ({"highway": "track", "access": "no"}, {"keep_private": True}, True),
        ({"highway": "track", "vehicle": "no"}, {"keep_private": True}, False), ({"highway": "track", "motor_vehicle": "no"}, {}, False),
        ({"highway": "track", "motor_vehicle": "no"}, {"motorized": False}, True), ({"highway": "track"}, {"skip_tracks": True}, False), ({"highway": "primary"}, {"skip_tracks": True}, True),
        ({"highway": "footway"}, {}, False),
    ],
)
def test_way_filter(spark, own, options, kept):
    table = way_table(spark, (1, [1, 2], own))
    assert table.where(tags.WayFilter(PROFILE.allowed, **options).keep(F.col("tags"))).count() == kept


def test_repeated_tag_last_wins(spark):
    pairs = spark.sql("select array(named_struct('key', 'a', 'value', '1'), named_struct('key', 'b', 'value', '2'), named_struct('key', 'a', 'value', '3')) as p")
    assert pairs.select(tags.tags_of(F.col("p"))).first()[0] == {"a": "3", "b": "2"}


def test_scenic_kinds(spark):
    both = [({k: v}, kind, only) for k, v, kind, only in tags.SCENIC_RULES] + [({"natural": "wood", "waterway": "river"}, "Forest", "river on nodes"), ({"tourism": "viewpoint", "natural": "peak"}, "Viewpoint", False), ({"natural": "x"}, None, False)]
    table = spark.createDataFrame([(t, k, str(o)) for t, k, o in both], "tags map<string,string>, kind string, only string")
    for r in table.select("kind", "only", tags.scenic_kind(F.col("tags"), True).alias("w"), tags.scenic_kind(F.col("tags"), False).alias("n")).collect():
        assert r.w == r.kind
        assert r.n == (None if r.only == "True" else "River" if r.only == "river on nodes" else r.kind)


def test_usfs_tags(spark):
    rows = [
        ("1 - BASIC CUSTODIAL CARE (CLOSED)", "ALL", None, None, None, {"highway": "track", "4wd_only": "yes", "smoothness": "very_bad"}),
        ("2 - HIGH CLEARANCE VEHICLES", "ADMIN", "", "GRAV - GRAVEL", " Road ", {"highway": "track", "4wd_only": "yes", "access": "private", "surface": "gravel", "name": "Road"}),
        ("3 - X", "ADMIN", "D - DECOMMISSION", "NAT - NATIVE", "", {"highway": "track", "access": "no"}),
        ("4", None, None, "ASPH", None, {"highway": "unclassified", "surface": "asphalt"}), ("9 - X", None, None, None, None, {"highway": "secondary"}), ("NA", None, None, None, None, {"highway": "track"}), ("-1 - X", None, None, None, None, {"highway": "track"}),
    ]
    table = spark.createDataFrame([r[:5] for r in rows], "a string, b string, c string, d string, e string")
    got = [r[0] for r in table.select(tags.usfs_tags(*(F.col(c) for c in "abcde"))).collect()]
    assert got == [r[5] for r in rows]


# ----------------------------------------------------------------------- build


def test_three_node_way(spark):
    graph = graph_of(spark, [(1, [100, 101, 102], {"highway": "track"})])
    edges = edges_of(graph)
    assert graph.nodes.count() == 3 and len(edges) == 4 and all(0 < e["cost"] < e["length_m"] for e in edges)
    assert [r.degree for r in ways.out_degrees(graph).orderBy("node_id").collect()] == [1, 2, 1]


def test_oneway_paved_trail_rough(spark):
    assert len(edges_of(graph_of(spark, [(1, [100, 101], {"highway": "track", "oneway": "yes"})]))) == 1
    for own, flag in (({"highway": "road", "surface": "asphalt"}, schemas.PAVED), ({"highway": "footway"}, schemas.TRAIL), ({"highway": "path"}, schemas.TRAIL), ({"highway": "track", "smoothness": "horrible"}, schemas.ROUGH | schemas.VERY_ROUGH)):
        assert all(e["flags"] & flag == flag for e in edges_of(graph_of(spark, [(1, [100, 101], own)])))
    assert not any(e["flags"] & schemas.TRAIL for e in edges_of(graph_of(spark, [(1, [100, 101], {"highway": "track"})])))


def test_bbox_private_and_missing_nodes(spark):
    box = (-116.5, 46.9, -115.5, 47.005)
    graph = graph_of(spark, [(1, [100, 101], {"highway": "track"})], bbox=box)
    assert graph.nodes.count() == 1 and edges_of(graph) == []
    # no bridge over a node that is missing; nodes of private ways stay
    graph = graph_of(spark, [(1, [100, 999, 101], {"highway": "track"}), (2, [101, 102], {"highway": "track", "access": "private"})])
    assert graph.nodes.count() == 3 and edges_of(graph) == []
    assert len(edges_of(graph_of(spark, [(2, [101, 102], {"highway": "track", "access": "private"})], keep_private=True))) == 2


def feature_table(spark, *rows):
    return spark.createDataFrame([(i, round(a * 1e7), round(o * 1e7), k) for i, (a, o, k) in enumerate(rows)], schemas.SCENIC_FEATURES)


def test_scenic_scores(spark):
    way = [(1, [100, 101], {"highway": "track"})]

    def score(*features):
        return edges_of(graph_of(spark, way, features=feature_table(spark, *features)))[0]["scenic_score"]

    assert score((47.0045, -116.0, "Viewpoint")) > 0
    assert score((48.0, -116.0, "Stream")) == 0
    assert score((47.05, -116.0, "Glacier")) > score((47.05, -116.0, "Stream"))
    assert score((47.05, -116.0, "Forest")) > 0 and score((47.05, -116.0, "ProtectedArea")) > 0
    assert score(*[(47.0045, -116.0, "Viewpoint")] * 9) == 255
    # 12 km due east is within 15 km, but outside the box in degrees
    assert score((47.0045, -116.0 + 12 / (111.195 * math.cos(math.radians(47))), "ProtectedArea")) == 0


def test_scenic_centre(spark):
    nodes = node_table(spark, {1: (45.0, -122.0), 2: (46.0, -124.0)})
    got = scenic.way_features(way_table(spark, (42, [1, 2, 999], {"landuse": "forest"}), (43, [998], {"landuse": "forest"})), nodes).collect()
    assert [tuple(r) for r in got] == [(-42, 455000000, -1230000000, "Forest")]


# ----------------------------------------------------------------- contraction


def graph_table(spark, edges, n=None):
    """edges: (src, dst, cost, length, flags, scenic), numbered in order."""
    n = n or 1 + max(max(e[0], e[1]) for e in edges)
    nodes = spark.createDataFrame([(i, 470000000 + i * 1000, -1160000000) for i in range(n)], schemas.GRAPH_NODES)
    rows = sorted((s, d, *rest) for s, d, *rest in edges)
    table = spark.createDataFrame([(i, s, d, *(list(rest) + [1.0, 100.0, 0, 0][len(rest) :]), []) for i, (s, d, *rest) in enumerate(rows)], schemas.GRAPH_EDGES)
    return ways.Graph(nodes, table)


def two_way(*pairs):
    return [e for s, d, *rest in pairs for e in ((s, d, *rest), (d, s, *rest))]


def test_chain_contracts(spark):
    graph = contract.contract(graph_table(spark, two_way((0, 1), (1, 2), (2, 3), (3, 4))))
    edges = edges_of(graph)
    assert graph.nodes.count() == 2 and len(edges) == 2
    assert all((e["cost"], e["length_m"], len(e["polyline"])) == (4.0, 400.0, 3) for e in edges)
    forward, back = ([p["lat_e7"] for p in e["polyline"]] for e in edges)
    assert forward == back[::-1] == sorted(forward)


def test_chain_combines_flags_and_scores(spark):
    edges = edges_of(contract.contract(graph_table(spark, two_way((0, 1, 1.0, 100.0, 1, 5), (1, 2, 2.0, 50.0, 2, 9)))))
    assert [(e["cost"], e["length_m"], e["flags"], e["scenic_score"]) for e in edges] == [(3.0, 150.0, 3, 9)] * 2


def test_cycles_stay(spark):
    for edges in (two_way((0, 1), (1, 2), (2, 0)), two_way((0, 1), (1, 3), (0, 2), (2, 3))):
        graph = contract.contract(graph_table(spark, edges))
        assert graph.nodes.count() == len(edges) // 2 and len(edges_of(graph)) == len(edges)


STUBS = [(0, 8), (0, 9), (1, 10), (1, 11)]


def test_parallel_chains(spark):
    graph = contract.contract(graph_table(spark, two_way((0, 4), (4, 1), (0, 3), (3, 1), *STUBS), 12))
    # the chain over node 3 is contracted, the one over node 4 stays; 2, 5, 6, 7 are lone nodes
    assert graph.nodes.count() == 11
    assert sorted(len(e["polyline"]) for e in edges_of(graph)) == [0] * 12 + [1, 1]


def test_one_way_chain_and_dead_chain(spark):
    stubs = two_way((0, 8), (0, 9), (1, 10), (1, 11))
    through = contract.contract(graph_table(spark, [(0, 2), (2, 1), *stubs], 12))
    assert sum(len(e["polyline"]) for e in edges_of(through)) == 1
    dead = contract.contract(graph_table(spark, [(0, 2), (1, 2), *stubs], 12))
    assert dead.nodes.count() == 12 and len(edges_of(dead)) == 10


def test_lollipop_becomes_loops(spark):
    graph = contract.contract(graph_table(spark, two_way((0, 1), (1, 2), (2, 0), (0, 3), (0, 4))))
    loops = [e for e in edges_of(graph) if e["src"] == e["dst"]]
    assert len(loops) == 2 and all(e["length_m"] == 300 for e in loops)


def test_long_chain_needs_few_rounds(spark):
    graph = contract.contract(graph_table(spark, two_way(*((i, i + 1) for i in range(150)))))
    assert [(e["length_m"], len(e["polyline"])) for e in edges_of(graph)] == [(15000.0, 149)] * 2


# ------------------------------------------------------------- spatial, requests


def test_nearest_ranks_in_degrees_then_id(spark):
    points = spark.createDataFrame([(1, 60.0, 10.0), (2, 0.0, 0.0)], "k long, lat double, lon double")
    targets = spark.createDataFrame([(5, 60.0, 10.015), (6, 60.01, 10.0), (8, 0.0, -3.0), (7, 3.0, 0.0)], "t_id long, t_lat double, t_lon double")
    got = {r.k: r.t_id for r in spatial.nearest(points, "k", targets, 0.01).collect()}
    assert got == {1: 6, 2: 7}  # by metres 5 is nearer to the first point; 7 and 8 tie
    assert spatial.nearest(points, "k", targets.limit(0), 1.0).count() == 0


def test_nearest_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    points = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(80)] + [(99, 80.0, 170.0)]
    targets = [(i, rng.uniform(-1, 1) ** 3 * 2, rng.uniform(-1, 1) ** 3 * 2) for i in range(50)]
    got = {r.k: r.t_id for r in spatial.nearest(spark.createDataFrame(points, "k long, lat double, lon double"), "k", spark.createDataFrame(targets, "t_id long, t_lat double, t_lon double"), 0.05).collect()}
    assert got == {k: min(targets, key=lambda t: ((t[1] - a) ** 2 + (t[2] - o) ** 2, t[0]))[0] for k, a, o in points}


BASE = dict(request_id=1, from_lat=47.0, from_lon=-116.0, to_lat=47.2, to_lon=-116.0, tank_range_km=None, avoid_paved=False, avoid_fords=False, prefer_scenic=False, scenic_weight=1.0, alternatives=1, diversity=0.35, max_detour=1.6, vehicle="high-clearance", fuel_buffer=0.2)


def request_table(spark, *changes):
    names = [f.split(" ")[0] for f in schemas.REQUESTS.split(", ")]
    rows = [{**BASE, "lambda": 1.5, "request_id": i, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.REQUESTS)


def test_validation(spark):
    bad = [({"from_lat": 91.0}, "from latitude"), ({"to_lon": -200.0}, "to longitude"), ({"max_detour": -1.0}, "max_detour"), ({"diversity": 1.5}, "diversity"), ({"scenic_weight": 1.5}, "scenic_weight"), ({"from_lat": None}, "from latitude missing"), ({"from_lat": 95.0, "diversity": 2.0}, "from latitude 95.0"), ({}, None)]
    for r, (_, text) in zip(requests.validate(request_table(spark, *(c for c, _ in bad))).orderBy("request_id").collect(), bad, strict=True):
        assert (r.error is None) == (text is None) and (text is None or r.error.startswith(text))


@pytest.mark.parametrize(
    ("own", "flags", "score", "expected"),
    [
        ({"avoid_paved": True, "prefer_scenic": True}, schemas.PAVED, 255, 10.0), ({"avoid_fords": True, "avoid_paved": True}, schemas.PAVED | schemas.FORD, 0, 20.0),
        ({"prefer_scenic": True}, 0, 255, 0.65), ({"prefer_scenic": True, "scenic_weight": 0.5}, 0, 255, 0.825), ({"prefer_scenic": True}, 0, 0, 1.0), ({}, 0, 255, 1.0),
        ({}, schemas.TRAIL, 0, 9999.0), ({"vehicle": "dirtbike"}, schemas.TRAIL, 0, 1.0), ({"vehicle": "4x4", "prefer_scenic": True}, schemas.FOURWD_ONLY, 255, 1.0), ({}, schemas.FOURWD_ONLY, 0, 4.0),
        ({"vehicle": "bicycle"}, schemas.FOURWD_ONLY, 0, 4.0), ({"vehicle": "stock-suv"}, schemas.ROUGH, 0, 9999.0), ({}, schemas.ROUGH, 0, 1.0), ({}, schemas.VERY_ROUGH, 0, 9999.0), ({"vehicle": "4x4"}, schemas.VERY_ROUGH, 0, 1.0),
    ],
)
def test_penalties_in_sql_and_kernel(spark, own, flags, score, expected):
    import numpy as np

    asked = requests.with_vehicle(request_table(spark, own), PROFILE)
    edges = graph_table(spark, [(0, 1, 1.0, 100.0, flags, score)]).edges
    assert routes.edge_penalties(asked, edges).first().penalty == pytest.approx(expected)
    assert routes.penalty_array(np.array([flags]), np.array([score]), asked.first(), PROFILE)[0] == pytest.approx(expected)


DIAMOND = {0: (47.0, -116.0), 1: (47.1, -116.1), 2: (47.1, -115.9), 3: (47.2, -116.0)}


def test_plan_routes_both_ways(spark):
    graph = graph_of(spark, [(1, [0, 1, 3], {"highway": "track"}), (2, [0, 2, 3], {"highway": "track", "surface": "asphalt"})], DIAMOND)
    assert graph.edges.count() == 8 and contract.contract(graph).edges.count() == 8
    asked = request_table(spark, {"alternatives": 2}, {"avoid_paved": True}, {"from_lat": 48.0}, {"to_lat": 99.0}, {"alternatives": 0}, {"to_lat": 47.0})
    for limit in (10**6, 0):  # broadcast graph, graph in cells
        found, errors = routes.plan_routes(asked, graph, PROFILE, limit)
        rows = {(r.request_id, r["rank"]): r for r in found.collect()}
        assert set(rows) == {(0, 1), (0, 2), (1, 1), (5, 1)}
        assert rows[(0, 1)].unpaved_fraction == 1 and rows[(0, 2)].unpaved_fraction == 0
        assert rows[(1, 1)].unpaved_fraction == 1 and rows[(5, 1)].edges == []
        assert {(r.request_id, r.status) for r in errors.collect()} == {(2, 400), (3, 422), (4, 400)}


def test_score_prefers_unpaved_and_short(spark):
    s = lambda u, n, m: spark.range(1).select(routes.score(*(F.lit(float(x)) for x in (u, n, m)))).first()[0]
    assert s(1, 100, 100) > s(0, 100, 100) and s(0.5, 150, 100) == pytest.approx(0.3 - 0.2)


# ---------------------------------------------------------------- forest roads


def record(i, *parts, status="EX - EXISTING", level="3 - X"):
    return (i, status, level, "ALL", None, None, None, [[{"lon": float(x), "lat": float(y)} for y, x in p] for p in parts])


def test_road_ways_snap_and_merge(spark):
    nodes = node_table(spark, {7: (47.0, -116.0), 8: (47.0002, -116.0)})
    records = spark.createDataFrame(
        [record(0, [(47.00005, -116.0), (47.01, -116.0), (47.02, -116.0)]), record(1, [(47.02, -116.0), (47.01, -116.0), (47.03, -116.0)], [(1.0, 1.0)]), record(2, [(47, -116), (48, -116)], status="CN")], schemas.USFS_RECORDS
    )
    made, new = conflate.road_ways(records, nodes)
    lists = {r.way_id: r.nodes for r in made.collect()}
    assert lists == {-1: [7, -1, -2], -2: [-2, -1, -3]}
    assert {r.osm_id: r.lat for r in new.collect()} == {-1: 47.01, -2: 47.02, -3: 47.03}
    assert conflate.road_parts(records, (-117, 40, -115, 47.005)).count() == 1


def test_conflation(spark):
    nodes = node_table(spark, {1: (47.0, -116.0), 2: (47.001, -116.0), 3: (47.002, -116.0), 4: (47.5, -116.0), 5: (47.501, -116.0)})
    roads = node_table(spark, {-1: (47.0005, -116.0), -2: (47.0015, -116.0003)})
    table = way_table(spark, (1, [1, 2, 3], {"highway": "track"}), (2, [1, 2], {"highway": "primary"}), (3, [4, 5], {"highway": "path"}), (4, [1, 2, 4, 5, 999], {"highway": "track"}), (5, [1], {"highway": "track"}))
    got = {r.way_id: r.coverage for r in conflate.coverage(table, nodes, roads).collect()}
    assert got == pytest.approx({1: 1.0, 2: 1.0, 3: 0.0, 4: 1 / 3})
    assert sorted(r.way_id for r in conflate.uncovered(table, nodes, roads).collect()) == [2, 3, 4, 5]


# ------------------------------------------------------------------- store, files


def test_store(spark, tmp_path):
    graph = graph_of(spark, [(1, [100, 101, 102], {"highway": "track"})])
    path = str(tmp_path / "g")
    with pytest.raises(store.StoreError, match="rebuild"):
        store.load(spark, path)
    store.save(graph, path, "abc")
    again = store.load(spark, path, "abc")
    assert edges_of(again) == edges_of(graph) and again.fuel_stations.count() == 0
    assert store.inspect(spark, path).first()["edges"] == 4
    with pytest.raises(store.StoreError, match="profile"):
        store.load(spark, path, "other")
    from datetime import datetime

    store.save(graph, path, "abc", datetime(2001, 1, 1))
    with pytest.warns(UserWarning, match="older"):
        store.load(spark, path)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def deltas(values):
    return b"".join(varint((d << 1) ^ (d >> 63)) for d in (b - a for a, b in zip([0, *values], values)))


def pbf(path, nodes, plain, way_rows):
    strings = sorted({s for *_, t in [*nodes, *plain, *way_rows] for kv in t for s in kv})
    number = {s: i + 1 for i, s in enumerate(strings)}
    ids = lambda t, i: b"".join(varint(number[kv[i]]) for kv in t)
    signed = lambda v: (v << 1) ^ (v >> 63)
    dense = field(1, deltas([n[0] for n in nodes])) + field(8, deltas([n[1] for n in nodes])) + field(9, deltas([n[2] for n in nodes]))
    dense += field(10, b"".join(b"".join(varint(number[s]) for kv in t for s in kv) + b"\0" for *_, t in nodes))
    groups = [field(2, dense), b"".join(field(1, field(1, signed(i)) + field(2, ids(t, 0)) + field(3, ids(t, 1)) + field(8, signed(a)) + field(9, signed(o))) for i, a, o, t in plain)]
    groups += [b"".join(field(3, field(1, i) + field(2, ids(t, 0)) + field(3, ids(t, 1)) + field(8, deltas(refs))) for i, refs, t in way_rows)]
    table = field(1, b"".join(field(1, s.encode()) for s in ["", *strings]))
    with open(path, "wb") as f:
        for kind, body in [("OSMHeader", b""), *(("OSMData", table + field(2, g)) for g in groups)]:
            blob = field(2, len(body)) + field(3, zlib.compress(body)) if kind == "OSMData" else field(1, body)
            header = field(1, kind.encode()) + field(3, len(blob))
            f.write(struct.pack(">I", len(header)) + header + blob)


def test_pbf_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.osm.pbf")
    nodes = [(5, 470000000, -1160000000, [("natural", "peak")]), (3, 470100000, -1160000001, []), (9, -1, 2, [("a", "b"), ("a", "c")])]
    pbf(path, nodes, [(77, 10, -20, [("amenity", "fuel")])], [(11, [5, 3, 9], [("highway", "track"), ("highway", "path")]), (12, [], [])])
    got = {r.osm_id: (r.lat, r.lon, r.tags) for r in osm_pbf.read(spark, path, "node").collect()}
    assert got == {5: (47.0, pytest.approx(-116.0), {"natural": "peak"}), 3: (pytest.approx(47.01), pytest.approx(-116.0000001), {}), 9: (pytest.approx(-1e-7), pytest.approx(2e-7), {"a": "c"}), 77: (pytest.approx(1e-6), pytest.approx(-2e-6), {"amenity": "fuel"})}
    assert {r.way_id: (r.nodes, r.tags) for r in osm_pbf.read(spark, path, "way").collect()} == {11: ([5, 3, 9], {"highway": "path"}), 12: ([], {})}


def write_shapefile(base, rows):
    """rows: (type, parts, attributes)."""
    names = [(n, 40) for n in shapefile.ATTRIBUTES if n != "NAME"]
    shp, index = b"", b""
    for i, (kind, parts, _) in enumerate(rows):
        points = [p for part in parts for p in part]
        starts = [sum(len(x) for x in parts[:j]) for j in range(len(parts))]
        body = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points) if kind else struct.pack("<i", 0)
        index += struct.pack(">2i", 50 + len(shp) // 2, len(body) // 2)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
    open(f"{base}.shp", "wb").write(b"\0" * 100 + shp)
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in names) + b"LEN".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    width = 1 + sum(w for _, w in names) + 5
    head = struct.pack("<4BIHH20x", 3, 20, 1, 1, len(rows), 33 + len(fields), width)
    data = b"".join(b" " + b"".join(a.get(n, "").encode().ljust(w) for n, w in names) + b"12345" for _, _, a in rows)
    open(f"{base}.dbf", "wb").write(head + fields + b"\r" + data + b"\x1a")
    return b"\0" * 100 + index


def test_shapefile(spark, tmp_path):
    base = str(tmp_path / "roads")
    rows = [(3, [[(-116.0, 47.0), (-116.1, 47.1)], [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]], {"ROUTE_STAT": "EX - EXISTING", "OPER_MAINT": " 2 - X "}), (0, [], {}), (13, [[(1.0, 1.0), (2.0, 2.0)]], {"ROUTE_STAT": "EX"})]
    index = write_shapefile(base, rows)
    for write_index in (False, True):
        if write_index:
            open(f"{base}.shx", "wb").write(index)
        got = shapefile.read(spark, f"{base}.shp").orderBy("record_id").collect()
        assert [[[(p.lon, p.lat) for p in part] for part in r.parts] for r in got] == [r[1] for r in rows]
        assert (got[0].ROUTE_STAT, got[0].OPER_MAINT, got[0].NAME, got[1].ROUTE_STAT) == ("EX - EXISTING", "2 - X", None, "")


def test_build_with_forest_roads(spark):
    nodes = node_table(spark, THREE)
    records = spark.createDataFrame([record(0, [(47.018, -116.0), (47.03, -116.0), (47.04, -116.01)])], schemas.USFS_RECORDS)
    graph = build(way_table(spark, (1, [100, 101, 102], {"highway": "track"})), nodes, PROFILE, usfs_records=records, simplify=False)
    assert graph.nodes.count() == 5 and graph.edges.count() == 8


def test_scenic_pairs_are_all_found_and_few_more_are_tested(spark):
    """All kinds over a dense field, at latitudes where a degree of longitude is narrow, against every pair."""
    from trailgraph.operators import scenic

    for base in (0.0, 47.0, -70.0):
        points = spark.range(400).select("id", (F.lit(base) + (F.col("id") * 37 % 101) * 0.004).alias("lat"), (F.lit(10.0) + (F.col("id") * 53 % 103) * 0.004).alias("lon"))
        kinds = F.array(*map(F.lit, sorted(scenic.KINDS)))
        places = spark.range(330).select((F.lit(base) + (F.col("id") * 29 % 97) * 0.0043).alias("f_lat"), (F.lit(10.0) + (F.col("id") * 41 % 89) * 0.0047).alias("f_lon"), F.get(kinds, (F.col("id") % len(scenic.KINDS)).cast("int")).alias("kind"))
        places = places.withColumns({"radius": scenic.radius(F.col("kind")), "weight": F.lit(1.0)})
        near = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")) <= F.col("radius")
        inside = (F.abs(F.col("lat") - F.col("f_lat")) <= scenic.BOX) & (F.abs(F.col("lon") - F.col("f_lon")) <= scenic.BOX)
        pairs = scenic.candidates(points, places)
        met = pairs.where(near & inside).count()
        every = points.join(places, near & inside)
        assert met == every.count() > 1000 and pairs.count() <= 4 * met
