"""The registered queries of the road-network operators, each over the derived network of a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import schemas
from .fixture import EVENT_VEHICLE, Network
from .fixture_files import write_extract, write_shapes
from .functions import geo, tags
from .functions.storage import materialise, shared_path
from .operators import conflate, contract, fuel, requests, routes, scenic, ways
from .plans.build import build
from .plans.profile import load_profile, usage
from .sources import gpx, osm_pbf, shapefile, store

BBOX = (-121.95, 44.02, -121.7, 44.3)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_prepared: dict[tuple, object] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _filter(**options) -> tags.WayFilter:
    return tags.WayFilter(load_profile().allowed, **options)


def _kept(net: Network, **options) -> DataFrame:
    return net.ways().where(_filter(**options).keep(F.col("tags")))


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    """Tables that several queries start from are made once a session and read from their materialised form."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _prepared:
        _prepared[key] = make()
    return _prepared[key]


def _is_made(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _prepared


def _graph(spark: SparkSession, sf_dir: str, contracted: bool = False) -> ways.Graph:
    def make():
        net = Network(spark, sf_dir)
        graph = ways.build_graph(_kept(net), net.nodes(), load_profile(), net.scenic_features(), fuel=net.fuel_stations())
        return ways.Graph(materialise(graph.nodes), materialise(graph.edges), materialise(graph.fuel_stations))

    def make_contracted():
        graph = contract.contract(_graph(spark, sf_dir))
        return ways.Graph(materialise(graph.nodes), materialise(graph.edges), graph.fuel_stations)

    return _once(spark, sf_dir, "contracted" if contracted else "graph", make_contracted if contracted else make)


def _segments(net: Network, features: bool = False) -> DataFrame:
    kept = _kept(net)
    located = ways.graph_nodes(kept, net.nodes())
    return ways.costed_segments(kept, located, load_profile(), net.scenic_features() if features else None)


def _d(column: str, places: int):
    return F.round(F.col(column).cast("double"), places).alias(column.rpartition(".")[2])


# ------------------------------------------------------------------ sources, filters, projections


@query
def road_nodes(spark, sf_dir):
    return Network(spark, sf_dir).nodes()


@query
def road_ways(spark, sf_dir):
    t = F.col("tags")
    names = {k: k for k in ("highway", "surface", "smoothness", "tracktype", "ford", "oneway", "seasonal", "access")} | {"4wd_only": "fourwd"}
    return Network(spark, sf_dir).ways().select("way_id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), *(tags.raw_tag(t, k).alias(n) for k, n in names.items()))


def _extract(spark, sf_dir) -> str:
    return _once(spark, sf_dir, "extract", lambda: write_extract(Network(spark, sf_dir)))


def _shapes(spark, sf_dir) -> str:
    return _once(spark, sf_dir, "shapes", lambda: write_shapes(Network(spark, sf_dir)))


@query
def extract_nodes(spark, sf_dir):
    """The nodes of an extract, read from its file."""
    t = F.col("tags")
    found = osm_pbf.read(spark, _extract(spark, sf_dir), "node")
    return found.select("osm_id", F.round(F.col("lat") * 1e7).cast("long").alias("lat_e7"), F.round(F.col("lon") * 1e7).cast("long").alias("lon_e7"), *(tags.raw_tag(t, k).alias(k) for k in ("tourism", "natural", "waterway", "amenity")))


@query
def extract_ways(spark, sf_dir):
    """The ways of an extract, read from its file."""
    t = F.col("tags")
    names = {k: k for k in ("highway", "surface", "smoothness", "tracktype", "ford", "oneway", "seasonal", "access")} | {"4wd_only": "fourwd"}
    found = osm_pbf.read(spark, _extract(spark, sf_dir), "way")
    return found.select("way_id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), *(tags.raw_tag(t, k).alias(n) for k, n in names.items()))


@query
def shapefile_records(spark, sf_dir):
    """Forest roads, read from a shapefile and its attribute table; empty fields come as empty texts."""
    found = shapefile.read(spark, _shapes(spark, sf_dir))
    return found.select("record_id", "ROUTE_STAT", "OPER_MAINT", "OPENFORUSE", "OBJECTIVE_", "SURFACE_TY", "NAME", F.size("parts").alias("n_parts"))


@query
def shapefile_points(spark, sf_dir):
    found = shapefile.read(spark, _shapes(spark, sf_dir)).select("record_id", F.posexplode("parts").alias("part_no", "points"))
    return found.select("record_id", "part_no", F.posexplode("points").alias("pos", "p")).select("record_id", "part_no", "pos", _d("p.lat", 9), _d("p.lon", 9))


@query
def way_filter(spark, sf_dir):
    return _kept(Network(spark, sf_dir)).select("way_id", tags.get_tag(F.col("tags"), "highway").alias("highway"))


@query
def way_filter_keep_private(spark, sf_dir):
    return _kept(Network(spark, sf_dir), keep_private=True, motorized=False).select("way_id")


@query
def skip_tracks(spark, sf_dir):
    return _kept(Network(spark, sf_dir), skip_tracks=True).select("way_id")


@query
def tag_map(spark, sf_dir):
    """Pairs with a repeated key become a map in which the last one stays; empty tags count as missing."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    pairs = F.array(pair("status", F.lit("old")), pair("note", F.col("o_orderpriority")), pair("opt", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("set")), pair("status", F.col("o_orderstatus")))
    mapped = Network(spark, sf_dir).read("orders").select(F.col("o_orderkey").alias("way_id"), tags.tags_of(pairs).alias("t"))
    return mapped.select("way_id", *(tags.get_tag(F.col("t"), k).alias(k) for k in ("status", "note", "opt")))


@query
def scenic_classify_node(spark, sf_dir):
    return scenic.node_features(Network(spark, sf_dir).tagged_nodes()).select("osm_id", "kind")


@query
def scenic_classify_way(spark, sf_dir):
    return Network(spark, sf_dir).ways().select("way_id", tags.scenic_kind(F.col("tags"), on_way=True).alias("kind")).where("kind is not null")


@query
def scenic_centroid(spark, sf_dir):
    """Centres, cut to microdegrees: sums of doubles may differ in the last place."""
    net = Network(spark, sf_dir)
    found = net.ways().withColumn("kind", tags.scenic_kind(F.col("tags"), on_way=True)).where("kind is not null")
    places = found.select("way_id", "kind", F.explode("nodes").alias("osm_id")).join(net.nodes(), "osm_id")
    centre = places.groupBy("way_id", "kind").agg(*(F.round(F.avg(c), 9).alias(c) for c in ("lat", "lon")))
    return centre.select((-F.col("way_id")).alias("osm_id"), "kind", *((F.col(c) * 1e6).cast("int").alias(f"{c}_e6") for c in ("lat", "lon")))


@query
def scenic_union(spark, sf_dir):
    net = Network(spark, sf_dir)
    both = scenic.node_features(net.tagged_nodes()).unionByName(scenic.way_features(net.ways(), net.nodes()))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def needed_nodes_semi(spark, sf_dir):
    net = Network(spark, sf_dir)
    candidates = net.ways().where(tags.scenic_kind(F.col("tags"), on_way=True).isNotNull())
    return ways.needed_coordinates(net.nodes(), _kept(net), candidates)


@query
def fuel_extract(spark, sf_dir):
    return ways.fuel_stations(Network(spark, sf_dir).tagged_nodes())


@query
def bbox_derive(spark, sf_dir):
    return ways.derived_bbox(Network(spark, sf_dir).nodes())


@query
def bbox_parse(spark, sf_dir):
    """Nodes in a box that is given as text."""
    box = geo.parse_bbox(" -121.95,44.02 , -121.7,44.3")
    return Network(spark, sf_dir).nodes().where(geo.in_bbox(F.col("lat"), F.col("lon"), box)).select("osm_id")


@query
def bbox_filter(spark, sf_dir):
    return Network(spark, sf_dir).nodes().where(geo.in_bbox(F.col("lat"), F.col("lon"), BBOX)).select("osm_id")


@query
def e7_quantize(spark, sf_dir):
    return Network(spark, sf_dir).nodes().select("osm_id", geo.to_e7(F.col("lat") + 0.00000005).alias("lat_e7"), geo.to_e7(F.col("lon") - 0.00000005).alias("lon_e7"))


@query
def e7_dequantize(spark, sf_dir):
    """Both ways back to degrees; they may differ in the last bit, and each has its use."""
    points = Network(spark, sf_dir).fuel_stations()
    return points.select("osm_id", geo.from_e7(F.col("lat_e7")).alias("lat"), geo.from_e7_scaled(F.col("lon_e7")).alias("lon"))


@query
def grid_cells(spark, sf_dir):
    """Nodes by grid cell, at the fixed step of snapping and at the profile's step."""
    step = load_profile().routing.grid_step
    cells = Network(spark, sf_dir).nodes().select(geo.cell(F.col("lat"), conflate.SNAP_STEP).alias("ci"), geo.cell(F.col("lon"), step).alias("cj"))
    return cells.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n"))


@query
def flag_counts(spark, sf_dir):
    """Ways by flag."""
    flags = _kept(Network(spark, sf_dir), keep_private=True).select(tags.edge_flags(F.col("tags"), load_profile().routing).alias("f"))
    names = {"paved": schemas.PAVED, "ford": schemas.FORD, "fourwd_only": schemas.FOURWD_ONLY, "seasonal": schemas.SEASONAL, "private": schemas.PRIVATE, "trail": schemas.TRAIL, "rough": schemas.ROUGH, "very_rough": schemas.VERY_ROUGH}
    return flags.agg(*(F.count_if(tags.has_flag(F.col("f"), bit)).alias(name) for name, bit in names.items()))


@query
def haversine_len(spark, sf_dir):
    return _segments(Network(spark, sf_dir)).select("way_id", "pos", _d("length_m", 3))


@query
def edge_flags(spark, sf_dir):
    return _kept(Network(spark, sf_dir)).select("way_id", tags.edge_flags(F.col("tags"), load_profile().routing).alias("flags"))


@query
def factor_lookup(spark, sf_dir):
    return ways.costed_ways(_kept(Network(spark, sf_dir)), load_profile()).select("way_id", "f_base", "f_surface", "f_tracktype", "f_smoothness", "f_ford")


@query
def edge_cost(spark, sf_dir):
    return _segments(Network(spark, sf_dir)).select("way_id", "pos", _d("cost", 3))


@query
def segments_lead(spark, sf_dir):
    rows = _kept(Network(spark, sf_dir)).select("way_id", F.posexplode("nodes").alias("pos", "osm_id"))
    return ways.segments_by_window(rows)


@query
def bidirectional_edges(spark, sf_dir):
    return ways.directed(_segments(Network(spark, sf_dir))).select("way_id", "pos", "dir", "src", "dst")


@query
def bbox_segments(spark, sf_dir):
    """Segments kept and dropped where a box cuts the nodes: a segment needs both ends, and nothing bridges a gap."""
    net = Network(spark, sf_dir)
    kept = _kept(net)
    located = ways.graph_nodes(kept, net.nodes(), BBOX)
    total = ways.segments(kept).agg(F.count(F.lit(1)).alias("total"))
    placed = ways.costed_segments(kept, located, load_profile()).agg(F.count(F.lit(1)).alias("kept"))
    return total.join(placed).select("kept", (F.col("total") - F.col("kept")).alias("dropped"))


@query
def node_ids_first_encounter(spark, sf_dir):
    net = Network(spark, sf_dir)
    return ways.graph_nodes(_kept(net), net.nodes())


@query
def edge_ids_total_order(spark, sf_dir):
    edges = ways.directed(_segments(Network(spark, sf_dir)))
    return ways.numbered_edges(edges, [*ways.way_order(), F.col("pos"), F.col("dir")]).select("edge_id", "src", "dst", "way_id", "pos", "dir")


# ------------------------------------------------------------------------- graph


@query
def build_graph(spark, sf_dir):
    return _graph(spark, sf_dir).edges.select("edge_id", "src", "dst", _d("cost", 3), _d("length_m", 3), "flags", "scenic_score")


@query
def out_degree_prefix_sum(spark, sf_dir):
    """Edges are numbered by source, so a node's offset is the id of the first edge at or behind it: no running sum over all nodes."""
    graph = _graph(spark, sf_dir)
    degrees = ways.out_degrees(graph)
    total = graph.edges.count()
    behind = Window.orderBy("block")
    # nodes without edges take the offset of the next node that has some, found block by block
    blocks = degrees.withColumn("block", F.floor(F.col("node_id") / 4096))
    firsts = blocks.groupBy("block").agg(F.min("first_edge").alias("f")).withColumn("next", F.min("f").over(behind.rowsBetween(1, Window.unboundedFollowing)))
    inside = Window.partitionBy("block").orderBy("node_id").rowsBetween(0, Window.unboundedFollowing)
    offset = F.coalesce(F.min("first_edge").over(inside), F.col("next"), F.lit(total))
    return blocks.join(firsts.select("block", "next"), "block").select("node_id", "degree", offset.alias("first_edge"))


@query
def undirected_degree(spark, sf_dir):
    return ways.undirected_degrees(_graph(spark, sf_dir).edges)


@query
def first_edge_per_pair(spark, sf_dir):
    return contract.first_edges(_graph(spark, sf_dir).edges).select("src", "dst", "edge_id")


@query
def scenic_score(spark, sf_dir):
    return _segments(Network(spark, sf_dir), features=True).select("way_id", "pos", "scenic_score")


@query
def contract_chains(spark, sf_dir):
    found = contract.chains(_graph(spark, sf_dir))
    return found.select("src", "dst", "lowest", F.size("interior").alias("n_interior"), _d("cost", 2), _d("length_m", 2), "flags", "scenic_score")


@query
def contract_graph(spark, sf_dir):
    edges = _graph(spark, sf_dir, contracted=True).edges
    return edges.select("edge_id", "src", "dst", _d("cost", 2), _d("length_m", 2), "flags", "scenic_score", F.size("polyline").alias("n_points"))


@query
def graph_inspect(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    counts = [t.agg(F.count(F.lit(1)).alias(n)) for t, n in ((graph.nodes, "nodes"), (graph.edges, "edges"), (graph.fuel_stations, "fuel_stations"))]
    return counts[0].join(counts[1]).join(counts[2])


@query
def graph_store(spark, sf_dir):
    """The edges of a graph that was written and read again."""
    path = shared_path(spark, "graph-store")
    store.save(_graph(spark, sf_dir), path, load_profile().fingerprint())
    edges = store.load(spark, path, load_profile().fingerprint()).edges
    return edges.select("edge_id", "src", "dst", _d("cost", 3), _d("length_m", 3), "flags", "scenic_score", F.size("polyline").alias("n_points"))


@query
def profile_fingerprint(spark, sf_dir):
    """The fingerprint that a stored graph carries, with the edges it stands for."""
    path = shared_path(spark, "graph-fingerprint")
    store.save(_graph(spark, sf_dir), path, load_profile().fingerprint())
    return store.inspect(spark, path).select("fingerprint", "edges")


@query
def private_segments(spark, sf_dir):
    """Segments with and without private ways, where the filter lets them through; their nodes are numbered either way."""
    net = Network(spark, sf_dir)
    kept = _kept(net, keep_private=True)
    located = materialise(ways.graph_nodes(kept, net.nodes()))
    every, public = (ways.costed_segments(kept, located, load_profile(), keep_private=k).select("way_id", "pos", "src", "dst") for k in (True, False))
    return every.join(public.withColumn("open", F.lit(True)), ["way_id", "pos", "src", "dst"], "left").withColumn("open", F.coalesce("open", F.lit(False)))


@query
def scenic_in_box(spark, sf_dir):
    """Scores by the features inside a box alone."""
    net = Network(spark, sf_dir)
    kept = _kept(net)
    located = ways.graph_nodes(kept, net.nodes())
    return ways.costed_segments(kept, located, load_profile(), net.scenic_features(), bbox=BBOX).select("way_id", "pos", "scenic_score").where("scenic_score > 0")


@query
def profile_report(spark, sf_dir):
    """The profile's report, with the ways that each entry prices."""
    return usage(load_profile(), Network(spark, sf_dir).ways())


# ------------------------------------------------------------------ forest roads


def _roads(net: Network, spark, sf_dir):
    return _once(spark, sf_dir, "roads", lambda: tuple(map(materialise, conflate.road_ways(net.usfs_records(), net.nodes()))))


@query
def usfs_tags(spark, sf_dir):
    records = Network(spark, sf_dir).usfs_records().where(tags.existing(F.col("ROUTE_STAT")))
    t = tags.usfs_tags(*(F.col(c) for c in ("OPER_MAINT", "OPENFORUSE", "OBJECTIVE_", "SURFACE_TY", "NAME")))
    names = {"highway": "highway", "4wd_only": "fourwd", "smoothness": "smoothness", "access": "access", "surface": "surface", "name": "name"}
    return records.select("record_id", t.alias("t")).select("record_id", *(tags.raw_tag(F.col("t"), k).alias(n) for k, n in names.items()))


@query
def usfs_bbox(spark, sf_dir):
    return conflate.road_parts(Network(spark, sf_dir).usfs_records(), BBOX).select("record_id", "part_no")


@query
def usfs_vertex_dedupe(spark, sf_dir):
    return _roads(Network(spark, sf_dir), spark, sf_dir)[1].select("osm_id", _d("lat", 9), _d("lon", 9))


@query
def usfs_snap_nearest(spark, sf_dir):
    net = Network(spark, sf_dir)
    return conflate.snap_ends(conflate.vertices(conflate.road_parts(net.usfs_records())).where("is_end"), net.nodes())


@query
def usfs_ways(spark, sf_dir):
    return _roads(Network(spark, sf_dir), spark, sf_dir)[0].select("way_id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query
def conflation_coverage(spark, sf_dir):
    net = Network(spark, sf_dir)
    low = _kept(net).where(tags.tag_in(F.col("tags"), "highway", tags.TRACK_CLASSES))
    return conflate.coverage(low, net.nodes(), _roads(net, spark, sf_dir)[1]).select("way_id", _d("coverage", 6))


@query
def conflation_kept(spark, sf_dir):
    net = Network(spark, sf_dir)
    return conflate.uncovered(_kept(net), net.nodes(), _roads(net, spark, sf_dir)[1]).select("way_id")


@query
def conflation_counts(spark, sf_dir):
    """Ways kept and dropped by conflation."""
    net = Network(spark, sf_dir)
    return conflate.counts(_kept(net), conflate.uncovered(_kept(net), net.nodes(), _roads(net, spark, sf_dir)[1]))


@query
def ways_union(spark, sf_dir):
    net = Network(spark, sf_dir)
    return ways.union_ways(_kept(net), _roads(net, spark, sf_dir)[0]).select("way_id")


@query
def nodes_union(spark, sf_dir):
    net = Network(spark, sf_dir)
    return ways.union_nodes(net.nodes(), _roads(net, spark, sf_dir)[1]).select("osm_id", _d("lat", 9), _d("lon", 9))


@query
def build_all(spark, sf_dir):
    """The whole build: forest roads, conflation, graph, contraction."""
    net = Network(spark, sf_dir)
    graph = build(net.ways(), net.nodes(), load_profile(), net.scenic_features(), net.fuel_stations(), net.usfs_records())
    return graph.edges.select("edge_id", "src", "dst", _d("cost", 2), "flags", "scenic_score")


# ---------------------------------------------------------------------- requests


@query
def snap_request(spark, sf_dir):
    points = Network(spark, sf_dir).event_ends().select(F.struct("event_id", "side").alias("point"), "lat", "lon")
    return routes.snap(points, "point", _graph(spark, sf_dir)).select("point.event_id", "point.side", "node_id", _d("snap_m", 6))


@query
def request_validation(spark, sf_dir):
    made = Network(spark, sf_dir).read("events").selectExpr(
        "event_id as request_id", "cast(event_id % 200 - 100 as double) as from_lat", "cast(event_id % 500 - 250 as double) as from_lon", "cast(0 as double) as to_lat", "cast(0 as double) as to_lon",
        "cast(event_id % 7 - 1 as float) as max_detour", "cast((event_id % 8 - 2) * 0.25 as float) as diversity", "cast((event_id % 6) * 0.25 as float) as scenic_weight",
    )
    return requests.validate(made).select("request_id", "error")


@query
def request_defaults(spark, sf_dir):
    """JSON bodies with and without optional fields."""
    body = """concat('{"from":[', event_id % 50, ',-120],"to":[44,-121]', if(event_id % 2 = 0, ',"alternatives":3', ''), if(event_id % 3 = 0, ',"diversity":0.5', ''), if(event_id % 5 = 0, ',"vehicle":"dirtbike"', ''),
      if(event_id % 7 = 0, ',"avoid_paved":false', ''), if(event_id % 4 = 0, ',"tank_range_km":120', ''), '}')"""
    bodies = Network(spark, sf_dir).read("events").selectExpr("event_id as request_id", f"{body} as body")
    return requests.decode(bodies).select("request_id", "from_lat", "alternatives", "diversity", "vehicle", "avoid_paved", "tank_range_km")


@query
def vehicle_fallback(spark, sf_dir):
    asked = Network(spark, sf_dir).read("events").selectExpr("event_id as request_id", f"{EVENT_VEHICLE} as vehicle")
    return requests.with_vehicle(asked, load_profile()).select("request_id", "vehicle", "vehicle_used", "fourwd_only_penalty", "min_smoothness")


def _asked(spark, sf_dir) -> DataFrame:
    return requests.with_vehicle(Network(spark, sf_dir).requests(), load_profile())


@query
def initial_penalties(spark, sf_dir):
    """For each request, by class of edges."""
    return routes.class_penalties(_asked(spark, sf_dir), _graph(spark, sf_dir).edges).select("request_id", "flags", "scenic_score", _d("penalty", 9), "n")


@query
def penalty_histogram(spark, sf_dir):
    return routes.penalty_counts(_asked(spark, sf_dir), _graph(spark, sf_dir).edges, 6)


@query
def jaccard_pairs(spark, sf_dir):
    kept = _kept(Network(spark, sf_dir)).select("way_id", "nodes", F.get("nodes", F.lit(0)).alias("start"))
    a, b = kept.select("start", F.col("way_id").alias("way_a"), F.col("nodes").alias("n_a")), kept.select("start", F.col("way_id").alias("way_b"), F.col("nodes").alias("n_b"))
    return a.join(b, "start").where("way_a < way_b").select("way_a", "way_b", routes.jaccard(F.col("n_a"), F.col("n_b")).alias("distance"))


@query
def route_rank(spark, sf_dir):
    """Ranking of many routes: order lines stand for routes."""
    lines = Network(spark, sf_dir).read("lineitem")
    number = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    made = lines.withColumn("found", (F.row_number().over(number) - 1).cast("long")).select(F.col("l_orderkey").alias("request_id"), "found", F.round(F.col("l_discount") * 10, 2).alias("unpaved_fraction"), F.col("l_quantity").alias("length_m"))
    return routes.rank_routes(made).select("request_id", "found", F.col("rank").cast("long").alias("rank"), _d("score", 9))


@query
def fuel_nearest(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    points = graph.nodes.select("node_id", geo.from_e7(F.col("lat_e7")).alias("lat"), geo.from_e7(F.col("lon_e7")).alias("lon"))
    return fuel.nearest_station(points, graph.fuel_stations).select("node_id", "station", _d("station_m", 3))


@query
def fuel_lookback(spark, sf_dir):
    """The last station passed within reach (-1: none yet), at every node of every way (which stand for routes)."""
    net = Network(spark, sf_dir)
    kept = _kept(net)
    located = ways.graph_nodes(kept, net.nodes())
    near = fuel_nearest(spark, sf_dir)
    steps = kept.select(F.col("way_id").alias("request_id"), F.lit(1).alias("rank"), F.posexplode("nodes").alias("pos", "osm_id")).join(located, "osm_id")
    points = steps.join(near, "node_id").select("request_id", "rank", "pos", "station", "station_m")
    return fuel.last_station(points).select(F.col("request_id").alias("way_id"), "pos", F.coalesce("last_station", F.lit(-1)).alias("last_station"))


@query
def cumulative_distance(spark, sf_dir):
    """Running distance along ways, which stand for routes."""
    net = Network(spark, sf_dir)
    kept = _kept(net)
    located = ways.graph_nodes(kept, net.nodes())
    steps = kept.select(F.col("way_id").alias("request_id"), F.lit(1).alias("rank"), F.posexplode("nodes").alias("pos", "osm_id")).join(located, "osm_id")
    points = steps.select("request_id", "rank", "pos", "node_id", geo.from_e7(F.col("lat_e7")).alias("lat"), geo.from_e7(F.col("lon_e7")).alias("lon"))
    return fuel.cumulative(points).select(F.col("request_id").alias("way_id"), "pos", _d("cum_m", 4))


@query
def route_stats(spark, sf_dir):
    """Totals of routes from their edges: ways, driven forward, stand for routes, each asked for by one of the requests."""
    net = Network(spark, sf_dir)
    numbered = edge_ids_total_order(spark, sf_dir).where("dir = 0")
    steps = numbered.select(F.col("way_id").alias("request_id"), F.lit(0).alias("found"), "pos", "edge_id")
    asked = _asked(spark, sf_dir).withColumnRenamed("request_id", "asker")
    number = net.read("supplier").count()
    each = steps.select("request_id").distinct().join(asked, F.pmod(F.col("request_id"), F.lit(number)) == F.col("asker")).drop("asker")
    edges = _graph(spark, sf_dir).edges
    total = routes.route_stats(steps, edges, routes.step_penalties(steps, each, edges))
    return total.select("request_id", _d("length_m", 2), _d("cost", 2), _d("unpaved_fraction", 6), "ford_count", "fourwd_only_count")


@query
def fuel_stops_along_ways(spark, sf_dir):
    """Fuel stops with a tank for a kilometre and a half, along ways that stand for routes."""
    net = Network(spark, sf_dir)
    graph = _graph(spark, sf_dir)
    kept = _kept(net)
    steps = kept.select("way_id", F.posexplode("nodes").alias("pos", "osm_id")).join(ways.graph_nodes(kept, net.nodes()), "osm_id")
    lists = steps.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("l"))
    driven = lists.select(F.col("way_id").alias("request_id"), F.lit(1).alias("rank"), F.transform("l", lambda x: x["node_id"]).alias("nodes"), F.lit(2.0).cast("float").alias("tank_range_km"), F.lit(0.25).cast("float").alias("fuel_buffer"))
    return fuel.fuel_stops(driven, graph).select(F.col("request_id").alias("way_id"), "stop_no", _d("at_distance_m", 2), "osm_id", "lat_e7", "lon_e7")


@query
def gpx_way_tracks(spark, sf_dir):
    """Track elements of ways, driven forward, as routes without stops."""
    net = Network(spark, sf_dir)
    steps = edge_ids_total_order(spark, sf_dir).where("dir = 0")
    edges = _graph(spark, sf_dir).edges.select("edge_id", "length_m", "flags")
    each = steps.join(edges, "edge_id").groupBy("way_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "src", "dst", "edge_id"))).alias("l"),
        F.sum("length_m").alias("length_m"),
        F.count_if(tags.has_flag(F.col("flags"), schemas.FORD)).cast("int").alias("ford_count"),
        F.count_if(tags.has_flag(F.col("flags"), schemas.FOURWD_ONLY)).cast("int").alias("fourwd_only_count"),
        F.when(F.max(tags.has_flag(F.col("flags"), schemas.PAVED)), 0.0).otherwise(1.0).alias("unpaved_fraction"),
    )
    nodes = F.concat(F.transform("l", lambda x: x["src"]), F.array(F.element_at("l", -1)["dst"]))
    driven = each.select(F.col("way_id").alias("request_id"), F.lit(1).alias("rank"), nodes.alias("nodes"), F.transform("l", lambda x: x["edge_id"]).alias("edges"), "length_m", "ford_count", "fourwd_only_count", "unpaved_fraction")
    none = spark.createDataFrame([], schemas.FUEL_STOPS)
    return gpx.tracks(driven, none, _graph(spark, sf_dir)).select(F.col("request_id").alias("way_id"), "xml")


# ------------------------------------------------------------------------ routes


def _planned(spark, sf_dir):
    def make():
        found, errors = routes.plan_routes(Network(spark, sf_dir).requests(), _graph(spark, sf_dir, contracted=True), load_profile())
        return materialise(found), materialise(errors)

    return _once(spark, sf_dir, "planned", make)


def _plain(spark, sf_dir, search=routes.search_routes, **ways_to_search) -> DataFrame:
    """Plain cheapest routes (no penalties) between the ends of the requests, or their costs alone."""

    def make():
        graph = _graph(spark, sf_dir)
        snapped = routes.snap_requests(requests.validate(Network(spark, sf_dir).requests()).where("error is null"), graph)
        neutral = {"avoid_paved": F.lit(False), "avoid_fords": F.lit(False), "prefer_scenic": F.lit(False), "vehicle": F.lit("dirtbike"), "alternatives": F.lit(1)}
        return materialise(search(snapped.where("error is null").withColumns(neutral), graph, load_profile(), **ways_to_search))

    return _once(spark, sf_dir, f"plain {search.__name__} {sorted(ways_to_search.items())}", make)


def _costs(spark, sf_dir, **ways_to_search) -> DataFrame:
    """What they cost; where the graph is broadcast, the routes come at no price and serve the other queries."""
    resident = routes.resident(_graph(spark, sf_dir), ways_to_search.get("broadcast_edges", routes.BROADCAST_EDGES))
    return _plain(spark, sf_dir, routes.search_routes if resident is not None else routes.search_costs, **ways_to_search)


@query
def sssp(spark, sf_dir):
    """Exact cost from the first node to every node that can be reached."""
    graph = _graph(spark, sf_dir)
    return routes.single_source(graph, 0).select("node_id", _d("cost", 3))


@query
def route_cost(spark, sf_dir):
    return _costs(spark, sf_dir).select("request_id", _d("cost", 2))


@query
def route_cost_cells(spark, sf_dir):
    """The same costs by cells and their overlay, as for a graph that no task can hold."""
    return _costs(spark, sf_dir, broadcast_edges=0, cell_nodes=512).select("request_id", _d("cost", 2))


@query
def route_path(spark, sf_dir):
    """Ends and cost of the same routes, worked out from the path: whether its edges lead from node to node, and what they cost."""
    found = _plain(spark, sf_dir)
    # a step carries its own two nodes, not its route's whole list of them
    n = F.size("edges")
    zipped = F.arrays_zip(F.col("edges").alias("edge_id"), F.slice("nodes", 1, n).alias("a"), F.slice("nodes", 2, n).alias("b"))
    steps = found.select("request_id", F.explode(zipped).alias("s")).select("request_id", "s.*")
    edges = _graph(spark, sf_dir).edges.select("edge_id", "src", "dst", F.col("cost").cast("double").alias("step"))
    fits = F.coalesce((F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), F.lit(False))
    total = steps.join(edges, "edge_id", "left").groupBy("request_id").agg(F.sum("step").alias("cost"), F.bool_and(fits).alias("connected"))
    ends = found.select("request_id", F.element_at("nodes", 1).alias("first_node"), F.element_at("nodes", -1).alias("last_node"))
    return ends.join(total, "request_id", "left").select("request_id", "first_node", "last_node", F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("cost"), F.coalesce("connected", F.lit(True)).alias("connected"))


@query
def first_route_cost(spark, sf_dir):
    """What the first route of each request costs with its penalties, on the contracted graph."""

    def make():
        found = routes.first_routes(Network(spark, sf_dir).requests(), _graph(spark, sf_dir, contracted=True), load_profile())
        return materialise(found.select("request_id", "found", "cost"))

    found = _planned(spark, sf_dir)[0] if _is_made(spark, sf_dir, "planned") else _once(spark, sf_dir, "first", make)
    return found.where("found = 0").select("request_id", _d("cost", 2))


@query
def k_alternatives(spark, sf_dir):
    found = _planned(spark, sf_dir)[0]
    return found.select("request_id", "rank", "found", F.size("edges").alias("n_edges"), _d("length_m", 2), _d("cost", 2), _d("unpaved_fraction", 6), "ford_count", "fourwd_only_count", _d("score", 6))


@query
def route_errors(spark, sf_dir):
    """The requests without a route, which takes no search for routes."""
    if _is_made(spark, sf_dir, "planned"):
        return _planned(spark, sf_dir)[1]
    return routes.plan_errors(Network(spark, sf_dir).requests(), _graph(spark, sf_dir, contracted=True), load_profile())


@query
def planned_stats(spark, sf_dir):
    """Totals of the planned routes recomputed from their edges."""
    found = _planned(spark, sf_dir)[0]
    graph = _graph(spark, sf_dir, contracted=True)
    steps = found.select("request_id", "found", F.posexplode("edges").alias("pos", "edge_id"))
    own = routes.step_penalties(steps, _asked(spark, sf_dir), graph.edges)
    return routes.route_stats(steps, graph.edges, own).select("request_id", "found", _d("length_m", 2), _d("unpaved_fraction", 6), "ford_count", "fourwd_only_count")


@query
def alt_diversity(spark, sf_dir):
    """The distance of every pair of a request's routes, and what it has to be."""
    pairs = routes.route_pairs(_planned(spark, sf_dir)[0]).join(Network(spark, sf_dir).requests().select("request_id", "diversity"), "request_id")
    return pairs.select("request_id", "found_a", "found_b", _d("distance", 9), _d("diversity", 6))


@query
def alt_detour(spark, sf_dir):
    """The length of every route against the first of its request, and what it may be."""
    found = _planned(spark, sf_dir)[0]
    first = found.where("found = 0").select("request_id", F.col("length_m").alias("base"))
    asked = Network(spark, sf_dir).requests().select("request_id", "max_detour")
    return found.join(first, "request_id").join(asked, "request_id").select("request_id", "found", _d("length_m", 2), F.round(F.col("base") * F.col("max_detour"), 2).alias("longest"))


def _with_range(spark, sf_dir) -> DataFrame:
    return _planned(spark, sf_dir)[0].join(Network(spark, sf_dir).requests().select("request_id", "tank_range_km", "fuel_buffer"), "request_id")


@query
def fuel_stops(spark, sf_dir):
    return fuel.fuel_stops(_with_range(spark, sf_dir), _graph(spark, sf_dir, contracted=True)).select("request_id", "rank", "stop_no", _d("at_distance_m", 2), "osm_id")


@query
def gpx_tracks(spark, sf_dir):
    graph = _graph(spark, sf_dir, contracted=True)
    stops = fuel.fuel_stops(_with_range(spark, sf_dir), graph)
    return gpx.documents(_planned(spark, sf_dir)[0], stops, graph, time=F.lit("2020-01-01T00:00:00Z"))


def oracle() -> dict[str, str]:
    from .oracle import build as build_sql

    return build_sql()
