"""The registered queries of the road-network operators in DuckDB's SQL, on the same derived rows."""

from __future__ import annotations

import re

from . import fixture as fx
from .operators.routes import FAR, NO_ROUTE
from .operators.scenic import BOX, KINDS, MAX_SCORE
from .plans.profile import Profile, load_profile

_TWO_R = "12742017.6"


#: Tags of forest roads, from ``utag``.
ROAD_TAGS = {
    "highway": "CASE WHEN level <= 3 THEN 'track' WHEN level = 4 THEN 'unclassified' ELSE 'secondary' END",
    "fourwd": "CASE WHEN level <= 2 THEN 'yes' END",
    "smoothness": "CASE WHEN level <= 1 THEN 'very_bad' END",
    "access": "CASE WHEN OBJECTIVE_ LIKE '%DECOMMISSION%' THEN 'no' WHEN trim(OPENFORUSE) = 'ADMIN' THEN 'private' END",
    "surface": "CASE WHEN sv IN ('ASPH', 'PAVE', 'CONC', 'BST', 'CHIP', 'BITU') THEN 'asphalt' WHEN sv IN ('AGG', 'GRAV', 'CRUS') THEN 'gravel' END",
    "name": """nullif(trim("NAME"), '')""",
}


def _d(text: str) -> str:
    """A fixture formula in DuckDB's words."""
    return text.replace(" div ", " // ").replace("{n}", "g_.n").replace("{w}", "g_.w").replace("as string)", "as varchar)")


def _cols(texts: dict[str, str]) -> str:
    return ", ".join(f'{_d(t)} AS "{c}"' for c, t in texts.items())


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))) * {_TWO_R})"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows) + ")"


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _canonical(profile: Profile) -> str:
    """The settings as JSON: keys in order, numbers as floats."""
    vehicle = ", ".join(f'"{k}": {{"fourwd_only_penalty": {float(v.fourwd_only_penalty)!r}, "min_smoothness": "{v.min_smoothness}", "narrow_path_bonus": {"null" if v.narrow_path_bonus is None else repr(float(v.narrow_path_bonus))}}}' for k, v in sorted(profile.vehicle.items()))
    tables = {t: ", ".join(f'"{k}": {float(v)!r}' for k, v in sorted(getattr(profile, t).items())) for t in ("base", "smoothness", "surface", "tracktype")}
    routing = ", ".join(f'"{k}": ' + ("[" + ", ".join(f'"{x}"' for x in v) + "]" if isinstance(v, tuple) else repr(float(v))) for k, v in sorted(vars(profile.routing).items()))
    tables |= {"routing": routing, "vehicle": vehicle}
    return "{" + ", ".join(f'"{t}": {{{text}}}' for t, text in sorted(tables.items())) + "}"


def _network(profile: Profile) -> str:
    lat, lon = (_d(t.replace("{id}", "c_custkey")) for t in (fx.LAT, fx.LON))
    flat, flon = map(_d, fx.offset_point("p_partkey", 100))
    slat, slon = map(_d, fx.offset_point("s_suppkey", 60))
    r = profile.routing

    factors = [(t, k, float(v)) for t in ("base", "surface", "tracktype", "smoothness") for k, v in getattr(profile, t).items()]
    node_kind = """CASE WHEN tourism = 'viewpoint' THEN 'Viewpoint' WHEN "natural" = 'peak' THEN 'Peak' WHEN "natural" = 'saddle' THEN 'Saddle' WHEN "natural" = 'water' THEN 'Water'
      WHEN "natural" = 'glacier' THEN 'Glacier' WHEN "natural" = 'cliff' THEN 'Cliff' WHEN waterway = 'river' THEN 'River' WHEN waterway = 'stream' THEN 'Stream' END"""
    way_kind = "CASE WHEN landuse = 'forest' THEN 'Forest' WHEN boundary = 'protected_area' THEN 'ProtectedArea' WHEN leisure = 'nature_reserve' THEN 'NatureReserve' END"
    level = "CASE WHEN regexp_matches(lv, '^[0-9]+$') THEN CAST(lv AS INTEGER) ELSE 3 END"
    return f"""
g_ AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM customer),
nodes AS (SELECT c_custkey AS osm_id, {lat} / 1e7 AS lat, {lon} / 1e7 AS lon FROM customer, g_),
tnodes AS (SELECT *, {_cols(fx.NODE_TAGS)} FROM nodes),
snodes AS (SELECT osm_id, {node_kind} AS kind, lat, lon, amenity FROM tnodes),
wbase AS (SELECT {_cols(fx.WAY_BASE)} FROM orders, g_ WHERE {fx.WAY_WHERE}),
ways AS (SELECT k AS way_id, [c + i * st FOR i IN range(0, len + 1) IF i = 0 OR (c + i * st < g_.n AND (st <> 1 OR (c + i * st) // g_.w = c // g_.w))] AS nodes, {_cols(fx.WAY_TAGS)} FROM wbase, g_),
sways AS (SELECT way_id, nodes, {way_kind} AS kind FROM ways),
allowed AS (SELECT highway FROM {_values([(h,) for h in profile.allowed])} AS t(highway)),
fways AS (SELECT * FROM ways WHERE highway IN (SELECT highway FROM allowed) AND coalesce(access, '') NOT IN ('no', 'private') AND coalesce(vehicle, '') <> 'no' AND coalesce(motor_vehicle, '') <> 'no'),
factors AS (SELECT tbl, k, CAST(f AS FLOAT) AS f FROM {_values(factors)} AS t(tbl, k, f)),
wflags AS (SELECT way_id, nodes, coalesce(oneway, '') = 'yes' AS is_oneway, highway, surface, tracktype, smoothness,
    CASE WHEN surface IN ({names(r.paved_surfaces)}) THEN 1 ELSE 0 END + CASE WHEN ford = 'yes' THEN 2 ELSE 0 END + CASE WHEN "4wd_only" = 'yes' THEN 4 ELSE 0 END + CASE WHEN seasonal = 'yes' THEN 8 ELSE 0 END
    + CASE WHEN access = 'private' THEN 16 ELSE 0 END + CASE WHEN highway IN ('path', 'footway', 'bridleway', 'cycleway') THEN 32 ELSE 0 END
    + CASE WHEN smoothness IN ({names(r.smoothness_rough)}) THEN 64 ELSE 0 END + CASE WHEN smoothness IN ({names(r.smoothness_very_rough)}) THEN 128 ELSE 0 END AS flags FROM fways),
wcost AS (SELECT w.way_id, w.nodes, w.is_oneway, w.flags, {", ".join(f"coalesce({t}.f, CAST(1 AS FLOAT)) AS f_{t}" for t in ("base", "surface", "tracktype", "smoothness"))},
    CAST(CASE WHEN w.flags & 2 = 2 THEN {r.ford_penalty} ELSE 1.0 END AS FLOAT) AS f_ford
    FROM wflags w {" ".join(f"LEFT JOIN factors {t} ON {t}.tbl = '{t}' AND {t}.k = w.{c}" for t, c in (("base", "highway"), ("surface", "surface"), ("tracktype", "tracktype"), ("smoothness", "smoothness")))}),
occ AS (SELECT way_id, CAST(i AS BIGINT) AS pos, nodes[i + 1] AS osm_id FROM fways, unnest(range(0, len(nodes))) AS t(i)),
gnodes AS (SELECT row_number() OVER (ORDER BY way_id, pos) - 1 AS node_id, o.osm_id, CAST(trunc(lat * 1e7) AS INTEGER) AS lat_e7, CAST(trunc(lon * 1e7) AS INTEGER) AS lon_e7
    FROM (SELECT osm_id, min(way_id) AS way_id, arg_min(pos, way_id * 1000 + pos) AS pos FROM occ GROUP BY osm_id) o JOIN nodes USING (osm_id)),
seg AS (SELECT way_id, CAST(i AS INTEGER) AS pos, nodes[i + 1] AS a, nodes[i + 2] AS b, is_oneway, flags, f_base, f_surface, f_tracktype, f_smoothness, f_ford FROM wcost, unnest(range(0, len(nodes) - 1)) AS t(i)),
placed AS (SELECT s.*, x.node_id AS src, y.node_id AS dst, x.lat_e7 * 1e-7 AS a_lat, x.lon_e7 * 1e-7 AS a_lon, y.lat_e7 * 1e-7 AS b_lat, y.lon_e7 * 1e-7 AS b_lon FROM seg s JOIN gnodes x ON s.a = x.osm_id JOIN gnodes y ON s.b = y.osm_id),
lengths AS (SELECT *, CAST({hav("a_lat", "a_lon", "b_lat", "b_lon")} AS FLOAT) AS length_m FROM placed),
costed AS (SELECT *, length_m * f_base * f_surface * f_tracktype * f_smoothness * f_ford AS cost FROM lengths),
kinds AS (SELECT * FROM {_values([(i, k, *v) for i, (k, v) in enumerate(KINDS.items())])} AS t(place, kind, radius, weight)),
features AS (SELECT p_partkey AS osm_id, {flat} AS lat_e7, {flon} AS lon_e7, k.kind, k.radius, k.weight FROM part CROSS JOIN g_ JOIN kinds k ON k.place = (p_partkey // 25) % 11 WHERE p_partkey % 25 = 0),
mids AS (SELECT way_id, pos, (a_lat + b_lat) * 0.5 AS lat, (a_lon + b_lon) * 0.5 AS lon FROM costed),
sdist AS (SELECT m.way_id, m.pos, {hav("m.lat", "m.lon", "f.lat_e7 / 1e7", "f.lon_e7 / 1e7")} AS d, f.radius, f.weight FROM mids m JOIN features f
    ON f.lat_e7 / 1e7 BETWEEN m.lat - {BOX!r}::DOUBLE AND m.lat + {BOX!r}::DOUBLE AND f.lon_e7 / 1e7 BETWEEN m.lon - {BOX!r}::DOUBLE AND m.lon + {BOX!r}::DOUBLE),
sscore AS (SELECT way_id, pos, CAST(round(least(sum(weight * (1.0::DOUBLE - d / radius)), {MAX_SCORE}::DOUBLE) / {MAX_SCORE}::DOUBLE * 255) AS INTEGER) AS scenic_score FROM sdist WHERE d <= radius GROUP BY way_id, pos),
scored AS (SELECT c.*, coalesce(s.scenic_score, 0) AS scenic_score FROM costed c LEFT JOIN sscore s USING (way_id, pos)),
dirs AS (SELECT way_id, pos, 0 AS dir, src, dst, cost, length_m, flags, scenic_score FROM scored UNION ALL SELECT way_id, pos, 1, dst, src, cost, length_m, flags, scenic_score FROM scored WHERE NOT is_oneway),
edges AS (SELECT row_number() OVER (ORDER BY src, dst, way_id, pos, dir) - 1 AS edge_id, * FROM dirs),
stations AS (SELECT s_suppkey AS osm_id, {slat} AS lat_e7, {slon} AS lon_e7 FROM supplier, g_ WHERE s_suppkey % 5 = 0),
urec AS (SELECT {_cols(fx.USFS)}, {_cols(fx.usfs_places())} FROM part, g_ WHERE {fx.USFS_WHERE}),
utag AS (SELECT *, trim(coalesce(ROUTE_STAT, '')) LIKE 'EX%' AS existing, {level} AS level FROM (SELECT *, trim(split_part(trim(coalesce(OPER_MAINT, '')), ' - ', 1)) AS lv, trim(split_part(trim(coalesce(SURFACE_TY, '')), ' - ', 1)) AS sv FROM urec)),
uparts AS (
  SELECT record_id, part_no, pts FROM (
    SELECT record_id, existing, unnest(CASE record_id % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] ELSE [0, 1] END) AS part_no,
      unnest(CASE record_id % 3 WHEN 0 THEN [[[lon0, lat0], [(lon0 + lon1) / 2, (lat0 + lat1) / 2], [lon1, lat1]], [[lon1, lat1], [lon2, lat2]]] WHEN 1 THEN [[[lon0, lat0], [(lon0 + lon1) / 2, (lat0 + lat1) / 2], [lon1, lat1]]]
        ELSE [[[lon1, lat1], [lon2, lat2]], [[lon2, lat2]]] END) AS pts FROM utag) WHERE existing AND len(pts) >= 2),
uvert AS (SELECT record_id, part_no, CAST(i AS INTEGER) AS pos, pts[i + 1][2] AS lat, pts[i + 1][1] AS lon, i = 0 OR i = len(pts) - 1 AS is_end FROM uparts, unnest(range(0, len(pts))) AS t(i)),
usnap AS (SELECT record_id, part_no, pos, arg_min(osm_id, (d, osm_id)) AS osm_id FROM (
    SELECT v.*, n.osm_id, {hav("v.lat", "v.lon", "n.lat", "n.lon")} AS d FROM uvert v JOIN nodes n
      ON abs(floor(n.lat / 0.001::DOUBLE) - floor(v.lat / 0.001::DOUBLE)) <= 1 AND abs(floor(n.lon / 0.001::DOUBLE) - floor(v.lon / 0.001::DOUBLE)) <= 1 WHERE is_end) WHERE d <= 50 GROUP BY record_id, part_no, pos),
ufree AS (SELECT v.*, CAST(round(lat * 1e6) AS BIGINT) AS key_lat, CAST(round(lon * 1e6) AS BIGINT) AS key_lon FROM uvert v LEFT JOIN usnap s USING (record_id, part_no, pos) WHERE s.osm_id IS NULL),
unodes AS (SELECT -row_number() OVER (ORDER BY record_id, part_no, pos) AS osm_id, lat, lon, key_lat, key_lon FROM (
    SELECT *, row_number() OVER (PARTITION BY key_lat, key_lon ORDER BY record_id, part_no, pos) AS rn FROM ufree) WHERE rn = 1),
uways AS (SELECT record_id, part_no, -row_number() OVER (ORDER BY record_id, part_no) AS way_id FROM uparts),
ulist AS (SELECT record_id, part_no, list(coalesce(s.osm_id, u.osm_id) ORDER BY pos) AS nodes FROM uvert v LEFT JOIN usnap s USING (record_id, part_no, pos)
    LEFT JOIN unodes u ON s.osm_id IS NULL AND u.key_lat = CAST(round(v.lat * 1e6) AS BIGINT) AND u.key_lon = CAST(round(v.lon * 1e6) AS BIGINT) GROUP BY record_id, part_no),
low AS (SELECT * FROM fways WHERE highway IN ('track', 'path', 'bridleway', 'cycleway', 'footway')),
cseg AS (SELECT way_id, i AS pos, (x.lat + y.lat) * 0.5 AS lat, (x.lon + y.lon) * 0.5 AS lon FROM low, unnest(range(0, len(nodes) - 1)) AS t(i) JOIN nodes x ON x.osm_id = nodes[i + 1] JOIN nodes y ON y.osm_id = nodes[i + 2]),
chit AS (SELECT DISTINCT way_id, pos FROM cseg c JOIN unodes u ON abs(u.lat - c.lat) <= 50 / 111000.0::DOUBLE AND abs(u.lon - c.lon) <= 50 / (111000.0::DOUBLE * greatest(cos(radians(c.lat)), 0.1::DOUBLE)) AND {hav("c.lat", "c.lon", "u.lat", "u.lon")} <= 50
    AND abs(floor(u.lat / 0.001::DOUBLE) - floor(c.lat / 0.001::DOUBLE)) <= 1 AND abs(floor(u.lon / 0.001::DOUBLE) - floor(c.lon / 0.001::DOUBLE)) <= 1),
cover AS (SELECT c.way_id, avg(CASE WHEN h.way_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS coverage FROM cseg c LEFT JOIN chit h ON h.way_id = c.way_id AND h.pos = c.pos GROUP BY c.way_id),
reqs AS (SELECT {_cols(fx.REQUEST)}, {_cols(fx.request_places())} FROM supplier, g_),
vehicles AS (SELECT name, CAST(pen AS FLOAT) AS pen, smooth FROM {_values([(k, float(v.fourwd_only_penalty), v.min_smoothness) for k, v in profile.vehicle.items()])} AS t(name, pen, smooth)),
reqv AS (SELECT r.*, v.name AS vehicle_used, v.pen AS fourwd_only_penalty, v.smooth AS min_smoothness FROM reqs r JOIN vehicles v ON v.name = CASE WHEN r.vehicle IN (SELECT name FROM vehicles) THEN r.vehicle ELSE 'high-clearance' END)
"""


def _with_roads(network: str, more: str) -> str:
    """The graph's part of the network, and what follows from it, once more with forest roads in place of the ways that they cover; names get an underscore."""
    graph = network[network.index("wflags AS (") : network.index("stations AS (")].rstrip(",\n")
    graph = graph.replace("AS flags FROM fways)", "AS flags FROM fways WHERE coalesce(access, '') <> 'private')")
    # tables that are the same for both
    common = ("kinds", "features")
    text = f"{graph},\n{more}"
    own = [n for n in re.findall(r"(?m)^(\w+)(?:\([\w, ]+\))? AS (?:MATERIALIZED )?\(", text) if n not in common] + ["fways", "nodes"]
    text = re.sub(rf"(?m)^({'|'.join(common)}) AS .*\n", "", text)
    for name in own:
        text = re.sub(rf"(?m)^{name}(?=(?:\([\w, ]+\))? AS (?:MATERIALIZED )?\()|(?<=FROM ){name}\b|(?<=JOIN ){name}\b|\b{name}(?=\.[\w*])", f"{name}_", text)
    return f"""nodes_ AS (SELECT osm_id, lat, lon FROM nodes UNION ALL SELECT osm_id, lat, lon FROM unodes),
fways_ AS (
  SELECT way_id, nodes, highway, surface, smoothness, tracktype, ford, "4wd_only", oneway, seasonal, access FROM fways WHERE way_id NOT IN (SELECT way_id FROM cover WHERE coverage >= 0.5)
  UNION ALL SELECT 1000000000 - way_id, nodes, {ROAD_TAGS["highway"]}, {ROAD_TAGS["surface"]}, {ROAD_TAGS["smoothness"]}, NULL, NULL, {ROAD_TAGS["fourwd"]}, NULL, NULL, {ROAD_TAGS["access"]} FROM uways JOIN ulist USING (record_id, part_no) JOIN utag USING (record_id)),
{text}"""


def build() -> dict[str, str]:
    """Query name -> SQL."""
    profile = load_profile()
    network = _network(profile)
    pen = """greatest(CASE WHEN prefer_scenic AND scenic_score > 0 THEN greatest(0.65::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - CAST(scenic_weight AS DOUBLE) * 0.35::DOUBLE * (scenic_score / 255.0::DOUBLE))) ELSE 1.0::DOUBLE END,
      CASE WHEN avoid_paved AND flags & 1 = 1 THEN 10.0::DOUBLE ELSE 0 END, CASE WHEN avoid_fords AND flags & 2 = 2 THEN 20.0::DOUBLE ELSE 0 END, CASE WHEN vehicle <> 'dirtbike' AND flags & 32 = 32 THEN 9999.0::DOUBLE ELSE 0 END,
      CASE WHEN flags & 4 = 4 THEN CAST(fourwd_only_penalty AS DOUBLE) ELSE 0 END, CASE WHEN (min_smoothness = 'bad' AND flags & 64 = 64) OR (min_smoothness = 'very_bad' AND flags & 128 = 128) THEN 9999.0::DOUBLE ELSE 0 END)"""
    def snap(requests: str, key: str, nodes: str = "gnodes", node: str = "node_id") -> str:
        return f"""ends AS MATERIALIZED (SELECT {key}, 'from' AS side, from_lat AS lat, from_lon AS lon FROM {requests} UNION ALL SELECT {key}, 'to', to_lat, to_lon FROM {requests}),
targets AS MATERIALIZED (SELECT {node} AS node_id, lat_e7 / 1e7 AS n_lat, lon_e7 / 1e7 AS n_lon FROM {nodes}),
closest AS MATERIALIZED (SELECT {key}, side, lat, lon, arg_min(node_id, ((lat - n_lat) * (lat - n_lat) + (lon - n_lon) * (lon - n_lon), node_id)) AS node_id FROM ends, targets GROUP BY ALL),
snapped AS MATERIALIZED (SELECT {key}, side, c.node_id, {hav("lat", "lon", "n_lat", "n_lon")} AS snap_m FROM closest c JOIN targets USING (node_id) WHERE {hav("lat", "lon", "n_lat", "n_lon")} <= 1000)"""

    events = f"asked AS (SELECT event_id, {_cols(fx.request_places('event_id'))} FROM events, g_)"
    chain = """half AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
d2 AS MATERIALIZED (SELECT a AS node FROM half GROUP BY a HAVING count(*) = 2),
walk(first_a, first_b, a, b, pos) AS (
  SELECT a, b, a, b, CAST(0 AS BIGINT) FROM half WHERE a NOT IN (SELECT node FROM d2) AND b IN (SELECT node FROM d2)
  UNION ALL SELECT w.first_a, w.first_b, h.a, h.b, w.pos + 1 FROM walk w JOIN half h ON h.a = w.b AND h.b <> w.a WHERE w.b IN (SELECT node FROM d2)),
e1 AS (SELECT src, dst, arg_min(cost, edge_id) AS cost, arg_min(length_m, edge_id) AS length_m, arg_min(flags, edge_id) AS flags, arg_min(scenic_score, edge_id) AS scenic_score FROM edges GROUP BY src, dst),
ch AS (SELECT first_a AS src, arg_max(w.b, pos) AS dst, first_b, sum(CAST(cost AS DOUBLE)) AS cost, sum(CAST(length_m AS DOUBLE)) AS length_m, bit_or(flags) AS flags, max(scenic_score) AS scenic_score,
    count(*) = count(e1.src) AS open, min(CASE WHEN pos > 0 THEN w.a END) AS lowest, count(*) AS n_steps FROM walk w LEFT JOIN e1 ON e1.src = w.a AND e1.dst = w.b GROUP BY first_a, first_b),
pick AS (SELECT least(src, dst) AS e1_, greatest(src, dst) AS e2_, min(lowest) AS lowest FROM ch WHERE open GROUP BY 1, 2),
chosen AS (SELECT ch.* FROM ch JOIN pick ON least(src, dst) = e1_ AND greatest(src, dst) = e2_ AND ch.lowest = pick.lowest WHERE open)"""
    gone = """gone AS (SELECT DISTINCT w.a AS node FROM walk w JOIN chosen c ON w.first_a = c.src AND w.first_b = c.first_b WHERE w.pos > 0),
kept AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS new_id, lat_e7, lon_e7 FROM gnodes WHERE node_id NOT IN (SELECT node FROM gone)),
merged AS (SELECT src, dst, CAST(cost AS FLOAT) AS cost, CAST(length_m AS FLOAT) AS length_m, flags, scenic_score, CAST(n_steps - 1 AS BIGINT) AS n_points, -1 AS old, first_b AS tie FROM chosen
  UNION ALL SELECT src, dst, cost, length_m, flags, scenic_score, 0, edge_id, 0 FROM edges WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)),
cedges AS (SELECT row_number() OVER (ORDER BY s.new_id, d.new_id, old, tie) - 1 AS edge_id, s.new_id AS src, d.new_id AS dst, cost, length_m, flags, scenic_score, n_points FROM merged JOIN kept s ON s.node_id = src JOIN kept d ON d.node_id = dst)"""
    sssp = """dist(node, d) USING KEY (node) AS (
  SELECT (SELECT min(node_id) FROM gnodes), 0.0::DOUBLE
  UNION SELECT e.dst, min(x.d + e.cost) FROM dist x JOIN best e ON e.src = x.node LEFT JOIN recurring.dist r ON r.node = e.dst WHERE r.d IS NULL OR x.d + e.cost < r.d GROUP BY e.dst)"""

    # search from one end of each request, over ``step`` (rid, src, dst, cost; a null rid is for all)
    req_ends = "req_ends AS MATERIALIZED (SELECT request_id, max(CASE WHEN side = 'from' THEN node_id END) AS f, max(CASE WHEN side = 'to' THEN node_id END) AS t FROM reqs LEFT JOIN snapped USING (request_id) GROUP BY request_id)"

    def ssmp(own: bool) -> str:
        mine = " AND e.rid = x.rid" if own else ""
        return f"""dist(rid, node, d) USING KEY (rid, node) AS (
  SELECT request_id, f, 0.0::DOUBLE FROM req_ends WHERE f IS NOT NULL AND t IS NOT NULL
  UNION SELECT x.rid, e.dst, min(x.d + e.cost) FROM dist x JOIN best e ON e.src = x.node{mine} LEFT JOIN recurring.dist r ON r.node = e.dst AND r.rid = x.rid WHERE r.d IS NULL OR x.d + e.cost < r.d GROUP BY x.rid, e.dst)"""

    plain = "best AS MATERIALIZED (SELECT src, dst, min(CAST(cost AS DOUBLE)) AS cost FROM edges GROUP BY src, dst)"
    dear = f"best AS MATERIALIZED (SELECT request_id AS rid, src, dst, min(CAST(cost AS DOUBLE) * {pen}) AS cost FROM cedges, reqv GROUP BY request_id, src, dst)"
    routed = ",\n".join((snap("reqs", "request_id"), req_ends, plain, ssmp(False)))
    planned = ",\n".join((chain, gone, snap("reqs", "request_id", "kept", "new_id"), req_ends, dear, ssmp(True)))
    asker = "JOIN reqv ON request_id = way_id % (SELECT count(*) FROM supplier)"
    fuel_near = f"""near AS MATERIALIZED (SELECT g.node_id, arg_min(s.osm_id, ((g.lat_e7 / 1e7 - s.lat_e7 / 1e7) * (g.lat_e7 / 1e7 - s.lat_e7 / 1e7) + (g.lon_e7 / 1e7 - s.lon_e7 / 1e7) * (g.lon_e7 / 1e7 - s.lon_e7 / 1e7), s.osm_id)) AS station FROM gnodes g, stations s GROUP BY g.node_id),
reach AS MATERIALIZED (SELECT n.node_id, station, CASE WHEN {hav("g.lat_e7 / 1e7", "g.lon_e7 / 1e7", "s.lat_e7 / 1e7", "s.lon_e7 / 1e7")} <= 2000 THEN station END AS town FROM near n JOIN gnodes g USING (node_id) JOIN stations s ON s.osm_id = station),
driven AS (SELECT way_id, pos, station, town, sum(step) OVER (PARTITION BY way_id ORDER BY pos) AS cum FROM (
  SELECT *, coalesce({hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")}, 0) AS step FROM (SELECT way_id, pos, node_id, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon FROM occ JOIN gnodes USING (osm_id)) WINDOW w AS (PARTITION BY way_id ORDER BY pos)) JOIN reach USING (node_id)),
lists AS (SELECT way_id, list(cum ORDER BY pos) AS cum, list(town ORDER BY pos) AS town, list(station ORDER BY pos) AS station FROM driven GROUP BY way_id),
stops(way_id, n, due, stop, refuelled, station, done) AS (
  SELECT way_id, 0, CAST(1 AS BIGINT), CAST(-1 AS BIGINT), 0.0::DOUBLE, CAST(NULL AS BIGINT), false FROM lists
  UNION ALL SELECT way_id, n + 1, due, stop, cum[stop + 1], coalesce(town[stop + 1], nearest[stop + 1]), cum[due + 1] >= cum[stop + 1] + 1500 FROM (
    SELECT way_id, n, due, coalesce(list_max([j FOR j IN range(stop + 1, due + 1) IF town[j + 1] IS NOT NULL]), due) AS stop, cum, town, nearest FROM (
      SELECT s.way_id, n, stop, list_min([i FOR i IN range(due, len(cum)) IF cum[i + 1] >= refuelled + 1500]) AS due, cum, town, l.station AS nearest FROM stops s JOIN lists l ON l.way_id = s.way_id WHERE NOT done) WHERE due IS NOT NULL))"""
    # the elements of a track, as text
    point = "'<trkpt lat=\"' || printf('%.7f', lat_e7 / 1e7) || '\" lon=\"' || printf('%.7f', lon_e7 / 1e7) || '\"/>'"
    track = f"""marks AS (SELECT way_id, string_agg({point}, '' ORDER BY pos) AS points FROM occ JOIN gnodes USING (osm_id) GROUP BY way_id),
sums AS (SELECT way_id, sum(CAST(length_m AS DOUBLE)) AS length_m, count(*) FILTER (flags & 2 = 2) AS fords, count(*) FILTER (flags & 4 = 4) AS fourwd, CASE WHEN bool_or(flags & 1 = 1) THEN 0 ELSE 1 END AS unpaved FROM lengths GROUP BY way_id)"""

    def q(select: str, more: str = "", recursive: bool = False) -> str:
        return f"WITH {'RECURSIVE ' if recursive else ''}{network}{',' + chr(10) + more if more else ''}\n{select}"

    def listed(column: str) -> str:
        return f"array_to_string({column}, ',')"

    sql = {
        "road_nodes": q("SELECT osm_id, lat, lon FROM nodes"),
        "road_ways": q(f'SELECT way_id, {listed("nodes")} AS nodes, highway, surface, smoothness, tracktype, ford, "4wd_only" AS fourwd, oneway, seasonal, access FROM ways'),
        "extract_nodes": q("SELECT osm_id, CAST(round(lat * 1e7) AS BIGINT) AS lat_e7, CAST(round(lon * 1e7) AS BIGINT) AS lon_e7, tourism, \"natural\", waterway, amenity FROM tnodes"),
        "extract_ways": q(f'SELECT way_id, {listed("nodes")} AS nodes, highway, surface, smoothness, tracktype, ford, "4wd_only" AS fourwd, oneway, seasonal, access FROM ways'),
        "shapefile_records": q("""SELECT row_number() OVER (ORDER BY record_id) - 1 AS record_id, trim(coalesce(ROUTE_STAT, '')) AS ROUTE_STAT, trim(coalesce(OPER_MAINT, '')) AS OPER_MAINT, trim(coalesce(OPENFORUSE, '')) AS OPENFORUSE, trim(coalesce(OBJECTIVE_, '')) AS OBJECTIVE_,
            trim(coalesce(SURFACE_TY, '')) AS SURFACE_TY, trim(coalesce("NAME", '')) AS "NAME", CAST(CASE WHEN record_id % 3 = 1 THEN 1 ELSE 2 END AS INTEGER) AS n_parts FROM urec"""),
        "shapefile_points": q("""SELECT record_id, CAST(part_no AS INTEGER) AS part_no, CAST(i AS INTEGER) AS pos, round(parts[part_no + 1][i + 1][2], 9) AS lat, round(parts[part_no + 1][i + 1][1], 9) AS lon FROM (
            SELECT row_number() OVER (ORDER BY record_id) - 1 AS record_id, CASE record_id % 3 WHEN 0 THEN [[[lon0, lat0], [(lon0 + lon1) / 2, (lat0 + lat1) / 2], [lon1, lat1]], [[lon1, lat1], [lon2, lat2]]] WHEN 1 THEN [[[lon0, lat0], [(lon0 + lon1) / 2, (lat0 + lat1) / 2], [lon1, lat1]]]
              ELSE [[[lon1, lat1], [lon2, lat2]], [[lon2, lat2]]] END AS parts FROM urec), unnest(range(0, len(parts))) AS p(part_no), unnest(range(0, len(parts[part_no + 1]))) AS t(i)"""),
        "build_all": q("SELECT edge_id, src, dst, round(CAST(cost AS DOUBLE), 2) AS cost, flags, scenic_score FROM cedges_", _with_roads(network, f"{chain},\n{gone}"), True),
        "way_filter": q("SELECT way_id, highway FROM fways"),
        "way_filter_keep_private": q("SELECT way_id FROM ways WHERE highway IN (SELECT highway FROM allowed) AND coalesce(vehicle, '') <> 'no'"),
        "skip_tracks": q("SELECT way_id FROM fways WHERE highway NOT IN ('track', 'path', 'bridleway', 'cycleway', 'footway')"),
        "tag_map": "SELECT o_orderkey AS way_id, o_orderstatus AS status, o_orderpriority AS note, nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'set' END, '') AS opt FROM orders",
        "scenic_classify_node": q("SELECT osm_id, kind FROM snodes WHERE kind IS NOT NULL"),
        "scenic_classify_way": q("SELECT way_id, kind FROM sways WHERE kind IS NOT NULL"),
        "scenic_centroid": q("SELECT -way_id AS osm_id, kind, CAST(trunc(round(avg(lat), 9) * 1e6) AS INTEGER) AS lat_e6, CAST(trunc(round(avg(lon), 9) * 1e6) AS INTEGER) AS lon_e6 FROM sways, unnest(nodes) AS t(osm_id) JOIN nodes USING (osm_id) WHERE kind IS NOT NULL GROUP BY way_id, kind"),
        "scenic_union": q("SELECT kind, count(*) AS n FROM (SELECT kind FROM snodes UNION ALL SELECT kind FROM sways) WHERE kind IS NOT NULL GROUP BY kind"),
        "needed_nodes_semi": q("SELECT osm_id, lat, lon FROM nodes WHERE osm_id IN (SELECT unnest(nodes) FROM fways UNION SELECT unnest(nodes) FROM sways WHERE kind IS NOT NULL)"),
        "fuel_extract": q("SELECT osm_id, CAST(trunc(lat * 1e7) AS INTEGER) AS lat_e7, CAST(trunc(lon * 1e7) AS INTEGER) AS lon_e7 FROM snodes WHERE amenity = 'fuel'"),
        "bbox_derive": q("SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM nodes"),
        "bbox_filter": q("SELECT osm_id FROM nodes WHERE lat BETWEEN 44.02 AND 44.3 AND lon BETWEEN -121.95 AND -121.7"),
        "e7_quantize": q("SELECT osm_id, CAST(trunc((lat + 0.00000005) * 1e7) AS INTEGER) AS lat_e7, CAST(trunc((lon - 0.00000005) * 1e7) AS INTEGER) AS lon_e7 FROM nodes"),
        "e7_dequantize": q("SELECT osm_id, lat_e7 / 1e7 AS lat, lon_e7 * 1e-7 AS lon FROM stations"),
        "grid_cells": q("SELECT CAST(floor(lat / 0.001::DOUBLE) AS BIGINT) AS ci, CAST(floor(lon / 0.001::DOUBLE) AS BIGINT) AS cj, count(*) AS n FROM nodes GROUP BY ALL"),
        "flag_counts": q(f"""SELECT count(*) FILTER (surface IN ({names(profile.routing.paved_surfaces)})) AS paved, count(*) FILTER (ford = 'yes') AS ford, count(*) FILTER ("4wd_only" = 'yes') AS fourwd_only, count(*) FILTER (seasonal = 'yes') AS seasonal,
            count(*) FILTER (access = 'private') AS private, count(*) FILTER (highway = 'path') AS trail, count(*) FILTER (smoothness IN ({names(profile.routing.smoothness_rough)})) AS rough, count(*) FILTER (smoothness IN ({names(profile.routing.smoothness_very_rough)})) AS very_rough
            FROM ways WHERE highway IN (SELECT highway FROM allowed) AND coalesce(vehicle, '') <> 'no' AND coalesce(motor_vehicle, '') <> 'no'"""),
        "bbox_segments": q("""SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM (SELECT way_id, pos, x.lat BETWEEN 44.02 AND 44.3 AND x.lon BETWEEN -121.95 AND -121.7 AND y.lat BETWEEN 44.02 AND 44.3 AND y.lon BETWEEN -121.95 AND -121.7 AS ok
            FROM seg JOIN nodes x ON x.osm_id = a JOIN nodes y ON y.osm_id = b)"""),
        "conflation_counts": q("SELECT count(*) FILTER (c.way_id IS NULL) AS kept, count(*) FILTER (c.way_id IS NOT NULL) AS dropped FROM fways f LEFT JOIN (SELECT way_id FROM cover WHERE coverage >= 0.5) c ON f.way_id = c.way_id"),
        "fuel_lookback": q(f"""SELECT way_id, CAST(pos AS INTEGER) AS pos, coalesce(last_value(CASE WHEN station_m <= 2000 THEN station END IGNORE NULLS) OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS last_station FROM occ JOIN gnodes USING (osm_id) JOIN (
            SELECT g.node_id, s.osm_id AS station, {hav("g.lat_e7 / 1e7", "g.lon_e7 / 1e7", "s.lat_e7 / 1e7", "s.lon_e7 / 1e7")} AS station_m,
            row_number() OVER (PARTITION BY g.node_id ORDER BY (g.lat_e7 / 1e7 - s.lat_e7 / 1e7) * (g.lat_e7 / 1e7 - s.lat_e7 / 1e7) + (g.lon_e7 / 1e7 - s.lon_e7 / 1e7) * (g.lon_e7 / 1e7 - s.lon_e7 / 1e7), s.osm_id) AS rn FROM gnodes g, stations s) USING (node_id) WHERE rn = 1"""),
        "haversine_len": q("SELECT way_id, pos, round(CAST(length_m AS DOUBLE), 3) AS length_m FROM lengths"),
        "edge_flags": q("SELECT way_id, flags FROM wflags"),
        "factor_lookup": q("SELECT way_id, f_base, f_surface, f_tracktype, f_smoothness, f_ford FROM wcost"),
        "edge_cost": q("SELECT way_id, pos, round(CAST(cost AS DOUBLE), 3) AS cost FROM costed"),
        "segments_lead": q("SELECT way_id, pos, a, b FROM seg"),
        "bidirectional_edges": q("SELECT way_id, pos, dir, src, dst FROM dirs"),
        "node_ids_first_encounter": q("SELECT node_id, osm_id, lat_e7, lon_e7 FROM gnodes"),
        "edge_ids_total_order": q("SELECT edge_id, src, dst, way_id, pos, dir FROM edges"),
        "out_degree_prefix_sum": q("SELECT node_id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_edge FROM (SELECT node_id, count(src) AS degree FROM gnodes LEFT JOIN edges ON src = node_id GROUP BY node_id)"),
        "undirected_degree": q("SELECT a AS node_id, count(*) AS degree FROM (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) GROUP BY a"),
        "first_edge_per_pair": q("SELECT src, dst, min(edge_id) AS edge_id FROM edges GROUP BY src, dst"),
        "build_graph": q("SELECT edge_id, src, dst, round(CAST(cost AS DOUBLE), 3) AS cost, round(CAST(length_m AS DOUBLE), 3) AS length_m, flags, scenic_score FROM edges"),
        "usfs_tags": q("SELECT record_id, " + ", ".join(f"{text} AS {name}" for name, text in ROAD_TAGS.items()) + " FROM utag WHERE existing"),
        "usfs_vertex_dedupe": q("SELECT osm_id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM unodes"),
        "usfs_snap_nearest": q("SELECT record_id, part_no, pos, osm_id FROM usnap"),
        "usfs_ways": q(f"SELECT way_id, {listed('nodes')} AS nodes FROM uways JOIN ulist USING (record_id, part_no)"),
        "usfs_bbox": q("SELECT record_id, part_no FROM uparts WHERE len([p FOR p IN pts IF p[2] BETWEEN 44.02 AND 44.3 AND p[1] BETWEEN -121.95 AND -121.7]) > 0"),
        "conflation_coverage": q("SELECT way_id, round(coverage, 6) AS coverage FROM cover"),
        "conflation_kept": q("SELECT way_id FROM fways WHERE way_id NOT IN (SELECT way_id FROM cover WHERE coverage >= 0.5)"),
        "ways_union": q("SELECT way_id FROM fways UNION ALL SELECT way_id FROM uways"),
        "nodes_union": q("SELECT osm_id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM nodes UNION ALL SELECT osm_id, round(lat, 9), round(lon, 9) FROM unodes"),
        "scenic_score": q("SELECT way_id, pos, scenic_score FROM scored"),
        "snap_request": q("SELECT event_id, side, node_id, round(snap_m, 6) AS snap_m FROM snapped", f"{events},\n{snap('asked', 'event_id')}"),
        "request_validation": """SELECT event_id AS request_id, CASE WHEN flat NOT BETWEEN -90 AND 90 THEN 'from latitude ' || flat || ' is not within -90 and 90' WHEN flon NOT BETWEEN -180 AND 180 THEN 'from longitude ' || flon || ' is not within -180 and 180'
            WHEN det <= 0 THEN 'max_detour has to exceed 0, not ' || det WHEN div < 0 OR div > 1 THEN 'diversity has to be within 0 and 1, not ' || div WHEN sw < 0 OR sw > 1 THEN 'scenic_weight has to be within 0 and 1, not ' || sw END AS error
            FROM (SELECT event_id, CAST(event_id % 200 - 100 AS DOUBLE) AS flat, CAST(event_id % 500 - 250 AS DOUBLE) AS flon, CAST(event_id % 7 - 1 AS FLOAT) AS det, CAST((event_id % 8 - 2) * 0.25 AS FLOAT) AS div, CAST((event_id % 6) * 0.25 AS FLOAT) AS sw FROM events)""",
        "request_defaults": "SELECT event_id AS request_id, CAST(event_id % 50 AS DOUBLE) AS from_lat, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 1 END AS alternatives, CAST(CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.35 END AS FLOAT) AS diversity, CASE WHEN event_id % 5 = 0 THEN 'dirtbike' ELSE 'high-clearance' END AS vehicle, event_id % 7 <> 0 AS avoid_paved, CAST(CASE WHEN event_id % 4 = 0 THEN 120 END AS FLOAT) AS tank_range_km FROM events",
        "vehicle_fallback": q(f"SELECT event_id AS request_id, e.vehicle, name AS vehicle_used, pen AS fourwd_only_penalty, smooth AS min_smoothness FROM (SELECT event_id, {_d(fx.EVENT_VEHICLE)} AS vehicle FROM events) e JOIN vehicles v ON v.name = CASE WHEN e.vehicle IN (SELECT name FROM vehicles) THEN e.vehicle ELSE 'high-clearance' END"),
        "initial_penalties": q(f"SELECT request_id, flags, scenic_score, round({pen}, 9) AS penalty, n FROM (SELECT flags, scenic_score, count(*) AS n FROM edges GROUP BY ALL), reqv"),
        "penalty_histogram": q(f"SELECT request_id, penalty, CAST(sum(n) AS BIGINT) AS n FROM (SELECT request_id, round({pen}, 6) AS penalty, n FROM (SELECT flags, scenic_score, count(*) AS n FROM edges GROUP BY ALL), reqv) GROUP BY ALL"),
        "jaccard_pairs": q("SELECT a.way_id AS way_a, b.way_id AS way_b, 1.0::DOUBLE - len(list_intersect(a.nodes, b.nodes)) / len(list_distinct(list_concat(a.nodes, b.nodes)))::DOUBLE AS distance FROM fways a JOIN fways b ON a.nodes[1] = b.nodes[1] AND a.way_id < b.way_id"),
        "route_rank": """SELECT l_orderkey AS request_id, l_linenumber AS found, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS rank, round(score, 9) AS score FROM (
            SELECT *, round(l_discount * 10, 2) * 0.6::DOUBLE - (l_quantity / greatest(max(CASE WHEN l_linenumber = first THEN l_quantity END) OVER (PARTITION BY l_orderkey), 1.1920928955078125e-07) - 1) * 0.4::DOUBLE AS score FROM (
              SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS l_linenumber, 0 AS first, l_discount, l_quantity FROM lineitem))""",
        "fuel_nearest": q(f"""SELECT node_id, station, round(station_m, 3) AS station_m FROM (SELECT g.node_id, s.osm_id AS station, {hav("g.lat_e7 / 1e7", "g.lon_e7 / 1e7", "s.lat_e7 / 1e7", "s.lon_e7 / 1e7")} AS station_m,
            row_number() OVER (PARTITION BY g.node_id ORDER BY (g.lat_e7 / 1e7 - s.lat_e7 / 1e7) * (g.lat_e7 / 1e7 - s.lat_e7 / 1e7) + (g.lon_e7 / 1e7 - s.lon_e7 / 1e7) * (g.lon_e7 / 1e7 - s.lon_e7 / 1e7), s.osm_id) AS rn FROM gnodes g, stations s) WHERE rn = 1"""),
        "cumulative_distance": q(f"""SELECT way_id, pos, round(sum(step) OVER (PARTITION BY way_id ORDER BY pos), 4) AS cum_m FROM (SELECT way_id, pos, coalesce({hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")}, 0) AS step
            FROM (SELECT way_id, CAST(pos AS INTEGER) AS pos, osm_id, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon FROM occ JOIN gnodes USING (osm_id)) WINDOW w AS (PARTITION BY way_id ORDER BY pos))"""),
        "profile_report": q("SELECT CAST(row_number() OVER (ORDER BY r.section, r.key) AS BIGINT) AS place, r.section, r.key, r.value, r.detail, CASE WHEN r.section NOT LIKE 'vehicle%' THEN coalesce(n, 0) END AS n_ways FROM (" + "SELECT * FROM " + _values([(t, k, float(v), None) for t in ("base", "surface", "tracktype", "smoothness") for k, v in getattr(profile, t).items()] + [("vehicle", k, float(v.fourwd_only_penalty), v.min_smoothness) for k, v in profile.vehicle.items()] + [("vehicle.narrow_path_bonus", k, float(v.narrow_path_bonus), None) for k, v in profile.vehicle.items() if v.narrow_path_bonus is not None]).replace("(VALUES", "(SELECT section, key, CAST(value AS DOUBLE) AS value, detail FROM (VALUES") + " t(section, key, value, detail))" + """) r LEFT JOIN (
            SELECT 'base' AS section, highway AS key, count(*) AS n FROM ways GROUP BY ALL UNION ALL SELECT 'surface', surface, count(*) FROM ways GROUP BY ALL
            UNION ALL SELECT 'tracktype', tracktype, count(*) FROM ways GROUP BY ALL UNION ALL SELECT 'smoothness', smoothness, count(*) FROM ways GROUP BY ALL) c ON c.section = r.section AND c.key = r.key"""),
        "graph_inspect": q("SELECT (SELECT count(*) FROM gnodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM stations) AS fuel_stations"),
        "contract_chains": q("SELECT src, dst, lowest, CAST(n_steps - 1 AS INTEGER) AS n_interior, round(cost, 2) AS cost, round(length_m, 2) AS length_m, flags, scenic_score FROM chosen", chain, True),
        "contract_graph": q("SELECT edge_id, src, dst, round(CAST(cost AS DOUBLE), 2) AS cost, round(CAST(length_m AS DOUBLE), 2) AS length_m, flags, scenic_score, CAST(n_points AS INTEGER) AS n_points FROM cedges", chain + ",\n" + gone, True),
        "sssp": q("SELECT node AS node_id, round(d, 3) AS cost FROM dist", "best AS MATERIALIZED (SELECT src, dst, min(CAST(cost AS DOUBLE)) AS cost FROM edges GROUP BY src, dst),\n" + sssp, True),
        "route_cost": q("SELECT request_id, round(d, 2) AS cost FROM req_ends JOIN dist ON rid = request_id AND node = t", routed, True),
        "route_cost_cells": q("SELECT request_id, round(d, 2) AS cost FROM req_ends JOIN dist ON rid = request_id AND node = t", routed, True),
        "route_path": q("SELECT request_id, f AS first_node, t AS last_node, round(d, 2) AS cost, true AS connected FROM req_ends JOIN dist ON rid = request_id AND node = t", routed, True),
        "first_route_cost": q("SELECT request_id, round(d, 2) AS cost FROM req_ends JOIN dist ON rid = request_id AND node = t", planned, True),
        "route_errors": q(f"SELECT request_id, 400 AS status, CASE WHEN f IS NULL THEN '{FAR.format('origin')}' WHEN t IS NULL THEN '{FAR.format('destination')}' ELSE '{NO_ROUTE}' END AS error FROM req_ends LEFT JOIN dist ON rid = request_id AND node = t WHERE d IS NULL", planned, True),
        "route_stats": q(f"""SELECT way_id AS request_id, round(sum(CAST(length_m AS DOUBLE)), 2) AS length_m, round(sum(CAST(cost AS DOUBLE) * {pen}), 2) AS cost,
            round(CASE WHEN sum(length_m) > 0 THEN sum(CASE WHEN flags & 1 = 0 THEN CAST(length_m AS DOUBLE) ELSE 0 END) / sum(CAST(length_m AS DOUBLE)) ELSE 0 END, 6) AS unpaved_fraction,
            CAST(count(*) FILTER (flags & 2 = 2) AS INTEGER) AS ford_count, CAST(count(*) FILTER (flags & 4 = 4) AS INTEGER) AS fourwd_only_count FROM (SELECT * FROM edges WHERE dir = 0) {asker} GROUP BY way_id"""),
        "fuel_stops_along_ways": q("SELECT way_id, n AS stop_no, round(refuelled, 2) AS at_distance_m, station AS osm_id, lat_e7, lon_e7 FROM stops JOIN stations ON osm_id = station WHERE n > 0", fuel_near, True),
        "gpx_way_tracks": q("""SELECT way_id, '<trk><name>trailgraph-route-1</name><desc>length=' || printf('%.1f', length_m / 1000) || 'km unpaved=' || unpaved * 100 || '% fords=' || fords || ' 4wd_only=' || fourwd || ' score=' || printf('%.2f', unpaved * 0.6)
            || '</desc><trkseg>' || points || '</trkseg></trk>' AS xml FROM marks JOIN sums USING (way_id)""", track),
        "bbox_parse": q("SELECT osm_id FROM nodes WHERE lat BETWEEN 44.02 AND 44.3 AND lon BETWEEN -121.95 AND -121.7"),
        "profile_fingerprint": q(f"SELECT sha256('{_canonical(profile)}') AS fingerprint, count(*) AS edges FROM edges"),
        "private_segments": q(f"""SELECT way_id, CAST(i AS INTEGER) AS pos, x.node_id AS src, y.node_id AS dst, coalesce(access, '') <> 'private' AS open FROM pways, unnest(range(0, len(nodes) - 1)) AS t(i) JOIN pnodes x ON x.osm_id = nodes[i + 1] JOIN pnodes y ON y.osm_id = nodes[i + 2]""",
            """pways AS (SELECT * FROM ways WHERE highway IN (SELECT highway FROM allowed) AND coalesce(vehicle, '') <> 'no' AND coalesce(motor_vehicle, '') <> 'no'),
pocc AS (SELECT way_id, CAST(i AS BIGINT) AS pos, nodes[i + 1] AS osm_id FROM pways, unnest(range(0, len(nodes))) AS t(i)),
pnodes AS (SELECT row_number() OVER (ORDER BY way_id, pos) - 1 AS node_id, osm_id FROM (SELECT osm_id, min(way_id) AS way_id, arg_min(pos, way_id * 1000 + pos) AS pos FROM pocc GROUP BY osm_id) JOIN nodes USING (osm_id))"""),
        "scenic_in_box": q(f"""SELECT way_id, pos, CAST(round(least(sum(weight * (1.0::DOUBLE - d / radius)), {MAX_SCORE}::DOUBLE) / {MAX_SCORE}::DOUBLE * 255) AS INTEGER) AS scenic_score FROM (
            SELECT m.way_id, m.pos, {hav("m.lat", "m.lon", "f.lat_e7 / 1e7", "f.lon_e7 / 1e7")} AS d, f.radius, f.weight FROM mids m JOIN features f ON f.lat_e7 / 1e7 BETWEEN m.lat - {BOX!r}::DOUBLE AND m.lat + {BOX!r}::DOUBLE AND f.lon_e7 / 1e7 BETWEEN m.lon - {BOX!r}::DOUBLE AND m.lon + {BOX!r}::DOUBLE
              AND f.lat_e7 / 1e7 BETWEEN 44.02 AND 44.3 AND f.lon_e7 / 1e7 BETWEEN -121.95 AND -121.7) WHERE d <= radius GROUP BY way_id, pos HAVING CAST(round(least(sum(weight * (1.0::DOUBLE - d / radius)), {MAX_SCORE}::DOUBLE) / {MAX_SCORE}::DOUBLE * 255) AS INTEGER) > 0"""),
        "graph_store": q("SELECT edge_id, src, dst, round(CAST(cost AS DOUBLE), 3) AS cost, round(CAST(length_m AS DOUBLE), 3) AS length_m, flags, scenic_score, 0 AS n_points FROM edges"),
    }
    return sql
