"""The build: filtered ways and nodes, forest roads, conflation, graph, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..functions.tags import WayFilter
from ..operators import conflate, contract, ways
from .profile import Profile


def build(
    all_ways: DataFrame,
    nodes: DataFrame,
    profile: Profile,
    features: DataFrame | None = None,
    fuel: DataFrame | None = None,
    usfs_records: DataFrame | None = None,
    bbox: ways.BBox | None = None,
    keep_private: bool = False,
    simplify: bool = True,
    usfs_snap_m: float = conflate.SNAP_M,
) -> ways.Graph:
    """From raw ways, nodes and points of interest to the routable graph.

    The box limits graph nodes and scenic features, never fuel stations.
    Forest roads bypass the way filter; where they cover mapped ways of low
    classes, those are dropped.
    """
    kept = all_ways.where(WayFilter(profile.allowed, keep_private=keep_private).keep(F.col("tags")))
    if usfs_records is not None:
        road_ways, road_nodes = map(materialise, conflate.road_ways(usfs_records, nodes, usfs_snap_m, bbox))
        kept = conflate.uncovered(kept, nodes, road_nodes, grid_step=profile.routing.grid_step)
        kept, nodes = ways.union_ways(kept, road_ways), ways.union_nodes(nodes.select("osm_id", "lat", "lon"), road_nodes)
    graph = ways.build_graph(kept, nodes, profile, features, bbox, keep_private, fuel)
    return contract.contract(graph) if simplify else graph
