"""From points to a movement graph.

``build_graph``: time guard, timeout segments, endpoints clustered into places,
trajectories as edges, places split in time of day, parallel edges clustered by
shape, one representative for each cluster.

``build_path_graph``: stops and routes of each segment, stops that overlap
united into places, then the same split and medoids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import bbox
from ..operators import clean, cluster, edges as edge_ops, motion, paths, segment, split, verify
from ..shared import cut, spread


def trips_of(points: DataFrame, keys: list[str], order: list[str], config: Config, *, id: str, spikes: bool = False) -> DataFrame:
    """Cleaned and segmented trajectories, named by the least ``id`` of their points."""
    clean_points = clean.time_guard(points, keys, order)
    if spikes:
        clean_points = clean.spike_filter(clean_points, keys, order, config.window_size)
    parts = segment.timeout_segments(clean_points, keys, order, config.connection_timeout)
    return segment.trajectories(parts, keys, order, min_points=config.min_points, id=id)


def place_graph(trips: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Places (clusters of endpoints) and one edge a trip, by membership: no range join."""
    ends = cut(segment.endpoints(trips))
    members = cut(cluster.cluster_endpoints(ends, config.clustering_threshold, config.temporal_slack_ms))
    nodes = ends.join(members, "ep_id").groupBy(F.col("cluster_id").alias("node_id")).agg(
        F.count("*").cast("int").alias("weight"), bbox.of_rows("x", "y", "t").alias("bbox")
    )
    at = ends.join(members, "ep_id").groupBy("trj_id").agg(
        F.max(F.when(~F.col("is_end"), F.col("cluster_id"))).alias("src"), F.max(F.when(F.col("is_end"), F.col("cluster_id"))).alias("dst")
    )
    # never by broadcast of the trips: as a table they are a tenth of what their points take in memory
    edges = trips.hint("merge").join(at, "trj_id").select(F.col("trj_id").alias("edge_id"), "src", "dst", F.lit(1).alias("weight"), "trj")
    return nodes, edges


def representatives(edges: DataFrame, config: Config) -> DataFrame:
    """One simplified edge for each cluster of parallel edges of one shape, weighted by the cluster."""
    clusters = cut(edge_ops.shape_clusters(edges, config.max_hausdorff_meters))
    if config.use_centroids:
        chosen = edge_ops.centroids(edges, clusters, config.visvalingam_threshold)
    else:
        chosen = edge_ops.medoids(edges, clusters)
    # few bytes, but work on every point
    return edge_ops.simplify(spread(chosen.select("edge_id", "src", "dst", "weight", "trj"), "edge_id"), config.visvalingam_threshold)


def lasting(edges: DataFrame) -> DataFrame:
    """Edges of positive duration: those the split in time can order."""
    return edges.where(F.element_at("trj", -1)["t"] > F.col("trj")[0]["t"])


def build_graph(points: DataFrame, keys: list[str], order: list[str], config: Config = Config(), *, id: str, spikes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, place, slice, weight, bbox, slice_weight) and edges (edge_id, src, dst, weight, trj)."""
    nodes, edges = place_graph(cut(trips_of(points, keys, order, config, id=id, spikes=spikes)), config)
    nodes, edges = split.make_monotone(nodes, lasting(edges))
    return nodes, representatives(cut(edges), config)


def counters(places: DataFrame, edges: DataFrame, slices: DataFrame, representatives: DataFrame) -> DataFrame:
    """One row: places found, trip ends that were merged into them, slices that places were split into, and edges merged into representatives."""
    tables = {"spatial_clusters": places, "edges": edges, "slices": slices, "kept": representatives}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, counts).agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables))
    return rows.select(
        "spatial_clusters", (2 * F.col("edges") - F.col("spatial_clusters")).alias("node_merges"), (F.col("slices") - F.col("spatial_clusters")).alias("node_splits"),
        (F.col("edges") - F.col("kept")).alias("edge_merges"),
    )


def stop_points(points: DataFrame, keys: list[str], order: list[str], config: Config) -> DataFrame:
    """Segmented points with velocity, motion and stop state."""
    parts = segment.timeout_segments(clean.time_guard(points, keys, order), keys, order, config.connection_timeout)
    own = [*keys, "seg"]
    moved = motion.velocity(parts, own, order, config.motion_detector_timespan)
    moved = motion.motion_state(moved, own, order, config.minimum_velocity + config.epsilon_velocity)
    return motion.stop_state(moved, own, order, config.bbox_max_meters, config.bbox_min_minutes)


def path_items(points: DataFrame, keys: list[str], order: list[str], config: Config) -> DataFrame:
    return paths.paths(stop_points(points, keys, order, config), [*keys, "seg"], order, config.bbox_max_meters)


def path_counters(points: DataFrame, keys: list[str], order: list[str], config: Config) -> DataFrame:
    """One row: segments walked, paths made of them, their stops and routes, and the stops and routes that were removed as redundant."""
    counts = paths.path_counts(stop_points(points, keys, order, config), [*keys, "seg"], order, config.bbox_max_meters)
    made = F.when(F.col("items") > 0, F.col("items"))
    return counts.agg(
        F.count("*").alias("segments"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.count(made).alias("paths"),
        F.coalesce(F.sum((made + 1) / 2).cast("long"), F.lit(0)).alias("stops"), F.coalesce(F.sum((made - 1) / 2).cast("long"), F.lit(0)).alias("routes"),
        F.coalesce(F.sum("redundant_nodes"), F.lit(0)).alias("redundant_node_removals"), F.coalesce(F.sum("redundant_trjs"), F.lit(0)).alias("redundant_trj_removals"),
    )


def path_graph(items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A node a stop and an edge a route; a path's first stop is a root."""
    name = F.xxhash64(*keys, "pos")
    nodes = items.where("kind = 'stop'").select(name.alias("node_id"), F.lit(1).alias("weight"), "bbox", (F.col("pos") == 0).alias("is_root"))
    to = lambda d: F.xxhash64(*keys, (F.col("pos") + d).cast("int"))
    edges = items.where("kind = 'route'").select(name.alias("edge_id"), to(-1).alias("src"), to(1).alias("dst"), F.lit(1).alias("weight"), "trj")
    return nodes, edges


def build_path_graph(points: DataFrame, keys: list[str], order: list[str], config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Nodes (with is_root) and edges of the graph of stops and routes."""
    items = cut(path_items(points, keys, order, config))
    stops, routes = path_graph(items, [*keys, "seg"])
    merged = cut(cluster.merge_boxes(stops.select("node_id", "bbox")))
    to = lambda c: merged.select(F.col("node_id").alias(c), F.col("cluster_id").alias(f"{c}_place"))
    edges = routes.join(to("src"), "src").join(to("dst"), "dst").select("edge_id", F.col("src_place").alias("src"), F.col("dst_place").alias("dst"), "weight", "trj")
    sized = cluster.minimal_boxes(merged, routes).groupBy(F.col("cluster_id").alias("node_id")).agg(F.count("*").cast("int").alias("weight"), F.first("bbox").alias("bbox"))
    nodes, edges = split.make_monotone(sized, lasting(edges))
    edges = representatives(cut(edges), config)
    first = verify.roots(nodes, edges).select("node_id", F.lit(True).alias("is_root"))
    return nodes.join(first, "node_id", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False))), edges
