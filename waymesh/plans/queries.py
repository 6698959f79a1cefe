"""The operators as queries over the ``events`` table, and their SQL.

``events`` become points of eight streams on a lattice of places; every fifth
row arrives late, so that the time guard has something to drop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import bbox, geo
from ..operators import clean, cluster, edges as edge_ops, motion, segment, split, verify
from ..shared import cut
from ..sources import readers, sinks
from . import graph

KEYS, ORDER = ["stream_id", "day"], ["seq"]
CONFIG = Config(
    connection_timeout=3_600_000, clustering_threshold=500.0, max_hausdorff_meters=3000.0, motion_detector_timespan=600_000,
    minimum_velocity=3.5, epsilon_velocity=0.5, bbox_max_meters=4000.0, bbox_min_minutes=10.0,
)
#: A slack just below 24 hours: time weighs a little, so that the grid has three axes.
PAIR_SLACK_MS, PAIR_METERS = 86_399_999.99, 500.0
#: Boxes of places are widened by this much to overlap; shares of their area count from half on.
OVERLAP_PAD, OVERLAP_CELL = 3000.0, 2000.0


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, stream_id, day, seq, ts, lat, lon, x, y, t_ms."""
    value, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", (F.col("user_id") % 8).alias("stream_id"), F.col("ts").cast("date").alias("day"), "ts",
        (F.col("event_id") + F.when(F.col("event_id") % 5 == 0, 40).otherwise(0)).alias("seq"),
        (55 + F.floor(value / 25) * 0.02 + (value - F.floor(value / 25) * 25) / 100000).alias("lat"),
        (10 + (k % 4) * 0.02 + F.floor(k / 4) / 100000).alias("lon"), geo.time_of_day_ms("ts").alias("t_ms"),
    )
    return rows.withColumn("x", geo.mercator_x("lon")).withColumn("y", geo.mercator_y("lat"))


def _clean(spark, sf_dir) -> DataFrame:
    return clean.time_guard(event_points(spark, sf_dir), KEYS, ORDER)


def _segments(spark, sf_dir) -> DataFrame:
    return segment.timeout_segments(_clean(spark, sf_dir), KEYS, ORDER, CONFIG.connection_timeout)


def _trips(spark, sf_dir) -> DataFrame:
    return graph.trips_of(event_points(spark, sf_dir), KEYS, ORDER, CONFIG, id="event_id")


def _places(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return graph.place_graph(cut(_trips(spark, sf_dir)), CONFIG)


def _sides(box: str = "bbox", places: int = 3) -> list:
    return [F.round(F.col(box)[s], places).alias(s) for s in bbox.SIDES]


def project_points(spark, sf_dir):
    return event_points(spark, sf_dir).select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "t_ms")


def unproject_points(spark, sf_dir):
    rows = event_points(spark, sf_dir)
    return rows.select("event_id", F.round(geo.latitude("y"), 8).alias("lat"), F.round(geo.longitude("x"), 8).alias("lon"))


def time_guard(spark, sf_dir):
    return _clean(spark, sf_dir).select("event_id", "stream_id", "t_ms")


def day_runs(spark, sf_dir):
    return clean.day_runs(event_points(spark, sf_dir), ["stream_id"], ORDER).select("event_id", "stream_id", "run")


def timeout_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("event_id", "stream_id", "seg", "t_ms")


def alive_flags(spark, sf_dir):
    return segment.alive(_clean(spark, sf_dir), KEYS, ORDER, CONFIG.connection_timeout).select("event_id", "is_alive")


def segment_summary(spark, sf_dir):
    rows = segment.segment_summary(_segments(spark, sf_dir), KEYS, ORDER)
    return rows.select(*KEYS, "seg", "n", F.col("start.t").alias("start_t"), F.col("end.t").alias("end_t"), *_sides())


def path_stats(spark, sf_dir):
    return segment.path_stats(_trips(spark, sf_dir))


def endpoint_pairs(spark, sf_dir):
    ends = segment.endpoints(cut(_trips(spark, sf_dir)))
    return cluster.near_pairs(ends, PAIR_METERS, PAIR_SLACK_MS).select("i", "j", F.round("dist", 3).alias("dist"))


def endpoint_clusters(spark, sf_dir):
    ends = cut(segment.endpoints(_trips(spark, sf_dir)))
    return cluster.cluster_endpoints(ends, CONFIG.clustering_threshold, CONFIG.temporal_slack_ms)


def node_table(spark, sf_dir):
    nodes, _ = _places(spark, sf_dir)
    return nodes.select("node_id", "weight", *_sides())


def edge_table(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return edges.select("edge_id", "src", "dst", F.size("trj").alias("n"))


def edge_groups(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return edge_ops.edge_groups(edges)


def temporal_splits(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return split.temporal_splits(graph.lasting(edges)).select("node_id", F.posexplode("cuts").alias("cut_no", "cut"))


def split_edges(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    edges = cut(graph.lasting(edges))
    return split.split_edges(edges, cut(split.cut_rows(edges))).select("edge_id", "src", "src_slice", "dst", "dst_slice")


def _split_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _places(spark, sf_dir)
    return split.make_monotone(nodes, cut(graph.lasting(edges)))


def split_nodes(spark, sf_dir):
    nodes, _ = _split_graph(spark, sf_dir)
    return nodes.select("node_id", "weight", "slice_weight", *_sides())


def roots(spark, sf_dir):
    return verify.roots(*_split_graph(spark, sf_dir)).select("node_id")


def isolated_nodes(spark, sf_dir):
    """Places that no trip leaves for another of a lesser number."""
    nodes, edges = _places(spark, sf_dir)
    return verify.isolated(nodes, graph.lasting(edges).where("dst < src")).select("node_id", "weight")


def loops(spark, sf_dir):
    return verify.loops(_places(spark, sf_dir)[1]).select("edge_id", "src")


def monotonicity_violations(spark, sf_dir):
    return verify.monotonicity_violations(*_places(spark, sf_dir)).select("edge_id", "src", "dst", "starts", "opens")


def split_violations(spark, sf_dir):
    """Loops and edges that another edge leaves their target before, by graph: of the places there are some, of their slices none."""
    _, edges = _places(spark, sf_dir)
    edges = cut(graph.lasting(edges))
    _, slices = split.make_monotone(_places(spark, sf_dir)[0], edges)
    rows = None
    for name, own in (("places", edges), ("slices", slices)):
        starts = own.select("edge_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("trj")[0]["t"].alias("starts"))
        # the next edge of a path always starts later
        follow = starts.select(F.col("src").alias("dst"), F.col("starts").alias("next")).groupBy("dst").agg(F.min("next").alias("next"))
        found = starts.join(follow, "dst").where("next <= starts or src = dst").select(F.lit(name).alias("graph"), "edge_id")
        rows = found if rows is None else rows.unionByName(found)
    return rows


def reachability_in_time(spark, sf_dir):
    nodes, edges = _places(spark, sf_dir)
    edges = cut(edges)
    return verify.reachable_in_time(cut(nodes), edges, edges.agg(F.min("src").alias("node_id")))


def constraint_report(spark, sf_dir):
    """Roots are the two places of least number, as it were."""
    nodes, edges = _places(spark, sf_dir)
    nodes = cut(nodes)
    first = nodes.select("node_id").orderBy("node_id").limit(2).withColumn("is_root", F.lit(True))
    marked = nodes.join(first, "node_id", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))
    return verify.constraint_report(marked, cut(edges.where("src < dst")), in_time=True)


def pruned_graph(spark, sf_dir):
    """The graph without places of fewer than 40 trip ends, and its roots by trips to greater numbers."""
    nodes, edges = _places(spark, sf_dir)
    nodes, left = verify.remove_nodes(cut(nodes), cut(edges.where("src < dst")), nodes.where("weight < 40"))
    return nodes.select("node_id", "weight", "is_root")


def minimal_boxes(spark, sf_dir):
    nodes, edges = _places(spark, sf_dir)
    members = nodes.select("node_id", F.col("node_id").alias("cluster_id"), "bbox")
    return cluster.minimal_boxes(members, edges).select("node_id", *_sides())


def edge_boxes(spark, sf_dir):
    """What boxes say of each other and of points: the boxes of an edge's two places, and its first point."""
    nodes, edges = _places(spark, sf_dir)
    at = lambda c: nodes.select(F.col("node_id").alias(c), F.col("bbox").alias(f"{c}_box"))
    rows = edges.join(at("src"), "src").join(at("dst"), "dst").withColumn("p", F.element_at("trj", -1))
    a, b, p = F.col("src_box"), F.col("dst_box"), F.col("p")
    both, grown, parts = bbox.union(a, b), bbox.with_point(a, p), bbox.split_at(a, p["t"])
    three = lambda c: F.round(c, 3)
    return rows.select(
        "edge_id", bbox.contains(a, p).alias("contains"), bbox.in_temporal(a, p).alias("in_time"), bbox.in_spatial(a, p).alias("in_space"),
        bbox.is_before(a, b).alias("before"), bbox.is_single_point(a).alias("single"), bbox.fits_spatially(both, 5000.0).alias("fits_space"),
        bbox.fits_temporally(a, 600.0).alias("fits_time"), bbox.can_contain(a, F.col("trj"), 5000.0).alias("can_contain"), (bbox.time_order(a) < bbox.time_order(b)).alias("sooner"),
        three(both["x1"]).alias("union_x1"), three(both["t2"]).alias("union_t2"), three(grown["x2"]).alias("grown_x2"), three(grown["y1"]).alias("grown_y1"),
        three(bbox.longest_side(both)).alias("longest"), three(bbox.longest_side(both, shorter=True)).alias("shortest"), three(bbox.area(both)).alias("area"),
        three(parts[0]["t2"]).alias("first_t2"), three(parts[1]["t1"]).alias("second_t1"), geo.is_monotone(F.col("trj")).alias("monotone"), geo.clock(p["t"]).alias("clock"),
    )


def graph_dot(spark, sf_dir):
    nodes, edges = _places(spark, sf_dir)
    return sinks.dot_lines(nodes, edges)


def graph_json(spark, sf_dir):
    """What readers of the JSON lines get back."""
    nodes, edges = _places(spark, sf_dir)
    kind = "kind string, id string, src string, dst string, weight int, bbox struct<x1:double,t2:double>, trj array<struct<x:double>>"
    rows = sinks.json_lines(nodes, edges).select(F.from_json("value", kind).alias("o")).select("o.*")
    return rows.select("kind", "id", "src", "dst", "weight", F.round("bbox.x1", 3).alias("x1"), F.coalesce(F.size("trj"), F.lit(-1)).alias("n")).na.fill("", ["src", "dst"]).na.fill(0.0, ["x1"])


def nodes_csv(spark, sf_dir):
    """Numbers as plain digits, read back."""
    rows = sinks.node_table(_places(spark, sf_dir)[0])
    return rows.select("label", "weight", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("x1", "y1", "t1", "x2", "y2", "t2")), F.concat("x1", "t2").rlike("[eE]").alias("has_exponent"))


def edges_csv(spark, sf_dir):
    rows = sinks.edge_table(_places(spark, sf_dir)[1])
    return rows.select("edge_id", "src", "dst", "weight", "pos", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in "xyt"))


def run_counters(spark, sf_dir):
    nodes, edges = _places(spark, sf_dir)
    nodes, edges = cut(nodes), cut(edges)
    slices, moved = split.make_monotone(nodes, graph.lasting(edges))
    clusters = edge_ops.shape_clusters(edges, CONFIG.max_hausdorff_meters)
    return graph.counters(nodes, edges, slices, clusters.select("cluster_id").distinct())


def reachability(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    edges = cut(edges)
    return verify.reachable(edges, edges.agg(F.min("src").alias("node_id")))


def _velocity(spark, sf_dir):
    return motion.velocity(_segments(spark, sf_dir), [*KEYS, "seg"], ORDER, CONFIG.motion_detector_timespan)


def motion_velocity(spark, sf_dir):
    return _velocity(spark, sf_dir).select("event_id", F.round("kmh", 3).alias("kmh"))


def stop_epochs(spark, sf_dir):
    return graph.stop_points(event_points(spark, sf_dir), KEYS, ORDER, CONFIG).select("event_id", "motion", "epoch", "stop")


def hausdorff_pairs(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return edge_ops.hausdorff_pairs(edges).select("a", "b", F.round("dist", 3).alias("dist"))


def dissim_pairs(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return edge_ops.dissim_pairs(edges).select("a", "b", F.round(F.col("dissim") / 1e6, 3).alias("dissim"))  # km s


def area_pairs(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return edge_ops.area_pairs(edges).select("a", "b", F.round(F.col("area") / 1e6, 3).alias("area"))  # km s


def bbox_overlap(spark, sf_dir):
    nodes, _ = _places(spark, sf_dir)
    wide = nodes.select("node_id", bbox.padded(F.col("bbox"), OVERLAP_PAD).alias("bbox"))
    return cluster.overlapping_boxes(wide, 0.5, cell=OVERLAP_CELL).select("i", "j", F.round("share", 6).alias("share"))


def merged_boxes(spark, sf_dir):
    nodes, _ = _places(spark, sf_dir)
    wide = nodes.select("node_id", bbox.padded(F.col("bbox"), OVERLAP_PAD / 2).alias("bbox"))
    return cluster.merge_boxes(cut(wide), 0.5, cell=OVERLAP_CELL).select("node_id", "cluster_id", *_sides())


def medoid_edges(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    edges = cut(edges)
    return edge_ops.medoids(edges, cut(edge_ops.shape_clusters(edges, CONFIG.max_hausdorff_meters))).select("edge_id", "src", "dst", "weight")


def shape_clusters(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return edge_ops.shape_clusters(cut(edges), CONFIG.max_hausdorff_meters)


def centroid_edges(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    edges = cut(edges)
    clusters = cut(edge_ops.shape_clusters(edges, CONFIG.max_hausdorff_meters))
    rows = edge_ops.centroids(edges, clusters, CONFIG.visvalingam_threshold)
    return rows.select("edge_id", "src", "dst", "weight", F.size("trj").alias("n"))


def simplified_edges(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return edge_ops.simplify(edges, 10_000.0).select("edge_id", F.size("trj").alias("n"))


def ch_filtered(spark, sf_dir):
    return clean.spike_filter(_clean(spark, sf_dir), KEYS, ORDER, CONFIG.window_size).select("event_id", "stream_id")


def paths(spark, sf_dir):
    items = graph.path_items(event_points(spark, sf_dir), KEYS, ORDER, CONFIG)
    return items.select(*KEYS, "seg", "pos", "kind", F.size("trj").alias("n"), *_sides())


def path_counters(spark, sf_dir):
    return graph.path_counters(event_points(spark, sf_dir), KEYS, ORDER, CONFIG)


def movement_graph(spark, sf_dir):
    _, edges = graph.build_graph(event_points(spark, sf_dir), KEYS, ORDER, CONFIG, id="event_id")
    return edges.select("edge_id", "src", "dst", "weight", F.size("trj").alias("n"))


def path_movement_graph(spark, sf_dir):
    _, edges = graph.build_path_graph(event_points(spark, sf_dir), KEYS, ORDER, CONFIG)
    return edges.select("edge_id", "src", "dst", "weight", F.size("trj").alias("n"))


# ---- readers: the points as texts of each format, one a stream and day, read back ----


#: About as many points a partition of texts has, as far as there are as many texts.
TEXT_ROWS = 25_000


def _texts(spark, sf_dir, header: str, line, between: str = "\n", tail: str = "") -> DataFrame:
    points = event_points(spark, sf_dir)
    rows = points.select(F.concat_ws("/", "stream_id", "day").alias("source"), "seq", line.alias("line"))
    rows = rows.repartition(points.count() // TEXT_ROWS + 1, "source")  # a number, so that few tasks don't get many texts to parse
    lines = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), between)
    return lines.select("source", F.concat(F.lit(header), body, F.lit(tail)).alias("value"))


def _read(rows: DataFrame) -> DataFrame:
    return rows.select("source", "day", "seq", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "t_ms")


def read_gpx(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    line = F.concat(F.lit('<trkpt lat="'), "lat", F.lit('" lon="'), "lon", F.lit('"><ele>1.5</ele><time>'), stamp, F.lit("Z</time></trkpt>"))
    return _read(readers.read_points(_texts(spark, sf_dir, "<gpx><trk><trkseg>\n", line, tail="\n</trkseg></trk></gpx>")))


def read_gpx_strict(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    line = F.concat(F.lit('<trkpt lat="'), "lat", F.lit('" lon="'), "lon", F.lit('"><ele>1.5</ele><time>'), stamp, F.lit("Z</time></trkpt>"))
    return _read(readers.read_points(_texts(spark, sf_dir, "<gpx><trk><trkseg>\n", line), strict_gpx=True))


def read_plt(spark, sf_dir):
    day = F.datediff("day", F.lit("1899-12-30"))
    line = F.concat_ws(",", "lat", "lon", F.lit("0"), F.lit("99"), day, F.col("day").cast("string"), F.date_format("ts", "HH:mm:ss.SSS"))
    return _read(readers.read_points(_texts(spark, sf_dir, "Geolife trajectory\nWGS 84\nAltitude is in Feet\n", line)))


def read_ais(spark, sf_dir):
    line = F.concat_ws(",", "stream_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "lon", "lat", F.lit("1,2,3,4,5"))
    return _read(readers.read_points(_texts(spark, sf_dir, readers.AIS_HEADER + "\n", line)))


def read_synthetic(spark, sf_dir):
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), "lat", "lon", "stream_id", F.lit(""))
    return _read(readers.read_points(_texts(spark, sf_dir, readers.SYNTHETIC_HEADER + "\n", line)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        project_points, unproject_points, time_guard, day_runs, timeout_segments, alive_flags, segment_summary, path_stats, endpoint_pairs,
        endpoint_clusters, node_table, edge_table, edge_groups, temporal_splits, split_edges, split_nodes, roots, isolated_nodes, loops,
        monotonicity_violations, split_violations, reachability, motion_velocity, stop_epochs, hausdorff_pairs, dissim_pairs, area_pairs,
        bbox_overlap, merged_boxes, medoid_edges, shape_clusters, centroid_edges, simplified_edges, ch_filtered, paths, movement_graph,
        path_movement_graph, read_gpx, read_plt, read_ais, read_synthetic, read_gpx_strict, reachability_in_time, constraint_report, pruned_graph,
        minimal_boxes, edge_boxes, graph_dot, graph_json, nodes_csv, edges_csv, run_counters, path_counters,
    )
}
