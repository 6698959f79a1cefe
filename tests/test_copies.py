"""Long trips, and trips and boxes that are there many times: few of their pairs are looked at, with the same results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.functions import shapes
from waymesh.operators import cluster, edges as edge_ops, paths
from waymesh.operators.components import connected_components

EDGE = "edge_id long, src string, dst string, weight int, trj array<struct<x:double,y:double,t:double>>"
BOX = "node_id long, bbox struct<x1:double,x2:double,y1:double,y2:double,t1:double,t2:double>"


def squared(a, b):
    return np.concatenate([((a[i : i + 500, None, :2] - b[None, :, :2]) ** 2).sum(axis=2).min(axis=1) for i in range(0, len(a), 500)])


@pytest.mark.parametrize("kind", ["parallel", "places", "apart"])
def test_few_distances_of_long_trips_are_computed(monkeypatch, kind):
    rng, n = np.random.default_rng(1), 8000
    t = np.linspace(0, 9, n)
    if kind == "parallel":
        a, b = (np.stack([t * 1000, np.sin(t) * 500 + side, t], axis=1) for side in (0, 100))
    elif kind == "places":
        a, b = (np.column_stack([rng.integers(0, k, (n, 2)) * 2000 + rng.random((n, 2)) * 40, t]) for k in (5, 6))
    else:
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)) + 1e6
    computed, plain = [], shapes._nearest
    monkeypatch.setattr(shapes, "_nearest", lambda p, q, cells: computed.append(len(p) * len(q)) or plain(p, q, cells))
    want = float(np.sqrt(max(squared(a, b).max(), squared(b, a).max())))
    assert shapes.hausdorff(a, b) == shapes.hausdorff(b, a) == want
    assert 0 < sum(computed) < n * n / 50


def test_equal_trips_are_compared_once(spark, monkeypatch):
    ways = [[(10.0 * k, side, 10.0 * k + late) for k in range(20)] for side, late in ((0.0, 0.0), (3.0, 0.0), (3.0, 5.0), (900.0, 0.0))]
    odd = [(float("nan"), 0.0, 0.0), (1.0, 0.0, 1.0)]
    rows = [(i, "a", "b", 1, ways[i % 4]) for i in range(400)] + [(i, "a", "b", 1, odd) for i in (400, 401)]
    frame, asked, plain = spark.createDataFrame(rows, EDGE), [], edge_ops.edge_pairs
    monkeypatch.setattr(edge_ops, "edge_pairs", lambda df, *a, **k: asked.append(df.count()) or plain(df, *a, **k))
    clusters = edge_ops.shape_clusters(frame, 10.0)
    got = {r.edge_id: r.cluster_id for r in clusters.collect()}
    assert got == {i: i if i >= 400 else 3 if i % 4 == 3 else 0 for i in range(402)}
    # of the three ways of cluster 0, the second and the third have an equal place, and the second is nearer in time to both others
    assert {(r.edge_id, r.weight) for r in edge_ops.medoids(frame.where("edge_id < 400"), clusters).collect()} == {(1, 300), (3, 100)}
    assert asked == [5, 4]
    assert {r.edge_id: r.cluster_id for r in edge_ops.shape_clusters(frame.where("edge_id < 9"), 0.0).collect()} == {i: i for i in range(9)}


def test_medoid_counts_equal_trips(spark):
    """Two of five trips are equal: each of the others is as far from both."""
    sides = [0.0, 4.0, 4.0, 7.0, 9.0]
    frame = spark.createDataFrame([(i, "a", "b", 1, [(0.0, s, 0.0), (9.0, s, 8.0)]) for i, s in enumerate(sides)], EDGE)
    together = frame.select("edge_id", F.lit(0).cast("long").alias("cluster_id"))
    total = {i: 8 * sum(abs(s - u) for u in sides) for i, s in enumerate(sides)}
    assert [(r.edge_id, r.weight) for r in edge_ops.medoids(frame, together).collect()] == [(min(total, key=lambda i: (total[i], i)), 5)]


def test_equal_boxes_overlap_once(spark, monkeypatch):
    sides = [(0.0, 10.0, 0.0, 10.0), (3.0, 13.0, 0.0, 10.0), (500.0, 510.0, 0.0, 10.0), (50.0, 50.0, 0.0, 9.0)]  # the last has no area
    rows = [(i, (*sides[i % 4], float(i), float(i + 1))) for i in range(200)]
    asked, plain = [], cluster.overlapping_boxes
    monkeypatch.setattr(cluster, "overlapping_boxes", lambda df, *a, **k: asked.append(df.count()) or plain(df, *a, **k))
    got = {r.node_id: (r.cluster_id, tuple(r.bbox)) for r in cluster.merge_boxes(spark.createDataFrame(rows, BOX)).collect()}
    want = {}
    for i, (_, box) in enumerate(rows):
        want[i] = (0, (0.0, 13.0, 0.0, 10.0, 0.0, 198.0)) if i % 4 < 2 else (2, (*sides[2], 2.0, 199.0)) if i % 4 == 2 else (i, box)
    assert got == want and asked[0] == 3 + 50


def test_pairs_of_few_long_trips_are_dealt(spark):
    trj = F.expr("transform(sequence(0, 20000), i -> struct(cast(i + id as double) as x, 0D as y, cast(i as double) as t))")
    frame = spark.range(24).select(F.col("id").alias("edge_id"), F.lit(1).alias("src"), F.lit(2).alias("dst"), trj.alias("trj")).coalesce(1)
    pairs = edge_ops.edge_pairs(frame).select("a", "b", F.spark_partition_id().alias("at")).collect()
    assert len({(r.a, r.b) for r in pairs}) == len(pairs) == 24 * 23 // 2
    assert len({r.at for r in pairs}) > 2


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_components_in_one_task_equal_rounds(spark, kind):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1, None), (5, 5), (5, 5)]
    links = spark.createDataFrame(pairs, "a long, b long").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    one, rounds = ({r.id: r.component for r in connected_components(links, one_task=n).collect()} for n in (10_000, 0))
    assert one == rounds and 1 < len(set(one.values())) < len(one)


def test_walk_on_numbers_keeps_nan():
    box = paths.Box(np.array([0.0, 0.0, 0.0]), np.array([1.0, 1.0, 1.0]))
    for p in ([2.0, -1.0, 5.0], [float("nan"), 0.5, 2.0], [0.5, float("nan"), float("nan")]):
        sides = paths._grown((0.0, 1.0, 0.0, 1.0, 0.0, 1.0), *p)
        for q in (p, [0.1, 7.0, 0.2]):
            grown, sides = box.with_points(np.array(p)).with_points(np.array(q)), paths._grown(sides, *q)
            assert np.array_equal(np.stack([grown.low, grown.high], axis=1).ravel(), sides, equal_nan=True)
