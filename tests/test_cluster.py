"""Clusters of crowded places against single linkage over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymesh.functions import bbox, geo
from waymesh.operators import cluster
from waymesh.operators.components import connected_components

SCHEMA = "ep_id long, x double, y double, t double"


def linked(rows, threshold, weight):
    """Least member of each point's cluster."""
    label = {r[0]: r[0] for r in rows}

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for k, a in enumerate(rows):
        for b in rows[:k]:
            dx, dy, dt = a[1] - b[1], a[2] - b[2], a[3] - b[3]
            if math.sqrt(dx * dx + dy * dy + weight * dt * dt) < threshold:
                low, high = sorted((root(a[0]), root(b[0])))
                label[high] = low
    return {i: root(i) for i in label}


def crowd(seed, n, slack):
    """A crowded station, two crowds whose nearest points are a threshold apart, equal positions, and some points around."""
    rng = random.Random(seed)
    time = lambda: float(rng.randrange(0, 86_400_000)) if slack < 86_400_000 else 0.0
    rows = [(rng.gauss(0, 12), rng.gauss(0, 12), time()) for _ in range(n)]
    rows += [(200 + rng.random() * 15, rng.random() * 15, 5.0) for _ in range(n // 3)] + [(245 + rng.random() * 15, rng.random() * 15, 5.0) for _ in range(n // 3)]
    rows += [(215.0, 7.0, 5.0), (245.0, 7.0, 5.0)] + [(5.0, 5.0, 0.0)] * 20 + [(rng.uniform(-300, 300), rng.uniform(-300, 300), time()) for _ in range(n // 3)]
    rng.shuffle(rows)
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("slack,n", [(86_400_000.0, 500), (86_399_999.999_999, 400), (86_399_000.0, 300)])
@pytest.mark.parametrize("direct", [cluster.DIRECT_PAIRS, 4])
def test_crowded_places(spark, slack, n, direct):
    rows = crowd(1, n, slack)
    found = cluster.cluster_endpoints(spark.createDataFrame(rows, SCHEMA), 30.0, slack, direct=direct)
    want = linked(rows, 30.0, geo.time_weight(slack))
    assert {r.ep_id: r.cluster_id for r in found.collect()} == want and 2 < len(set(want.values())) < len(rows) - 50


def test_pairs_of_a_crowd_are_not_listed(spark):
    """20,000 points in two neighbouring cells: links are as many as points, and few cells are left to compare."""
    points = spark.range(20_000).select(F.col("id").alias("ep_id"), (F.rand(1) * 19 + F.when(F.col("id") % 2 == 0, 0.0).otherwise(40.0)).alias("x"), (F.rand(2) * 19).alias("y"), F.lit(0.0).alias("t")).cache()
    links = cluster.cell_links(points, 30.0, 0.0).cache()
    assert links.count() < 20_010 and connected_components(links, "i", "j").select("component").distinct().count() == 1


BOX = "struct<x1:double,x2:double,y1:double,y2:double,t1:double,t2:double>"


def test_boxes_of_very_unlike_sizes(spark):
    rng = random.Random(2)
    sizes = [0.0, 3.0, 40.0, 99.0, 100.0, 101.0, 900.0, 30_000.0, 1_000_000.0]
    rows = []
    for i in range(300):
        x, y = rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)
        w, h = rng.choice(sizes[:7]), rng.choice(sizes[:7])
        rows.append((i, (x, x + w, y, y + h, 0.0, 1.0)))
    rows += [(900 + k, (-s / 2, s / 2, -s / 3, s / 3, 0.0, 1.0)) for k, s in enumerate(sizes[6:])]
    frame = spark.createDataFrame(rows, f"node_id long, bbox {BOX}")
    got = {(r.i, r.j): r.share for r in cluster.overlapping_boxes(frame, 0.5).collect()}
    both = frame.select(F.col("node_id").alias("i"), F.col("bbox").alias("a")).crossJoin(frame.select(F.col("node_id").alias("j"), F.col("bbox").alias("b"))).where("i < j")
    want = {(r.i, r.j): r.share for r in both.select("i", "j", bbox.overlap_share(F.col("a"), F.col("b")).alias("share")).where("share >= 0.5").collect()}
    assert got == want and len(want) > 300
    assert cluster.overlapping_boxes(frame.limit(0)).count() == 0


def test_one_large_box_over_many_small(spark):
    small = spark.range(100_000).select(F.col("id").alias("node_id"), F.struct(*((F.pmod(F.xxhash64("id", F.lit(c)), F.lit(900_000)) + F.lit(w)).cast("double").alias(f"{c}{n}") for c in "xy" for n, w in ((1, 0), (2, 1))), F.lit(0.0).alias("t1"), F.lit(0.0).alias("t2")).alias("bbox"))
    large = spark.createDataFrame([(-1, (0.0, 1e6, 0.0, 1e6, 0.0, 0.0))], f"node_id long, bbox {BOX}")
    found = cluster.overlapping_boxes(small.unionByName(large), 0.5)
    assert found.where("i = -1").count() == 100_000
