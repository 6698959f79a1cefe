"""Shape clusters of large groups, covered by balls, against single linkage over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymesh.operators import balls, edges as edge_ops

SCHEMA = "edge_id long, src string, dst string, weight int, trj array<struct<x:double,y:double,t:double>>"
NEAR = 10.0


def trips(seed, n, *, spread):
    """Trips on three kinds of ways between two places, shifted sideways so that some shapes run into others."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        way, side = rng.randrange(3), rng.choice([rng.uniform(0, spread), rng.gauss(0, 2)])
        bend = [0, 40, -70][way]
        trj = [(x + rng.gauss(0, 0.3), bend * math.sin(x / 200 * math.pi) + side + rng.gauss(0, 0.3), 10.0 * x) for x in range(0, 201, rng.choice([8, 10]))]
        out.append((i, "a" if i % 7 else None, "b", 1, trj))
    return out + [(n + k, "a", "b", 1, out[k][4]) for k in range(5)]


def distance(p, q):
    one = lambda u, v: max(min((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 for b in v) for a in u)
    return math.sqrt(max(one(p, q), one(q, p)))


def linked(rows, near):
    label = {r[0]: r[0] for r in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(rows):
        for b in rows[:k]:
            if a[1] == b[1] == "a" and distance(a[4], b[4]) < near:
                low, high = sorted((root(a[0]), root(b[0])))
                label[high] = low
    return {i: root(i) for i in label}


@pytest.mark.parametrize("seed,n,spread,block", [(1, 120, 60.0, 8), (2, 90, 400.0, 8), (3, 140, 150.0, 30)])
def test_balls_equal_single_linkage(spark, seed, n, spread, block):
    rows = [r for r in trips(seed, n, spread=spread) if r[1]]
    found = edge_ops.shape_clusters(spark.createDataFrame(rows, SCHEMA), NEAR, block=block)
    want = linked(rows, NEAR)
    got = {r.edge_id: r.cluster_id for r in found.collect()}
    assert got == want and 1 < len(set(want.values())) < len(rows) - 20


def test_small_and_large_groups_together(spark):
    rows = trips(4, 60, spread=80.0)
    frame = spark.createDataFrame([(i, s, d if i % 5 else "c", w, t) for i, s, d, w, t in rows], SCHEMA)
    by = {b: {r.edge_id: r.cluster_id for r in edge_ops.shape_clusters(frame, NEAR, block=b).collect()} for b in (12, 1000)}
    assert by[12] == by[1000] and len(by[12]) == len(rows)
    assert edge_ops.shape_clusters(frame.limit(0), NEAR).count() == 0


def test_balls_cover_each_trip_once(spark):
    frame = spark.createDataFrame([r for r in trips(5, 80, spread=50.0)], SCHEMA)
    rows = frame.select(F.struct("src", "dst").alias("grp"), "edge_id", "trj", edge_ops.bbox.of_array(F.col("trj")).alias("box"))
    got = {r.edge_id: (r.leader, r.dist) for r in balls.leaders(rows, edge_ops.hausdorff, NEAR / 2, block=8).collect()}
    at = {r[0]: r for r in trips(5, 80, spread=50.0)}
    assert got.keys() == at.keys()
    for i, (head, dist) in got.items():
        assert got[head] == (head, 0.0) and at[i][1] == at[head][1] and dist < NEAR / 2 and math.isclose(dist, distance(at[i][4], at[head][4]), abs_tol=1e-9)
