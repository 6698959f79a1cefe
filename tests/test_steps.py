"""Cleaning, segments, motion, clustering and splitting on small inputs and against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.config import Config, duration_ms
from waymesh.functions import bbox, geo, shapes
from waymesh.operators import clean, cluster, edges as edge_ops, motion, paths, segment, split, verify
from waymesh.operators.components import connected_components


def points(spark, rows):
    """Rows (stream, seq, x, y, t)."""
    rows = [(k, i, float(x), float(y), t) for k, i, x, y, t in rows]
    return spark.createDataFrame(rows, "stream long, seq long, x double, y double, t_ms long")


def stream(ts, key=1):
    return [(key, i, float(i), 0.0, t) for i, t in enumerate(ts)]


def trip(spark, rows):
    """Rows (edge_id, src, dst, [(x, y, t)])."""
    return spark.createDataFrame([(i, s, d, 1, [tuple(map(float, p)) for p in t]) for i, s, d, t in rows], "edge_id long, src long, dst long, weight int, trj array<struct<x:double,y:double,t:double>>")


def test_config():
    assert Config.from_json('{"window_size": 7, "relax_bbox_minutes": 60}').window_size == 7
    assert (duration_ms("24h"), duration_ms("15m"), duration_ms("90")) == (86_400_000, 900_000, 90)
    with pytest.raises(ValueError):
        Config(temporal_slack_ms=25 * 3_600_000)


def test_time_guard(spark):
    found = clean.time_guard(points(spark, stream([0, 1, 2, 1, 3, 4, 5, 6]) + [(2, 0, 0.0, 0.0, None)]), ["stream"], ["seq"])
    assert [r.seq for r in found.orderBy("seq").collect()] == [0, 1, 2, 4, 5, 6, 7]


def test_timeout_segments_and_alive(spark):
    rows = points(spark, stream([1, 2, 3, 4, 9, 10, 11, 12, 13, 14]))
    found = segment.timeout_segments(rows, ["stream"], ["seq"], 3).groupBy("seg").count().orderBy("seg").collect()
    assert [tuple(r) for r in found] == [(0, 4), (1, 6)]
    alive = segment.alive(points(spark, stream([1, 6, 7, 12, 16])), ["stream"], ["seq"], 3).orderBy("seq").collect()
    assert [r.is_alive for r in alive] == [True, False, True, False, False]


def test_day_runs(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate("AABBAA")], "stream long, seq long, day string")
    assert [r.run for r in clean.day_runs(rows, ["stream"], ["seq"]).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2]


def test_motion_matches_fold(spark):
    rng = random.Random(3)
    rows = []
    for key in range(30):
        t = x = 0
        for i in range(40):
            t, x = t + rng.choice([0, 500, 1000, 4000]), x + rng.choice([0.0, 0.2, 3.0])
            rows.append((key, i, float(x), 0.0, t))
    moved = motion.motion_state(motion.velocity(points(spark, rows), ["stream"], ["seq"], 3000), ["stream"], ["seq"], 2.0)
    got = {(r.stream, r.seq): (r.moving, r.motion) for r in moved.collect()}
    for key in range(30):
        own = [r for r in rows if r[0] == key]
        way = np.cumsum([0] + [abs(b[2] - a[2]) for a, b in zip(own, own[1:])])
        state = 0
        for i, r in enumerate(own):
            p = max((j for j in range(i) if own[j][4] < r[4] - 3000), default=0)
            d, dt = way[i] - way[p], r[4] - own[p][4]
            v = d / dt * 3600 if dt else (math.inf if d > 0 else 0)
            state = max(-1, min(1, state + (1 if v > 2.0 else -1)))
            assert got[key, i] == (v > 2.0, state)


def test_stop_state(spark):
    rows = points(spark, [(1, i, x, 0.0, t * 60_000) for i, (x, t) in enumerate([(0, 0), (1, 5), (2, 20), (90, 25)])]).withColumn("motion", F.lit(1))
    found = motion.stop_state(rows, ["stream"], ["seq"], 50.0, 15.0).orderBy("seq").collect()
    assert [r.stop for r in found] == [-1, 0, 1, -1]


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (None, 3)]
    root = list(range(300))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: top(i) for p in pairs if p[0] is not None and p[0] != p[1] for i in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("slack", [86_400_000.0, 86_399_999.9])
def test_clusters_match_single_linkage(spark, slack):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 400), rng.uniform(0, 400), float(rng.randrange(0, 4000))) for i in range(150)] + [(150, 5000.0, 1.0, 1.0)]
    found = cluster.cluster_endpoints(spark.createDataFrame(rows, "ep_id long, x double, y double, t double"), 30.0, slack)
    w = geo.time_weight(slack)
    label = {r[0]: r[0] for r in rows}
    near = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + w * (a[3] - b[3]) ** 2) < 30.0
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if label[a[0]] != label[b[0]] and near(a, b):
                    low, high = sorted((label[a[0]], label[b[0]]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    assert {r.ep_id: r.cluster_id for r in found.collect()} == label


def test_split_keeps_its_promises(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        start = rng.randrange(0, 60)
        rows.append((i, rng.randrange(6), rng.randrange(6), [(0, 0, start), (1, 1, start + rng.randrange(1, 25))]))
    nodes = spark.createDataFrame([(n, 1, (0.0, 1.0, 0.0, 1.0, 0.0, 90.0)) for n in range(6)], f"node_id long, weight int, bbox struct<{','.join(s + ':double' for s in bbox.SIDES)}>")
    _, found = split.make_monotone(nodes, trip(spark, rows))
    edges = [(r.src, r.dst, r.trj[0].t, r.trj[-1].t) for r in found.collect()]
    assert len(edges) == 400 and all(s != d for s, d, *_ in edges)
    order, ways = {}, {}
    for s, d, *_ in edges:
        ways.setdefault(s, set()).add(d)

    def depth(n, seen=()):
        assert n not in seen
        if n not in order:
            order[n] = 1 + max((depth(m, (*seen, n)) for m in ways.get(n, ())), default=0)
        return order[n]

    for n in list(ways):
        depth(n)
    for s, d in {(s, d) for s, d, *_ in edges}:
        own = [(a, z) for u, v, a, z in edges if (u, v) == (s, d)]
        assert max(a for a, _ in own) <= min(z for _, z in own)


def test_reference_cuts(spark):
    events = [(1.0, 1, 0, 1.0), (5.0, 2, 0, 5.0), (9.0, 1, 1, 1.0)]
    df = spark.createDataFrame([(events,)], "e array<struct<t:double,edge_id:bigint,is_end:int,start:double>>")
    assert df.select(split.reference_cuts_of(F.col("e")).alias("c")).first().c == [6.0, 8.0]


def test_morph_and_align():
    at = lambda ts: np.array([(t, 0.0, t) for t in ts], float)
    a, b = shapes.morphed(at([0, 1, 2, 4]), at([0, 3, 6]))
    assert a[:, 2].tolist() == [0, 1.25, 2.5, 5] and b[:, 2].tolist() == [0, 2.5, 5]
    a, b = shapes.aligned(at([0.5, 1, 2, 3]), at([0, 1, 2, 3]))
    assert a[:, 2].tolist() == [0.25, 0.75, 1.75, 2.75] and b[0, 2] == 0.25
    assert len(shapes.averaged(at([]), at([]))) == 0


def test_hull_and_simplify():
    xy = np.array([(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1), (0, 0)], float)
    assert shapes.hull_members(xy[:, 0], xy[:, 1]).sum() == 5
    line = np.array([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], float)
    assert shapes.simplified(line[:, 0], line[:, 1], 0.5).tolist() == [True, False, True, True, True]


def test_spike_filter(spark):
    xs = [0, 1, 2, 3, 50, 4, 5, 6, 7, 8]
    rows = points(spark, [(1, i, float(i), 300.0 if x == 50 else float(i % 2) / 10, i) for i, x in enumerate(xs)])
    kept = [r.seq for r in clean.spike_filter(rows, ["stream"], ["seq"], 5).orderBy("seq").collect()]
    assert 4 not in kept and 0 in kept and 9 in kept


def test_measures():
    a = np.array([(0, 0, 0), (10, 0, 10)], float)
    b = np.array([(0, 3, 0), (10, 3, 10)], float)
    assert shapes.dissim(a, b) == 30 and shapes.area_between(a, b) == 30
    c = np.array([(10, 0, 0), (0, 0, 10)], float)
    assert shapes.area_between(a, c) == 50
    assert shapes.dissim(a, np.array([(0, 0, 20), (1, 0, 30)], float)) == 0
    assert shapes.clipped(a, 5, 45)[:, 2].tolist() == [5, 10]


def test_medoid_and_centroid(spark):
    rows = [(1, 0, 1, [(0, 0, 0), (10, 0, 10)]), (2, 0, 1, [(0, 1, 0), (10, 1, 10)]), (3, 0, 1, [(0, 4, 0), (10, 4, 10)]), (4, 0, 1, [(0, 900, 0), (10, 900, 10)])]
    edges = trip(spark, rows)
    clusters = edge_ops.shape_clusters(edges, 50.0)
    assert {r.edge_id: r.cluster_id for r in clusters.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {(r.edge_id, r.weight) for r in edge_ops.medoids(edges, clusters).collect()} == {(2, 3), (4, 1)}
    found = {r.edge_id: r for r in edge_ops.centroids(edges, clusters, 0.5).collect()}
    assert found[1].weight == 3 and found[1].trj[0].y == pytest.approx((1 + (0 + 4) / 2) / 2)


def test_path(spark):
    at = lambda x, t: (x, 0.0, t * 60_000.0)
    own = np.array([at(0, 0), at(1, 5), at(2, 20), at(100, 21), at(200, 22), at(300, 23), at(301, 30), at(302, 45)])
    path = paths.build_path(own, np.array([-1, 0, 1, -1, -1, -1, 0, 1]), 50.0)
    assert len(path) == 3 and isinstance(path[0], paths.Box) and isinstance(path[2], paths.Box)
    assert path[0].holds(path[1][0]) and path[2].holds(path[1][-1])


def test_paths_alternate(spark):
    rng = random.Random(2)
    rows = []
    for key in range(20):
        x = t = 0.0
        for i in range(60):
            x, t = x + rng.choice([0, 1, 60]), t + rng.choice([30_000, 400_000])
            rows.append((key, i, x, 0.0, int(t)))
    df = points(spark, rows).withColumn("stop", (F.pmod(F.xxhash64("stream", "seq"), F.lit(3)) - 1).cast("int"))
    items = paths.paths(df, ["stream"], ["seq"], 100.0)
    assert items.count() and paths.path_faults(items, ["stream"]).count() == 0


def test_graph_checks(spark):
    nodes = spark.createDataFrame([(n, n == 1) for n in range(1, 6)], "node_id long, is_root boolean")
    edges = trip(spark, [(1, 1, 2, [(0, 0, 0), (1, 1, 1)]), (2, 2, 3, [(0, 0, 0), (1, 1, 1)]), (3, 3, 2, [(0, 0, 0), (1, 1, 1)])])
    assert {r.node_id for r in verify.roots(nodes, edges).collect()} == {1, 4, 5}
    assert {r.node_id for r in verify.isolated(nodes, edges).collect()} == {4, 5}
    report = {r.node_id: r.is_valid for r in verify.constraint_report(nodes, edges).collect()}
    assert report == {1: True, 2: True, 3: True, 4: False, 5: False}
    kept, left = verify.remove_nodes(nodes, edges, spark.createDataFrame([(1,)], "node_id long"))
    assert kept.count() == 4 and left.count() == 2


def test_columns(spark):
    p = lambda x, y, t: geo.point(F.lit(x), F.lit(y), F.lit(t))
    box = lambda *v: bbox.make(**{s: F.lit(float(x)) for s, x in zip(bbox.SIDES, v)})
    row = spark.range(1).select(
        geo.interpolate(F.lit(5.0), p(0, 0, 0), p(10, 20, 10)).alias("mid"), geo.triangle_area(p(0, 0, 0), p(2, 0, 0), p(0, 2, 0)).alias("area"),
        geo.line_intersection(p(0, 0, 0), p(2, 2, 0), p(0, 2, 0), p(2, 0, 0)).alias("cross"),
        geo.line_intersection(p(0, 0, 0), p(1, 1, 0), p(0, 9, 0), p(9, 0, 0)).alias("miss"), geo.clock(F.lit(3_661_000)).alias("clock"),
        geo.plain_number(F.lit(12345678.5)).alias("n"), geo.plain_number(F.lit(100.0)).alias("whole"), bbox.overlap_share(box(0, 2, 0, 2, 0, 1), box(1, 3, 0, 2, 0, 1)).alias("share"),
        bbox.overlap_share(box(0, 0, 0, 2, 0, 1), box(0, 0, 0, 2, 0, 1)).alias("flat"), bbox.contains(box(0, 2, 0, 2, 0, 1), p(2, 2, 1)).alias("corner"),
        F.size(bbox.split_at(box(0, 1, 0, 1, 0, 9), F.lit(4.0))).alias("parts"),
    ).first()
    assert (row.mid.x, row.mid.y, row.area, row.cross.x, row.miss, row.clock) == (5, 10, 2, 1, None, "01:01:01")
    assert (row.n, row.whole, row.share, row.flat, row.corner, row.parts) == ("12345678.5", "100", 0.5, 0, True, 2)


def test_merged_boxes_reach_the_fixpoint(spark, monkeypatch):
    """A tall box grows by one small box a round, for more than 20 rounds; two boxes stay apart."""

    def components(edges, a, b):  # in Python: the rounds of Spark's are tested above, and take long
        top = {}
        for r in sorted(edges.select(a, b).collect()):
            x, y = sorted((top.get(r[0], r[0]), top.get(r[1], r[1])))
            top = {k: x if v == y else v for k, v in (top | {r[0]: top.get(r[0], r[0]), r[1]: top.get(r[1], r[1])}).items()}
        return spark.createDataFrame(list(top.items()), "id long, component long").coalesce(1)

    monkeypatch.setattr(cluster, "connected_components", components)
    n = 23
    own = {0: (0.0, 10.0, 0.0, 1000.0)} | {k: (5.0 * k - 1, 5.0 * k + 9, 20.0 * k, 20.0 * k + 10) for k in range(1, n + 1)}
    own |= {100: (0.0, 10.0, 2000.0, 2010.0), 101: (6.0, 16.0, 2000.0, 2010.0)}
    rows = [(k, (*b, 0.0, 1.0)) for k, b in own.items()]
    boxes = spark.createDataFrame(rows, "node_id long, bbox struct<x1:double,x2:double,y1:double,y2:double,t1:double,t2:double>").coalesce(1)
    hulls = {(k,): b for k, b in own.items()}

    def pair():
        for a, (p1, p2, q1, q2) in hulls.items():
            for b, (r1, r2, s1, s2) in hulls.items():
                common = max(0, min(p2, r2) - max(p1, r1)) * max(0, min(q2, s2) - max(q1, s1))
                if a < b and common >= 0.5 * min((p2 - p1) * (q2 - q1), (r2 - r1) * (s2 - s1)):
                    return a, b

    while found := pair():
        x, y = (hulls.pop(c) for c in found)
        hulls[tuple(sorted(sum(found, ())))] = (min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]))
    assert sorted(len(c) for c in hulls) == [1, 1, n + 1]
    got = {r.node_id: (r.cluster_id, tuple(r.bbox)[:4]) for r in cluster.merge_boxes(boxes).collect()}
    assert got == {k: (c[0], box) for c, box in hulls.items() for k in c}
