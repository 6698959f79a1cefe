"""The queries that fold over a stream or a trajectory, against plain Python over the same rows."""

import random
from bisect import bisect_right
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from conftest import SF

from waymesh.functions import shapes
from waymesh.operators import clean, edges as edge_ops, paths
from waymesh.plans import graph, queries
from waymesh.plans.queries import CONFIG, KEYS, ORDER, QUERIES


def cross(o, a, b):
    o, a, b = (tuple(map(Fraction, p)) for p in (o, a, b))
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def corner(p, points):
    """Whether p is no mixture of the other positions: in none of their segments and triangles."""
    others = sorted(set(points) - {p})
    for a, b in combinations(others, 2):
        if cross(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
            return False
    for t in combinations(others, 3):
        turns = [cross(t[k], t[(k + 1) % 3], p) for k in range(3)]
        if cross(*t) != 0 and (all(x >= 0 for x in turns) or all(x <= 0 for x in turns)):
            return False
    return True


def gap(p, q):
    return ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5


def test_ch_filtered(spark):
    streams = defaultdict(list)
    for r in queries._clean(spark, SF).collect():
        streams[r.stream_id, r.day].append((r.seq, r.event_id, (r.x, r.y)))
    want = set()
    for rows in streams.values():
        window = []
        for _, event, p in sorted(rows):
            window.append((event, p))
            hull = [q for _, q in window if corner(q, [w for _, w in window])]
            spikes = [q for o, q, r in zip(hull, hull[1:], hull[2:]) if gap(o, q) > gap(o, r) or gap(q, r) > gap(o, r)]
            left = []
            for e, q in window:
                if spikes and q == spikes[0]:
                    del spikes[0]
                else:
                    left.append((e, q))
            window = left
            if len(window) == CONFIG.window_size:
                want.add(window.pop(0)[0])
        want |= {e for e, _ in window}
    got = [r.event_id for r in QUERIES["ch_filtered"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < sum(map(len, streams.values()))


SPIKY = "stream string, seq long, x double, y double, note string"


def spiky(seed, n):
    """A long stream, one of a single row and one without a name, whose points jump; equal positions among them."""
    rng = random.Random(seed)
    rows = []
    for stream, many in (("long", n), ("one", 1), (None, n // 3)):
        x = y = 0.0
        for i in range(many):
            x, y = x + rng.choice([0.0, 1.0, 2.0, -0.5]), y + rng.choice([0.0, 0.5, -0.5])
            far = rng.random() < 0.15
            rows.append((stream, 3 * i, x + 90 * far, y - 70 * far * rng.random(), None if i % 4 else "n"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,chunk,size", [(1, 7, 5), (2, 40, 9)])
def test_spike_filter_in_chunks(spark, seed, chunk, size):
    frame = spark.createDataFrame(spiky(seed, 260), SPIKY)
    whole = clean.spike_filter(frame, ["stream"], ["seq"], size).collect()
    parts = clean.spike_filter(frame, ["stream"], ["seq"], size, chunk_rows=chunk)
    assert parts.columns == frame.columns
    by = lambda rows: sorted(map(str, rows))
    assert by(parts.collect()) == by(whole) and len(whole) < frame.count() - 20


def test_centroids_of_many_small_batches(spark):
    """Clusters that run over several Arrow batches equal a fold of the whole cluster."""
    rng = random.Random(3)
    rows = [(i, None if i % 9 == 0 else "a", "b", 1 + i % 2, [(float(x), rng.uniform(0, 5), float(x + rng.uniform(0, 0.5))) for x in range(6)]) for i in range(90)]
    edges = spark.createDataFrame(rows, "edge_id long, src string, dst string, weight int, trj array<struct<x:double,y:double,t:double>>")
    clusters = edges.selectExpr("edge_id", "edge_id % 3 as cluster_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.src, r.edge_id): r for r in edge_ops.centroids(edges, clusters, 0.1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], r[0] % 3].append(r)
    assert got.keys() == {(k[0], own[0][0]) for k, own in groups.items()}
    for (src, _), own in groups.items():
        trips = [shapes.strictly_later(np.array(r[4])) for r in own]
        mean = trips[-1]
        for other in trips[:-1]:
            mean = shapes.merged(other, mean, 0.1)
        row = got[src, own[0][0]]
        assert row.weight == sum(r[3] for r in own) and np.array_equal(np.array([tuple(p) for p in row.trj]), mean)
    assert edge_ops.centroids(edges.limit(0), clusters, 0.1).count() == 0


def area(a, b, c):
    return abs((a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1])) / 2)


def simplified(points, threshold):
    points = list(points)
    while len(points) > 2:
        size, k = min((area(*points[k - 1 : k + 2]), k) for k in range(1, len(points) - 1))
        if size > threshold:
            break
        del points[k]
    return points


@pytest.fixture(scope="module")
def trips(spark):
    return {r.edge_id: (r.src, r.dst, [tuple(p) for p in r.trj]) for r in queries._places(spark, SF)[1].collect()}


def test_simplified_edges(spark, trips):
    edges = queries._places(spark, SF)[1]
    for threshold in (10_000.0, 2e7):
        got = {r.edge_id: [tuple(p) for p in r.trj] for r in edge_ops.simplify(edges, threshold).collect()}
        assert got == {i: simplified(t, threshold) for i, (_, _, t) in trips.items()}
    assert any(len(t) < len(trips[i][2]) for i, t in got.items())
    assert {r.edge_id: r.n for r in QUERIES["simplified_edges"](spark, SF).collect()} == {i: len(simplified(t, 10_000.0)) for i, (_, _, t) in trips.items()}


def later(points):
    out = points[:1]
    for p in points[1:]:
        if p[2] > out[-1][2]:
            out.append(p)
    return out


def at(points, t):
    k = min(bisect_right([p[2] for p in points], t), len(points) - 1)
    p, q = points[max(k - 1, 0)], points[k]
    if t >= q[2] or p[2] == q[2]:
        return q[:2]
    share = (t - p[2]) / (q[2] - p[2])
    return tuple(p[c] + (q[c] - p[c]) * share for c in (0, 1))


def half_way(a, b):
    start, spans = (a[0][2] + b[0][2]) / 2, [x[-1][2] - x[0][2] for x in (a, b)]
    mean = sum(spans) / 2
    a, b = ([(x, y, start + (t - p[0][2]) * (mean / s)) for x, y, t in p[:-1]] + [(*p[-1][:2], start + mean)] for p, s in zip((a, b), spans))
    times = sorted({p[2] for p in a + b})
    both = [(at(a, t), at(b, t), t) for t in times]
    return simplified(later([((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, t) for p, q, t in both]), CONFIG.visvalingam_threshold)


def test_centroid_edges(spark, trips):
    clusters = defaultdict(list)
    for r in QUERIES["shape_clusters"](spark, SF).collect():
        clusters[r.cluster_id].append(r.edge_id)
    want = {}
    for ids in clusters.values():
        own = [later(trips[i][2]) for i in sorted(ids)]
        mean = own[-1]
        for other in own[:-1]:
            mean = half_way(other, mean) if len(mean) > 1 and len(other) > 1 else mean
        want[min(ids)] = (len(ids), mean)
    edges = queries._places(spark, SF)[1]
    rows = edge_ops.centroids(edges, edge_ops.shape_clusters(edges, CONFIG.max_hausdorff_meters), CONFIG.visvalingam_threshold).collect()
    assert {r.edge_id: r.weight for r in rows} == {i: n for i, (n, _) in want.items()} and max(n for n, _ in want.values()) > 1
    for r in rows:
        assert [c for p in r.trj for c in p] == pytest.approx([c for p in want[r.edge_id][1] for c in p], abs=1e-3)


def boxed(points):
    return [min(p[c] for p in points) for c in range(3)], [max(p[c] for p in points) for c in range(3)]


def joined(*boxes):
    return boxed([p for b in boxes for p in b])


def side(box):
    return max(box[1][c] - box[0][c] for c in (0, 1))


def walked(points, states, meters):
    """The table of transitions, row by row: ``trj`` gets every point first; kinds that repeat are joined at the end."""
    items, box, trj, initial = [], boxed(points[:1]), points[:1], True
    for p, state in zip(points[1:], states[1:]):
        trj = trj + [p]
        wider = joined(box, boxed([p])) if box else None
        if initial:  # grow, or push the stop without p
            if side(wider) < meters:
                box = wider
            else:
                items.append(box)
                box, initial = None, False
        elif state == 0:  # maybe
            if box and side(wider) < meters:
                box = wider
            elif box:  # route without p, then the stop; p begins what follows
                items += [trj[:-1], box]
                trj, box = [p], None
        elif state == 1:  # yes
            if box and side(wider) < meters:
                box = wider
            elif box:  # an error in the table; taken like maybe
                items += [trj[:-1], box]
                trj, box = [p], None
            else:
                items.append(trj)
                box, trj = boxed([p]), [p]
        else:  # no
            if box:
                items.append(box)
            box = None
    if not items:
        return [box] if len(points) > 5 else []
    if isinstance(items[-1], list):
        if all(box[0][c] <= p[c] <= box[1][c] for p in (items[-1][0], items[-1][-1]) for c in range(3)):
            items.pop()
        else:
            items.append(box)
    else:
        items += [trj, box or boxed(points[-1:])]
    out = []
    for item in items:
        if out and isinstance(out[-1], list) and isinstance(item, list):
            out[-1] = out[-1] + (item[1:] if item[0] == out[-1][-1] else item)
        elif out and not isinstance(out[-1], list) and not isinstance(item, list):
            out[-1] = joined(out[-1], item)
        else:
            out.append(item)
    return out


def grown(path, k, meters):
    box = path[k]
    heads = [path[k - 1][::-1] if k else [], path[k + 1] if k + 1 < len(path) else []]
    since = path[k - 2][1][2] if k else float("-inf")
    until = path[k + 2][0][2] if k + 2 < len(path) else float("inf")
    while True:
        tries = [(side(b), n, b) for n, h in enumerate(heads) if h and since < h[0][2] < until and side(b := joined(box, boxed(h[:1]))) < meters]
        if not tries:
            break
        _, n, box = min(tries, key=lambda x: x[:2])
        heads[n] = heads[n][1:]
    low, high = list(box[0]), list(box[1])
    for c in (0, 1):
        more = max(0, 10.0 - (high[c] - low[c])) / 2
        low[c], high[c] = low[c] - more, high[c] + more
    return low, high


def built(points, states, meters, removed=None):
    """``removed`` counts removals of stops, and of routes."""
    removed = [0, 0] if removed is None else removed
    path = walked(points, states, meters)
    if len(path) > 1:
        path = [grown(path, k, meters) if k % 2 == 0 else item for k, item in enumerate(path)]
        k = 0
        while k + 2 < len(path):  # of two stops in a row that last no time the first goes, with the way between
            if all(path[j][0][2] == path[j][1][2] for j in (k, k + 2)):
                del path[k : k + 2]
                removed[0] += 1
            else:
                k += 2
        for k in range(len(path) - 3, -1, -2):
            whole = joined(path[k], boxed(path[k + 1]))
            if side(whole) < meters:
                path[k : k + 3] = [whole]
                removed[1] += 1
    return path


def test_build_path_on_random_walks():
    rng, lengths, total = random.Random(4), set(), [0, 0]
    for _ in range(400):
        x = y = t = 0.0
        points, states = [], []
        for _ in range(rng.randrange(2, 60)):
            x, y, t = x + rng.choice([0, 0, 1, 7, 60]), y + rng.choice([0, 0, 2, 40]), t + rng.choice([0, 1000, 60_000])
            points.append((x, y, t))
            states.append(rng.choice([-1, -1, 0, 0, 1]))
        removed = [0, 0]
        want = built(points, states, 100.0, removed)
        got, *counts = paths.counted_path(np.array(points), np.array(states), 100.0)
        assert counts == removed
        total = [a + b for a, b in zip(total, removed)]
        assert len(got) == len(want)
        lengths.add(len(got))
        for a, b in zip(got, want):
            if isinstance(b, list):
                assert [tuple(p) for p in a.tolist()] == b
            else:
                assert [*a.low, *a.high] == pytest.approx([*b[0], *b[1]])
    assert max(lengths) > 8 and min(total) > 5


def test_paths(spark):
    meters, sf = CONFIG.bbox_max_meters, SF.replace("0.001", "0.01")
    segments = defaultdict(list)
    for r in graph.stop_points(queries.event_points(spark, sf), KEYS, ORDER, CONFIG).collect():
        segments[r.stream_id, r.day, r.seg].append((r.seq, (r.x, r.y, float(r.t_ms)), r.stop))
    want, removed = {}, [0, 0]
    for key, rows in segments.items():
        rows.sort()
        path = built([p for _, p, _ in rows], [s for *_, s in rows], meters, removed)
        if len(path) > 1:
            want |= {(*key, k): item for k, item in enumerate(path)}
    rows = QUERIES["paths"](spark, sf).collect()
    got = {(r.stream_id, r.day, r.seg, r.pos): r for r in rows}
    assert len(rows) == len(got) and set(got) == set(want) and len({k for *_, k in want}) > 3
    for key, item in want.items():
        r = got[key]
        if isinstance(item, list):
            assert (r.kind, r.n) == ("route", len(item))
        else:
            assert r.kind == "stop" and [r.x1, r.y1, r.t1, r.x2, r.y2, r.t2] == pytest.approx([*item[0], *item[1]], abs=1e-2)
    c = QUERIES["path_counters"](spark, sf).first()
    assert (c.segments, c.points, c.paths) == (len(segments), sum(map(len, segments.values())), len({k[:3] for k in want}))
    assert (c.stops, c.routes) == tuple(sum(r.kind == kind for r in rows) for kind in ("stop", "route"))
    assert [c.redundant_node_removals, c.redundant_trj_removals] == removed
    none = graph.path_counters(queries.event_points(spark, SF).limit(0), KEYS, ORDER, CONFIG).first()
    assert none.segments == none.stops == none.redundant_trj_removals == 0
