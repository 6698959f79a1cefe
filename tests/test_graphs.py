"""Both graphs, from points to representatives, against plain Python over the same points."""

import math
from bisect import bisect_right
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_folds import at, built, simplified
from test_split import walked as cuts_of

from waymesh.functions import detect
from waymesh.plans import queries
from waymesh.plans.queries import CONFIG, QUERIES


@pytest.fixture(scope="module")
def segments(spark):
    """(stream, day, number) -> rows (seq, event_id, (x, y, t)) after the time guard, parted by gaps."""
    streams, found = defaultdict(list), {}
    for r in queries.event_points(spark, SF).collect():
        streams[r.stream_id, r.day].append((r.seq, r.event_id, (r.x, r.y, float(r.t_ms))))
    for key, rows in streams.items():
        kept, number = [], 0
        for row in sorted(rows):
            if kept and row[2][2] < kept[-1][2][2]:
                continue
            number += bool(kept) and row[2][2] - kept[-1][2][2] > CONFIG.connection_timeout
            kept.append(row)
            found.setdefault((*key, number), []).append(row)
    return found


def components(ids, pairs):
    """Least member of each one's component."""
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        label[high] = low
    return {i: root(i) for i in label}


def away(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1])


def hausdorff(p, q):
    return max(max(min(away(a, b) for b in y) for a in x) for x, y in ((p, q), (q, p)))


def dissimilarity(p, q):
    start, end = max(p[0][2], q[0][2]), min(p[-1][2], q[-1][2])
    if start > end:
        return 0.0
    times = sorted({start, end, *(t for *_, t in p + q if start <= t <= end)})
    gaps = [away(at(p, t), at(q, t)) for t in times]
    return sum((a + b) / 2 * (u - t) for a, b, t, u in zip(gaps, gaps[1:], times, times[1:]))


def represented(edges):
    """edge_id -> (src, dst, trip) as places; result: edge_id -> (src, dst, weight, points) of the split graph's representatives."""
    edges = {i: e for i, e in edges.items() if e[2][-1][2] > e[2][0][2]}
    cuts = cuts_of([(i, s, d, t[0][2], t[-1][2]) for i, (s, d, t) in edges.items()])
    groups = defaultdict(dict)
    for i, (s, d, t) in edges.items():
        groups[f"{s}:{bisect_right(cuts[s], t[0][2])}", f"{d}:{bisect_right(cuts[d], t[-1][2])}"][i] = t
    found = {}
    for (s, d), trips in groups.items():
        near = [(a, b) for a, b in combinations(trips, 2) if hausdorff(trips[a], trips[b]) < CONFIG.max_hausdorff_meters]
        clusters = defaultdict(list)
        for i, c in components(trips, near).items():
            clusters[c].append(i)
        for own in clusters.values():
            total = lambda i: math.floor(sum(dissimilarity(trips[i], trips[j]) for j in own if j != i) + 0.5)  # noqa: B023, E731
            best = min(own, key=lambda i: (total(i), i))  # noqa: B023
            found[best] = (s, d, len(own), len(simplified(trips[best], CONFIG.visvalingam_threshold)))
    return found


def test_movement_graph(spark, segments):
    trips = {min(e for _, e, _ in rows): [p for *_, p in rows] for rows in segments.values() if len(rows) >= CONFIG.min_points}
    ends = {2 * i + k: t[-k] for i, t in trips.items() for k in (0, 1)}
    place = components(ends, [(a, b) for a, b in combinations(ends, 2) if away(ends[a], ends[b]) < CONFIG.clustering_threshold])
    want = represented({i: (place[2 * i], place[2 * i + 1], t) for i, t in trips.items()})
    got = {r.edge_id: (r.src, r.dst, r.weight, r.n) for r in QUERIES["movement_graph"](spark, SF).collect()}
    assert got == want and len(want) > 50


def overlap(a, b):
    common = math.prod(max(0.0, min(a[1][c], b[1][c]) - max(a[0][c], b[0][c])) for c in (0, 1))
    smaller = min(math.prod(x[1][c] - x[0][c] for c in (0, 1)) for x in (a, b))
    return common / smaller if smaller > 0 else 0.0


def test_path_movement_graph(spark, segments):
    stops, routes = {}, {}
    for key, rows in segments.items():
        x, y, t = np.array([p for *_, p in rows]).T
        motion = detect.motion_states(detect.velocities(x, y, t, CONFIG.motion_detector_timespan), CONFIG.minimum_velocity + CONFIG.epsilon_velocity)
        states = detect.stop_states(x, y, t, motion, CONFIG.bbox_max_meters, CONFIG.bbox_min_minutes)
        path = built([p for *_, p in rows], states.tolist(), CONFIG.bbox_max_meters)
        for pos, item in enumerate(path if len(path) > 1 else []):
            (routes if pos % 2 else stops)[(*key, pos)] = item
    assert len(routes) > 5
    keys = [*stops, *routes]
    schema = "stream_id long, day date, seg long, pos int"
    named = spark.createDataFrame(keys, schema).select("*", F.xxhash64("stream_id", "day", "seg", "pos").alias("h")).collect()
    name = {(r.stream_id, r.day, r.seg, r.pos): r.h for r in named}
    boxes = {name[k]: b for k, b in stops.items()}
    place, hulls = {i: i for i in boxes}, dict(boxes)
    while pairs := [(a, b) for a, b in combinations(hulls, 2) if overlap(hulls[a], hulls[b]) >= 0.5]:
        to = components(hulls, pairs)
        place = {i: to[c] for i, c in place.items()}
        own = defaultdict(list)
        for i, c in place.items():
            own[c].append(boxes[i])
        hulls = {c: ([min(b[0][k] for b in bs) for k in range(3)], [max(b[1][k] for b in bs) for k in range(3)]) for c, bs in own.items()}
    assert len(hulls) < len(boxes)
    edges = {name[k]: (place[name[(*k[:3], k[3] - 1)]], place[name[(*k[:3], k[3] + 1)]], r) for k, r in routes.items()}
    want = represented(edges)
    got = {r.edge_id: (r.src, r.dst, r.weight, r.n) for r in QUERIES["path_movement_graph"](spark, SF).collect()}
    assert got == want and want
