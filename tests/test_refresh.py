"""A graph kept up to date batch by batch equals the graph of all trips."""

import random

from pyspark.sql import functions as F

from waymesh.config import Config
from waymesh.operators import split
from waymesh.plans import graph
from waymesh.shared import cut
from waymesh.streaming import refresh

SCHEMA = "trj_id long, start struct<x:double,y:double,t:double>, end struct<x:double,y:double,t:double>, trj array<struct<x:double,y:double,t:double>>"
CONFIG = Config(clustering_threshold=30.0, max_hausdorff_meters=60.0)


def trips(seed, n):
    """Trips between six stations; the later ones fill the gap between two of them, which unites them."""
    rng, rows = random.Random(seed), []
    centres = [(0, 0), (400, 0), (800, 300), (0, 900), (1100, 900), (45, 0)]
    for i in range(n):
        (ax, ay), (bx, by) = rng.choice(centres), rng.choice(centres if i < 0.6 * n else [*centres, (22, 0)])
        t = float(rng.randrange(0, 40_000_000))
        last = t + rng.choice([0, 600_000, 1_200_000, 5_000_000])
        ends = [(ax + rng.uniform(-6, 6), ay + rng.uniform(-6, 6), t), (bx + rng.uniform(-6, 6), by + rng.uniform(-6, 6), last)]
        middle = ((ax + bx) / 2 + rng.choice([0, 0, 150]), (ay + by) / 2, (t + last) / 2)
        rows.append((1000 - i if i % 2 else 1000 + i, ends[0], ends[1], [ends[0], middle, ends[1]]))
    return rows


def rounded(nodes, edges):
    node = lambda r: (r.node_id, r.place, r.slice, r.weight, r.slice_weight, *(round(v, 6) for v in r.bbox))
    edge = lambda r: (r.edge_id, r.src, r.dst, r.weight, [tuple(round(c, 6) for c in p) for p in r.trj])
    return sorted(map(node, nodes.collect())), sorted(map(edge, edges.collect()))


def whole(spark, rows):
    nodes, edges = graph.place_graph(cut(spark.createDataFrame(rows, SCHEMA)), CONFIG)
    nodes, edges = split.make_monotone(nodes, graph.lasting(edges))
    return rounded(nodes, graph.representatives(cut(edges), CONFIG))


def test_batches_equal_the_whole(spark, tmp_path):
    rows = trips(3, 90)
    store = refresh.GraphStore(spark, f"file://{tmp_path}/graph", CONFIG)
    sizes = [40, 1, 34, 15]
    begin = 0
    for k, n in enumerate(sizes):
        own = spark.createDataFrame(rows[begin : begin + n], SCHEMA)
        assert store.apply(own, k)
        begin += n
        if k == 2:  # repeated by the stream: nothing changes
            assert not store.apply(own, k)
    got, want = rounded(*store.graph()), whole(spark, rows)
    assert got == want and begin == len(rows) and any(e[3] > 1 for e in want[1])
    named = lambda v: {r.place for r in store._read("nodes", v).select("place").distinct().collect()}
    assert len({n[1] for n in got[0]}) < len(named(store.versions()))  # places were united
    assert store._read("nodes", [1]).select("place").distinct().count() <= 2  # one trip touches two places at most


def test_failed_attempt_is_overwritten(spark, tmp_path):
    rows = trips(4, 12)
    store = refresh.GraphStore(spark, f"file://{tmp_path}/graph", CONFIG)
    store.apply(spark.createDataFrame(rows[:6], SCHEMA), 0)
    store._write("trips", 1, spark.createDataFrame(rows[3:9], SCHEMA))  # left by an attempt without commit
    store.apply(spark.createDataFrame(rows[6:], SCHEMA), 1)
    assert rounded(*store.graph()) == whole(spark, rows)


def test_trips_of_a_stream_have_names(spark):
    batch = spark.createDataFrame([(1, None, "trip", 2, [(0.0, 0.0, 1.0), (1.0, 1.0, 2.0)]), (1, None, "late", 1, [(0.0, 0.0, 0.0)])], "stream_id long, day date, kind string, n int, trj array<struct<x:double,y:double,t:double>>")
    (row,) = refresh.trips_of_batch(batch).collect()
    assert (row.start.t, row.end.t) == (1.0, 2.0) and 0 <= row.trj_id < 1 << 61
    assert refresh.trips_of_batch(batch.withColumn("stream_id", F.col("stream_id") + 1)).first().trj_id != row.trj_id
