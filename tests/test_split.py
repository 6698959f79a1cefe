"""Cuts and slices of busy places against a plain walk."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from waymesh.functions import bbox
from waymesh.operators import split

SCHEMA = "edge_id long, src long, dst long, weight int, trj array<struct<x:double,y:double,t:double>>"


def edges_of(spark, rows):
    return spark.createDataFrame([(i, s, d, 1, [(0.0, 0.0, float(a)), (1.0, 1.0, float(b))]) for i, s, d, a, b in rows], SCHEMA)


def walked(rows):
    """Cuts of each place by the walk over its events in order of time, edge and end."""
    events = {}
    for i, s, d, a, b in rows:
        for n in {s, d}:
            events.setdefault(n, []).extend([(a, i, 0, a), (b, i, 1, a)])
    found = {}
    for n, own in events.items():
        since, cuts = float("-inf"), []
        for t, _, end, start in sorted(own):
            if end and start >= since:
                cuts.append(t)
                since = t
        found[n] = cuts
    return found


def random_rows(seed, n, places, span, longest):
    """Half of the edges touch place 0; many last no time, many begin and end together."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(span)
        s, d = (0, rng.randrange(places)) if rng.random() < 0.5 else (rng.randrange(places), rng.randrange(places))
        rows.append((i, s, d, a, a + rng.choice([0, 0, 1, rng.randrange(longest)])))
    return rows


@pytest.mark.parametrize("seed,n,places,span,longest", [(1, 900, 5, 60, 9), (2, 600, 3, 400_000, 90_000), (3, 40, 9, 20, 30)])
def test_busy_places(spark, seed, n, places, span, longest):
    rows = random_rows(seed, n, places, span, longest)
    edges, want = edges_of(spark, rows), walked(rows)
    for row_edges in (0, 10**9):
        assert {r.node_id: r.cuts for r in split.temporal_splits(edges, row_edges=row_edges).collect()} == want
    cuts = split.cut_rows(edges, row_edges=0).cache()
    for row_cuts in (0, 10**9):
        got = {r.edge_id: (r.src_slice, r.dst_slice) for r in split.split_edges(edges, cuts, row_cuts=row_cuts).collect()}
        assert got == {i: (bisect_right(want[s], a), bisect_right(want[d], b)) for i, s, d, a, b in rows}
    nodes = spark.createDataFrame([(p, 1, (0.0, 1.0, 0.0, 1.0, -5.0, 1e6)) for p in range(places + 1)], f"node_id long, weight int, bbox struct<{','.join(s + ':double' for s in bbox.SIDES)}>")
    boxes = {(r.node_id, r.slice): (r.bbox.t1, r.bbox.t2) for r in split.split_boxes(nodes, cuts).collect()}
    expected = {}
    for p in range(places + 1):
        ends = [-5.0, *want.get(p, []), 1e6]
        expected |= {(p, k): (a, b) for k, (a, b) in enumerate(zip(ends, ends[1:]))}
    assert boxes == expected


def test_place_with_very_many_cuts(spark):
    """A chain of 30,000 edges through one place, each of which ends when the next begins: all ends are cuts."""
    rows = spark.range(30_000).select(
        F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"), (F.col("id") % 50 + 1).alias("dst"), F.lit(1).alias("weight"),
        F.expr("array(struct(0d as x, 0d as y, double(id * 1000) as t), struct(0d as x, 0d as y, double(id * 1000 + 1000) as t))").alias("trj"),
    )
    cuts = split.cut_rows(rows, row_edges=1000).cache()
    own = cuts.where("node_id = 0").agg(F.count("*").alias("n"), F.min("cut").alias("a"), F.max("cut").alias("z")).first()
    assert (own.n, own.a, own.z) == (30_000, 1000.0, 30_000_000.0)
    wrong = split.split_edges(rows, cuts, row_cuts=100).where("src_slice <> edge_id")
    assert wrong.count() == 0
