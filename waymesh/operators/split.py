"""Nodes split in time of day, so that the graph has no cycle.

A node's cuts come from a walk over the times of its edges: a cut lies where an
edge ends that began in the open slice.  Slices are half open, so a time lies in
exactly one, and its number is the count of cuts not above it.  Edges of positive
duration then lead from slice to later slice: no loops, no cycles, and parallel
edges overlap in time.

A place of few edges is folded in its row.  In a busier one every end points to
the cut that would follow it (the least end among the edges that begin at or after
it, a minimum over later times), and the cuts are what pointers reach from the
first end, found by doubling them.  Minima and counts over the times of a place
are made in chunks of ``CHUNK`` time, of which each hands on one row, so no task
holds a place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bbox
from ..shared import cut as _cut, hot_join, written

#: Edges of a place up to which its events are folded in one row, and cuts up to which they travel with an edge.
ROW_EDGES, ROW_CUTS = 5_000, 256
#: Milliseconds of a chunk: a minute holds 60,000 distinct times at most.
CHUNK = 60_000


def incident(edges: DataFrame) -> DataFrame:
    """node_id, edge_id, t1, t2 of each edge at both its ends, once for a loop."""
    own = edges.select("edge_id", "src", "dst", F.col("trj")[0]["t"].alias("t1"), F.element_at("trj", -1)["t"].alias("t2"))
    both = own.select(F.col("dst").alias("node_id"), "edge_id", "t1", "t2").unionByName(own.select(F.col("src").alias("node_id"), "edge_id", "t1", "t2"))
    return both.distinct()


def cuts_of(events: Column) -> Column:
    """Cuts of sorted events (t, edge_id, is_end, start): at the end of an edge that began in the open slice."""
    state = F.struct(F.array().cast("array<double>").alias("cuts"), F.lit(float("-inf")).alias("since"))

    def step(acc: Column, e: Column) -> Column:
        # an edge is open if it began at or after the slice's start
        hit = (e["is_end"] == 1) & (e["start"] >= acc["since"])
        return F.struct(
            F.when(hit, F.concat(acc["cuts"], F.array(e["t"]))).otherwise(acc["cuts"]).alias("cuts"),
            F.when(hit, e["t"]).otherwise(acc["since"]).alias("since"),
        )

    return F.aggregate(events, state, step)["cuts"]


def reference_cuts_of(events: Column) -> Column:
    """The pairs of cuts (last + 1, t - 1) of the scan that resets at each revisit of an edge."""
    state = F.struct(F.array().cast("array<double>").alias("cuts"), F.array().cast("array<bigint>").alias("seen"), F.lit(0.0).alias("last"))

    def step(acc: Column, e: Column) -> Column:
        again = F.array_contains(acc["seen"], e["edge_id"])
        return F.struct(
            F.when(again, F.concat(acc["cuts"], F.array(acc["last"], e["t"] - 1))).otherwise(acc["cuts"]).alias("cuts"),
            F.when(again, F.array().cast("array<bigint>")).otherwise(F.concat(acc["seen"], F.array(e["edge_id"]))).alias("seen"),
            (e["t"] + 1).alias("last"),
        )

    return F.aggregate(events, state, step)["cuts"]


def _folded(events: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    event = lambda t, end: F.struct(F.col(t).alias("t"), F.col("edge_id").cast("bigint").alias("edge_id"), F.lit(end).alias("is_end"), F.col("t1").alias("start"))
    both = events.select("node_id", F.explode(F.array(event("t1", 0), event("t2", 1))).alias("e"))
    return both.groupBy("node_id").agg(F.array_sort(F.collect_list("e")).alias("events")).select("node_id", fold(F.col("events")).alias("cuts"))


def next_cuts(events: DataFrame) -> DataFrame:
    """node_id, c, ``next``: of each end c (and of null, before all) the first end (t, edge_id, zero) later than c of an edge that begins at or after it."""
    own = F.struct(F.col("t2").alias("t"), F.col("edge_id").cast("bigint").alias("edge_id"), (F.col("t1") == F.col("t2")).alias("zero"))
    begun = events.groupBy("node_id", F.col("t1").alias("t")).agg(F.min(own).alias("all"), F.min(F.when(F.col("t2") > F.col("t1"), own)).alias("lasting"))
    ends = events.select("node_id", F.col("t2").alias("t")).distinct().withColumn("is_end", F.lit(True))
    # a row a distinct time
    times = begun.join(ends, ["node_id", "t"], "full").withColumn("chunk", F.floor(F.col("t") / CHUNK))
    times = written(times, "times")
    later = Window.partitionBy("node_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = times.groupBy("node_id", "chunk").agg(F.min("all").alias("own")).withColumn("carried", F.min("own").over(later)).drop("own")
    inside = Window.partitionBy("node_id", "chunk").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    found = times.withColumn("after", F.min("all").over(inside)).join(carried, ["node_id", "chunk"]).where("is_end")
    found = found.select("node_id", F.col("t").alias("c"), F.array_min(F.array_compact(F.array("lasting", "after", "carried"))).alias("next"))
    first = times.groupBy("node_id").agg(F.min("all").alias("next")).select("node_id", F.lit(None).cast("double").alias("c"), "next")
    return found.unionByName(first)


def pointed_cuts(events: DataFrame) -> DataFrame:
    """node_id, cut, n (how many equal cuts): what pointers reach from a place's first end; ``events`` as of ``incident``."""
    points = written(next_cuts(events), "pointers")
    jumps = points.where("c is not null and next is not null").select("node_id", "c", F.col("next.t").alias("to"))
    reached = written(points.where("c is null").select("node_id", F.col("next.t").alias("c")), "reached")
    front = reached
    while True:  # after k rounds the first 2^k cuts are known, and jumps span 2^k
        front = written(reached.join(jumps, ["node_id", "c"]).select("node_id", F.col("to").alias("c")), "front")
        if not front.limit(1).count():
            break
        reached = written(reached.union(front), "reached")
        on = jumps.select("node_id", F.col("c").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(on, ["node_id", "to"]).select("node_id", "c", F.col("beyond").alias("to")), "jumps")
    # each edge without duration cuts by itself; besides these the edge cuts that ends first
    led = points.join(reached, ["node_id", "c"], "left_semi").union(points.where("c is null")).where("next is not null")
    firsts = led.select("node_id", F.col("next.t").alias("cut"), F.col("next.zero").alias("zero"))
    zeros = events.where("t1 = t2").groupBy("node_id", F.col("t2").alias("cut")).agg(F.count("*").alias("zeros"))
    n = F.coalesce("zeros", F.lit(0)) + F.when(F.col("zero"), 0).otherwise(1)
    return firsts.join(zeros, ["node_id", "cut"], "left").select("node_id", "cut", n.alias("n"))


def cut_rows(edges: DataFrame, *, row_edges: int = ROW_EDGES) -> DataFrame:
    """node_id, cut, n of every cut; places of more than ``row_edges`` edges by pointers."""
    events = incident(edges)
    sizes = events.groupBy("node_id").agg(F.count("*").alias("n_edges"))
    many = (sizes.agg(F.max("n_edges")).first()[0] or 0) > row_edges
    busy = written(sizes.where(F.col("n_edges") > row_edges).withColumnRenamed("n_edges", "n"), "busy") if many else sizes.limit(0)
    few = _folded(events.join(busy, "node_id", "left_anti") if many else events, cuts_of)
    rows = few.select("node_id", F.explode("cuts").alias("cut")).groupBy("node_id", "cut").agg(F.count("*").alias("n"))
    return rows.unionByName(pointed_cuts(written(hot_join(events, busy, "node_id"), "busy-events"))) if many else rows


def temporal_splits(edges: DataFrame, *, reference: bool = False, row_edges: int = ROW_EDGES) -> DataFrame:
    """node_id and cuts, in rising order, of every node that has edges."""
    if reference:
        return _folded(incident(edges), reference_cuts_of)
    rows = cut_rows(edges, row_edges=row_edges)
    repeated = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cut", "n"))), lambda c: F.array_repeat(c["cut"], c["n"].cast("int"))))
    found = rows.groupBy("node_id").agg(repeated.alias("cuts"))
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct()
    return ends.join(found, "node_id", "left").select("node_id", F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"))


def slice_number(cuts: Column, t: Column) -> Column:
    return F.size(F.filter(F.coalesce(cuts, F.array().cast("array<double>")), lambda c: c <= t))


def running_cuts(cuts: DataFrame, times: DataFrame) -> DataFrame:
    """node_id, t, slice of distinct ``times`` (node_id, t): how many cuts are not above t, counted in chunks."""
    rows = cuts.select("node_id", F.col("cut").alias("t"), "n").unionByName(times.select("node_id", "t", F.lit(0).cast("long").alias("n")))
    # a row a distinct time, so that a chunk is bounded whatever the number of edges
    rows = rows.groupBy("node_id", "t").agg(F.sum("n").alias("n")).withColumn("chunk", F.floor(F.col("t") / CHUNK))
    rows = written(rows, "cut-times")
    before = Window.partitionBy("node_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("node_id", "chunk").agg(F.sum("n").alias("own")).withColumn("carried", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    upto = Window.partitionBy("node_id", "chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("inside", F.sum("n").over(upto)).join(carried, ["node_id", "chunk"])
    return found.select("node_id", "t", (F.col("inside") + F.col("carried")).cast("int").alias("slice"))


def split_boxes(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """node_id, slice, weight and bbox of every slice; ``cuts`` are rows (node_id, cut, n)."""
    at = running_cuts(cuts, cuts.select("node_id", F.col("cut").alias("t")))
    begins = cuts.join(at.withColumnRenamed("t", "cut"), ["node_id", "cut"])
    ends = nodes.select("node_id", "weight", "bbox")
    # slice k begins at cut k and ends at the next: each distinct cut closes the slice before its first and opens the one after its last
    opened = begins.select("node_id", F.col("slice"), F.col("cut").alias("a")).unionByName(ends.select("node_id", F.lit(0).alias("slice"), F.col("bbox.t1").alias("a")))
    closed = begins.select("node_id", (F.col("slice") - F.col("n")).cast("int").alias("slice"), F.col("cut").alias("b"))
    empty = begins.where("n > 1").select("node_id", F.explode(F.expr("sequence(slice - cast(n as int) + 1, slice - 1)")).alias("slice"), F.col("cut").alias("a"), F.col("cut").alias("b"))
    whole = opened.join(closed, ["node_id", "slice"], "left").unionByName(empty)
    rows = whole.join(ends, "node_id")
    b = F.coalesce("b", F.col("bbox.t2"))
    sides = {s: F.col(f"bbox.{s}") for s in bbox.SIDES[:4]}
    return rows.select("node_id", "slice", "weight", bbox.make(**sides, t1=F.least("a", b), t2=F.greatest("a", b)).alias("bbox"))


def split_edges(edges: DataFrame, cuts: DataFrame, *, row_cuts: int = ROW_CUTS) -> DataFrame:
    """Edges with the slices that they leave from and arrive in; ``cuts`` are rows (node_id, cut, n).

    Where no place has more than ``row_cuts`` cuts, these travel with the edge.
    Else slices are counted for each distinct time of a place, and edges meet them by place and time.
    """
    from_, to = F.col("trj")[0]["t"], F.element_at("trj", -1)["t"]
    most = cuts.groupBy("node_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= row_cuts:
        each = F.flatten(F.collect_list(F.array_repeat("cut", F.col("n").cast("int"))))
        arrays = cuts.groupBy("node_id").agg(each.alias("cuts"))
        at = lambda n: arrays.select(F.col("node_id").alias(n), F.col("cuts").alias(f"cuts_{n}"))
        rows = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
        rows = rows.withColumn("src_slice", slice_number(F.col("cuts_src"), from_)).withColumn("dst_slice", slice_number(F.col("cuts_dst"), to))
        return rows.drop("cuts_src", "cuts_dst")
    own = edges.withColumn("src_at", F.struct(F.col("src").alias("node_id"), from_.alias("t"))).withColumn("dst_at", F.struct(F.col("dst").alias("node_id"), to.alias("t")))
    own = written(own, "edge-times")
    asked = own.select(F.explode(F.array("src_at", "dst_at")).alias("at"))
    times = written(asked.groupBy("at").agg(F.count("*").alias("n")), "asked-times")
    found = running_cuts(cuts, times.select("at.*")).select(F.struct("node_id", "t").alias("at"), "slice")
    found = written(times.join(found, "at"), "slices")
    for side in ("src", "dst"):
        own = hot_join(own, found.select(F.col("at").alias(f"{side}_at"), F.col("slice").alias(f"{side}_slice"), "n"), f"{side}_at")
    return own.drop("src_at", "dst_at").select(*edges.columns, "src_slice", "dst_slice")


def make_monotone(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the split graph; nodes are named ``node:slice``, those without an edge are left out."""
    cuts = _cut(cut_rows(edges))
    name = lambda n, s: F.concat_ws(":", F.col(n).cast("string"), F.col(s).cast("string"))
    moved = split_edges(edges, cuts)
    moved = moved.select("edge_id", name("src", "src_slice").alias("src"), name("dst", "dst_slice").alias("dst"), "weight", "trj")
    ends = moved.select(F.col("src").alias("node")).union(moved.select(F.col("dst").alias("node")))
    used = ends.groupBy("node").agg(F.count("*").alias("slice_weight"))
    slices = split_boxes(nodes, cuts).select(name("node_id", "slice").alias("node"), F.col("node_id").alias("place"), "slice", "weight", "bbox")
    return slices.join(used, "node").withColumnRenamed("node", "node_id"), moved
