"""Single-linkage clustering as connected components of a grid join."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bbox, geo
from ..shared import HOT_ROWS, hot_join, written
from .components import connected_components


def near_pairs(points: DataFrame, threshold: float, slack_ms: float, *, id: str = "ep_id", t: str = "t") -> DataFrame:
    """Pairs i < j of points closer than ``threshold``, with their distance.

    Points meet in grid cells of the threshold's size, so the join is an equi-join
    on cells.  With a time weight the grid has a third axis.
    """
    weight = geo.time_weight(slack_ms)
    axes = [F.floor(F.col("x") / threshold), F.floor(F.col("y") / threshold)]
    if weight > 0:
        axes.append(F.floor(F.col(t) * math.sqrt(weight) / threshold))
    names = [f"c{k}" for k in range(len(axes))]
    own = points.select(F.col(id).alias("i"), "x", "y", F.col(t).alias("t"), *(a.alias(n) for a, n in zip(axes, names, strict=True)))
    # of two neighbouring cells only one looks at the other
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(axes)) if s >= (0,) * len(axes)]
    around = F.explode(F.array(*(F.struct(*((F.col(n) + d).alias(n) for n, d in zip(names, s, strict=True)), F.lit(any(s)).alias("other")) for s in steps)))
    a = own.select("i", "x", "y", "t", around.alias("c")).select("i", "x", "y", "t", "c.*")
    b = own.select(F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"), *names)
    d = geo.spatiotemporal_distance("x", "y", "t", "x2", "y2", "t2", slack_ms)
    met = a.join(b, names).where(F.col("other") | (F.col("i") < F.col("j"))).where(F.col("i") != F.col("j")).withColumn("dist", d)
    return met.where(F.col("dist") < threshold).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist")


def single_linkage(ids: DataFrame, pairs: DataFrame, id: str = "ep_id") -> DataFrame:
    """``id, cluster_id``: the least member names the cluster; points without a pair are clusters by themselves."""
    found = connected_components(pairs, "i", "j").withColumnRenamed("id", id).withColumnRenamed("component", "__c")
    return ids.select(id).join(found, id, "left").select(id, F.coalesce("__c", id).alias("cluster_id"))


#: Positions of two nodes that are compared one by one; larger nodes are parted first.  So few points are compared outright, however they lie.
DIRECT_PAIRS, FEW_POINTS = 1024, 4000


class _Grid:
    """Cells of two axes, or three with a time weight, whose diagonal lies below the threshold."""

    def __init__(self, threshold: float, weight: float):
        self.threshold, self.weight = threshold, weight
        self.axes = ["x", "y", "t"] if weight > 0 else ["x", "y"]
        # the root of the number of axes, and some
        self.side = threshold / (1.75 if weight > 0 else 1.5)

    def cell(self, level: int = 0) -> Column:
        """Of level k there are 2^k cells along a side of a first one."""
        scale = {"t": math.sqrt(self.weight)} if self.weight > 0 else {}
        at = lambda c: F.floor(F.col(c) * scale[c] / (self.side / 2**level) if c in scale else F.col(c) / (self.side / 2**level))
        return F.struct(*(at(c).alias(c) for c in self.axes))

    def parent(self, cell: str) -> Column:
        return F.struct(*(F.shiftright(F.col(f"{cell}.{c}"), 1).alias(c) for c in self.axes))

    def around(self, cell: str) -> Column:
        """The cells that may hold a point within the threshold; of two cells only one looks at the other."""
        steps = [s for s in itertools.product(range(-2, 3), repeat=len(self.axes)) if s > (0,) * len(self.axes)]
        return F.array(*(F.struct(*((F.col(f"{cell}.{c}") + d).alias(c) for c, d in zip(self.axes, s, strict=True))) for s in steps))

    def nodes(self, spots: DataFrame, cell: Column) -> DataFrame:
        """node, the top cell's least point, number of positions and box of each cell."""
        low = F.struct(*(F.min(c).alias(c) for c in self.axes)).alias("low")
        high = F.struct(*(F.max(c).alias(c) for c in self.axes)).alias("high")
        return spots.groupBy(cell.alias("node")).agg(F.min("ep").alias("ep"), F.count("*").alias("n"), low, high)

    def _norm(self, gap: Callable[[str], Column]) -> Column:
        """By the formula of the distance itself, so that a bound never contradicts it."""
        total = gap("x") * gap("x") + gap("y") * gap("y")
        return F.sqrt(total + F.lit(self.weight) * gap("t") * gap("t") if self.weight > 0 else total)

    def nearest(self) -> Column:
        """No pair of the boxes a and b is nearer."""
        return self._norm(lambda c: F.greatest(F.lit(0.0), F.col(f"b.low.{c}") - F.col(f"a.high.{c}"), F.col(f"a.low.{c}") - F.col(f"b.high.{c}")))

    def farthest(self) -> Column:
        return self._norm(lambda c: F.greatest(F.col(f"b.high.{c}") - F.col(f"a.low.{c}"), F.col(f"a.high.{c}") - F.col(f"b.low.{c}")))

    def between(self, a: str, b: str) -> Column:
        return self._norm(lambda c: F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))


def cell_links(points: DataFrame, threshold: float, weight: float, *, id: str = "ep_id", t: str = "t", direct: int = DIRECT_PAIRS) -> DataFrame:
    """``i, j``: links whose components are those of all pairs closer than ``threshold``, without listing these.

    All points of a cell belong together and are linked to its least one, so of two
    neighbouring cells only one question is left: whether any two of their points are
    near.  Their boxes may say yes (farthest corners) or no (nearest sides).  Else both
    are parted into cells of half the side, of which again only pairs that boxes leave
    open go on, until there are few positions to compare.
    """
    grid = _Grid(threshold, weight)
    own = points.select(F.col(id).alias("ep"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *([F.col(t).cast("double").alias("t")] if weight > 0 else []))
    few_points = direct == DIRECT_PAIRS and points.limit(FEW_POINTS + 1).count() <= FEW_POINTS
    keep = (lambda df, _: df) if few_points else written
    # equal positions are one point to the others
    spots = keep(own.groupBy(*grid.axes).agg(F.min("ep").alias("ep"), F.count("*").alias("n_points")).withColumn("cell", grid.cell()), "spots")
    cells = keep(grid.nodes(spots, F.col("cell")), "cells")
    counted = cells.select(F.col("node").alias("cell"), F.col("ep").alias("least"), "n")
    crowded = not few_points and (cells.agg(F.max("n")).first()[0] or 0) >= HOT_ROWS
    met = hot_join(spots.select("cell", "ep"), counted, "cell") if crowded else spots.select("cell", "ep").join(counted, "cell")
    inside = met.where("ep <> least").select(F.col("least").alias("i"), F.col("ep").alias("j"))
    repeated = own.join(spots.where("n_points > 1").select(*grid.axes, F.col("ep").alias("i")), grid.axes).where("ep <> i").select("i", F.col("ep").alias("j"))
    node = lambda df, name: df.select(F.col("node").alias(f"on_{name}"), F.struct("node", "ep", "n", "low", "high").alias(name))
    near = cells.select(F.struct("node", "ep", "n", "low", "high").alias("a"), F.explode(grid.around("node")).alias("on_b")).join(node(cells, "b"), "on_b")
    pairs = near.select(F.col("a.ep").alias("i"), F.col("b.ep").alias("j"), "a", "b")
    found, level = [inside, repeated], 0
    while True:
        judged = keep(
            pairs.where(grid.nearest() < threshold).select("i", "j", "a", "b", (grid.farthest() < threshold).alias("linked")), "cell-pairs"
        )
        linked = judged.where("linked").select("i", "j").distinct()
        found.append(linked)
        few = F.lit(True) if few_points else F.col("a.n") * F.col("b.n") <= direct
        waiting = judged.where("not linked").join(linked, ["i", "j"], "left_anti").select("i", "j", F.col("a.node").alias("a"), F.col("b.node").alias("b"), few.alias("few"))
        at = spots.withColumn("node", grid.cell(level))
        left, right = (at.select(F.col("node").alias(n), F.struct(*grid.axes).alias(f"p_{n}")) for n in "ab")
        close = waiting.where("few").join(left, "a").join(right, "b").where(grid.between("p_a", "p_b") < threshold).select("i", "j").distinct()
        if few_points or not judged.where(~F.col("linked") & ~few).limit(1).count():
            found.append(close)
            break
        close = written(close, "close")
        found.append(close)
        large = written(waiting.where("not few").join(close, ["i", "j"], "left_anti"), "large-pairs")
        level += 1
        used = large.select(F.col("a").alias("node")).union(large.select(F.col("b").alias("node"))).distinct()
        parts = written(grid.nodes(at.join(used, "node", "left_semi"), grid.cell(level)).withColumn("above", grid.parent("node")), "parts")
        child = lambda name: parts.select(F.col("above").alias(name), F.struct("node", "ep", "n", "low", "high").alias(f"{name}_part"))
        pairs = large.join(child("a"), "a").join(child("b"), "b").select("i", "j", F.col("a_part").alias("a"), F.col("b_part").alias("b"))
    return reduce(DataFrame.union, found)


def cluster_endpoints(endpoints: DataFrame, threshold: float, slack_ms: float, *, direct: int = DIRECT_PAIRS) -> DataFrame:
    """``ep_id, cluster_id`` of endpoints by spatial and temporal distance: single linkage, by ``cell_links``."""
    return single_linkage(endpoints, cell_links(endpoints, threshold, geo.time_weight(slack_ms), direct=direct))


def overlapping_boxes(boxes: DataFrame, share: float = 0.5, *, cell: float = 100.0, id: str = "node_id", box: str = "bbox") -> DataFrame:
    """Pairs i < j of boxes whose common area is at least ``share`` of the smaller one: equi-join on cells of a grid of levels.

    A box lies in cells of its own size, four at most: of level k are those of side
    ``cell`` 2^k.  It is looked up there by the boxes of its level and of those below,
    so a row a level is what a box costs, however large it or another is.
    """
    longest = F.greatest(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(longest / cell))).cast("int")
    own = boxes.select(F.col(id).alias("id"), F.col(box).alias("box")).withColumn("level", F.coalesce(level, F.lit(0)))
    levels = sorted(r.level for r in own.select("level").distinct().collect())  # some sixty at most
    span = lambda a, b, at: F.sequence(F.floor(F.col(a) / (cell * F.pow(F.lit(2.0), at))), F.floor(F.col(b) / (cell * F.pow(F.lit(2.0), at))))
    cells = lambda df: df.withColumn("cx", F.explode(span("box.x1", "box.x2", F.col("at")))).withColumn("cy", F.explode(span("box.y1", "box.y2", F.col("at"))))
    upward = own.withColumn("at", F.explode(F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda k: k >= F.col("level"))))
    a = cells(upward).select(F.col("id").alias("a_id"), F.col("box").alias("a"), "level", "at", "cx", "cy")
    b = cells(own.withColumn("at", F.col("level"))).select(F.col("id").alias("b_id"), F.col("box").alias("b"), "at", "cx", "cy")
    # a pair is looked at in the first cell that both touch, and at one level by one of them
    in_cell = lambda c, side: F.col(c) == F.floor(F.greatest(f"a.{side}", f"b.{side}") / (cell * F.pow(F.lit(2.0), F.col("at"))))
    met = a.join(b, ["at", "cx", "cy"]).where((F.col("level") < F.col("at")) | (F.col("a_id") < F.col("b_id"))).where(in_cell("cx", "x1") & in_cell("cy", "y1"))
    shared_ = met.withColumn("share", bbox.overlap_share(F.col("a"), F.col("b"))).where(F.col("share") >= share)
    return shared_.select(F.least("a_id", "b_id").alias("i"), F.greatest("a_id", "b_id").alias("j"), "share")


def merge_boxes(boxes: DataFrame, share: float = 0.5, *, cell: float = 100.0) -> DataFrame:
    """``node_id, cluster_id, bbox``: boxes that overlap are united, and united boxes again, until none overlap.

    Rounds of components over hulls: the fixpoint does not depend on an order of merging.
    A round with a pair leaves fewer clusters than it found, so the rounds end.
    Boxes of equal sides overlap wholly, so they go through the rounds as one.
    """
    own = F.struct(*(F.col(f"bbox.{s}").alias(s) for s in bbox.SIDES[:4]))
    size = bbox.area(F.col("bbox"))
    alone = F.when((share <= 1) & (size > 0) & (size < float("inf")), None).otherwise(F.col("node_id"))  # those without an area overlap with none
    named = written(boxes.select("node_id", "bbox", F.struct(own.alias("own"), alone.alias("alone")).alias("same")), "boxes")
    ends = {f"{f}{n}": g(f"bbox.{f}{n}") for f in "xyt" for n, g in ((1, F.min), (2, F.max))}
    spots = named.groupBy("same").agg(F.min("node_id").alias("spot"), bbox.make(**ends).alias("bbox"), F.count("*").alias("n"))
    spots = written(spots, "box-spots")
    boxes = spots.select(F.col("spot").alias("node_id"), "bbox")
    hulls = boxes
    members = boxes.select("node_id", F.col("node_id").alias("cluster_id"))
    while True:
        pairs = written(overlapping_boxes(hulls, share, cell=cell), "box-pairs")
        if not pairs.limit(1).count():
            break
        found = single_linkage(hulls, pairs, "node_id").withColumnRenamed("cluster_id", "to").withColumnRenamed("node_id", "cluster_id")
        members = written(members.join(found, "cluster_id").select("node_id", F.col("to").alias("cluster_id")), "box-members")
        each = boxes.join(members, "node_id").select("cluster_id", "bbox.*")
        ends = {f"{f}{n}": g(f"{f}{n}") for f in "xyt" for n, g in ((1, F.min), (2, F.max))}
        hulls = written(each.groupBy("cluster_id").agg(bbox.make(**ends).alias("bbox")).withColumnRenamed("cluster_id", "node_id"), "box-hulls")
    merged = members.join(hulls.withColumnRenamed("node_id", "cluster_id"), "cluster_id").select(F.col("node_id").alias("spot"), "cluster_id", "bbox")
    placed = written(spots.select("same", "spot", "n").join(merged, "spot").select("same", "cluster_id", "bbox", "n"), "box-places")
    return hot_join(named.select("node_id", "same"), placed, "same").select("node_id", "cluster_id", "bbox")


def minimal_boxes(members: DataFrame, edges: DataFrame, pad: float = 1.0) -> DataFrame:
    """The box of each cluster's edge ends (ends of incoming, starts of outgoing trajectories), padded; times of the cluster's box."""
    ends = edges.select(F.col("dst").alias("node_id"), F.element_at("trj", -1).alias("p")).union(edges.select(F.col("src").alias("node_id"), F.col("trj")[0].alias("p")))
    sides = {f"{c}{n}": (c, g) for c in "xy" for n, g in ((1, F.min), (2, F.max))}
    of_nodes = ends.groupBy("node_id").agg(*(g(f"p.{c}").alias(s) for s, (c, g) in sides.items()))
    known = members.select("node_id", "cluster_id").join(of_nodes, "node_id", "left")
    found = written(known.groupBy("cluster_id").agg(*(g(s).alias(s) for s, (_, g) in sides.items()), F.count("*").alias("n")), "cluster-ends")
    joined = hot_join(members.select("node_id", "cluster_id", "bbox"), found, "cluster_id")
    side = lambda s: F.coalesce(F.col(s), F.col(f"bbox.{s}"))
    own = bbox.make(x1=side("x1"), x2=side("x2"), y1=side("y1"), y2=side("y2"), t1=F.col("bbox.t1"), t2=F.col("bbox.t2"))
    return joined.select("node_id", "cluster_id", bbox.padded(own, pad).alias("bbox"))
