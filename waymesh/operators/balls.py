"""Which trajectories of a large group are near, without comparing all its pairs.

The Hausdorff distance is a metric.  Trips within half a threshold of a leader
form its ball, and each is linked to the leader.  So only pairs of balls are
left, and of these the triangle inequality leaves few open: leaders nearer than
the threshold link their balls, leaders farther apart than both radii and the
threshold can't, and of the others only members go on that the other leader's
distance lets in.  Pairs of balls that are linked by way of others are not
looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bbox
from ..shared import cut, hot_join, salted_join
from .components import connected_components

#: What rounding may add to a distance, in metres and as a share; bounds give way by it.
ROUNDING_M, ROUNDING = 1e-6, 1e-9


def leaders(rows: DataFrame, distance, radius: float, *, block: int) -> DataFrame:
    """``edge_id, leader, dist``: each trip and a leader of its group nearer than ``radius`` (a leader leads itself).

    ``rows`` have grp (the group), edge_id, trj and box.  Leaders and their trips have the corners
    of their boxes in one cell.  Each round every cell has twice as many new
    leaders, spread by a hash over its open trips, and trips that one of them
    takes are done; so rounds grow with the logarithm of the balls of a cell.
    """
    corners = F.struct("grp", *(F.floor(F.col(f"box.{s}") / radius).alias(s) for s in bbox.SIDES[:4]))
    still = cut(rows.select(corners.alias("cell"), "edge_id", "trj"), "open-trips")
    found, n = [], 1
    while True:
        heads = still.groupBy("cell", F.pmod(F.xxhash64("edge_id", F.lit(n)), F.lit(n)).alias("part")).agg(F.min("edge_id").alias("leader"))
        heads = cut(heads.select("leader").join(still.select("cell", F.col("edge_id").alias("leader"), F.col("trj").alias("lead_trj")), "leader"), "leaders")
        met = salted_join(still, heads, "cell", "edge_id", block)
        near = met.select("edge_id", "leader", distance("trj", "lead_trj").alias("dist")).where(F.col("dist") < radius)
        # a leader stays its own; others go to the nearest, then to the least
        own = F.when(F.col("edge_id") == F.col("leader"), F.lit(-1.0)).otherwise(F.col("dist"))
        taken = near.groupBy("edge_id").agg(F.min(F.struct(own.alias("by"), "leader", "dist")).alias("m")).select("edge_id", "m.leader", "m.dist")
        found.append(cut(taken, "taken"))
        still = cut(still.join(found[-1].select("edge_id"), "edge_id", "left_anti").select(*still.columns), "open-trips")
        if not still.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        n *= 2


def _members(pairs: DataFrame, balls: DataFrame, side: str) -> DataFrame:
    """Members of the ball that ``side`` names, for each pair of balls: ``l1, l2, apart, edge_id, dist``."""
    own = pairs.groupBy(F.col(side).alias("leader")).agg(F.collect_list(F.struct("l1", "l2", "apart")).alias("pairs"))
    sizes = balls.groupBy("leader").agg(F.count("*").alias("n"))
    found = hot_join(balls, cut(own.join(sizes, "leader"), "pairs-of-balls"), "leader")
    return found.select("edge_id", "dist", F.explode("pairs").alias("p")).select("p.*", "edge_id", "dist")


def _unlinked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of balls whose leaders no way of ``links`` joins."""
    component = cut(connected_components(links), "components")
    of = lambda c: component.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
    known = pairs.join(of("l1"), "l1", "left").join(of("l2"), "l2", "left")
    apart = ~F.coalesce("l1_in", "l1").eqNullSafe(F.coalesce("l2_in", "l2"))
    return cut(known.where(apart).select(*pairs.columns), "open-pairs")


def near_links(rows: DataFrame, distance, threshold: float, edge_pairs, *, block: int) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of a group nearer than ``threshold``.

    ``distance(a, b)`` is a column of two trajectories' columns, ``edge_pairs`` lists
    the pairs of a group whose boxes are near.
    """
    radius = threshold / 2
    loose = lambda d: d * (1 + ROUNDING) + ROUNDING_M
    rows = cut(rows, "trips")
    balls = cut(leaders(rows, distance, radius, block=block), "balls")
    links = balls.where("edge_id <> leader").select(F.col("edge_id").alias("a"), F.col("leader").alias("b"))
    radii = cut(balls.groupBy("leader").agg(F.max("dist").alias("radius")), "radii")
    heads = rows.join(radii.select(F.col("leader").alias("edge_id")), "edge_id")
    apart = edge_pairs(heads.select("grp", "edge_id", "trj"), ["grp"], block=block, near=loose(2 * threshold)).select("a", "b", distance("trj_a", "trj_b").alias("apart"))
    apart = cut(apart.where(F.col("apart") < loose(2 * threshold)), "leader-pairs")
    links = cut(links.unionByName(apart.where(F.col("apart") < threshold).select("a", "b")), "links")

    of = lambda leader, radius: radii.select(F.col("leader").alias(leader), F.col("radius").alias(radius))
    maybe = apart.where(F.col("apart") >= threshold).select(F.col("a").alias("l1"), F.col("b").alias("l2"), "apart")
    maybe = maybe.join(of("l1", "r1"), "l1").join(of("l2", "r2"), "l2").where(F.col("apart") < loose(F.col("r1") + F.col("r2") + threshold))
    maybe = _unlinked(maybe, links)
    if not maybe.limit(1).count():
        return links

    # each member of both balls against the other's leader
    both = _members(maybe, balls, "l1").withColumn("other", F.col("l2")).unionByName(_members(maybe, balls, "l2").withColumn("other", F.col("l1")))
    asked = cut(both.where(F.col("apart") - F.col("dist") < loose(threshold + radius)).drop("apart"), "asked")
    trips = rows.select("edge_id", "trj")
    heads = trips.select(F.col("edge_id").alias("other"), F.col("trj").alias("other_trj"))
    over = salted_join(asked.join(trips, "edge_id"), heads, "other", "edge_id", block).select("l1", "l2", "edge_id", "other", "dist", distance("trj", "other_trj").alias("there"))
    over = cut(over.where(F.col("there") < loose(threshold + radius)), "asked-distances")
    links = cut(links.unionByName(over.where(F.col("there") < threshold).select(F.col("edge_id").alias("a"), F.col("other").alias("b"))), "links")
    maybe = _unlinked(maybe, links)
    if not maybe.limit(1).count():
        return links

    # what is still open: members that may have a partner, blocks of one ball against blocks of the other
    left = over.join(maybe.select("l1", "l2"), ["l1", "l2"]).withColumn("pair", F.struct("l1", "l2"))
    first, second = left.where(F.col("other") == F.col("l2")), left.where(F.col("other") == F.col("l1"))
    blocks = lambda of: F.ceil(F.count_if(F.col("other") == F.col(of)) / block).cast("int")
    sizes = left.groupBy("pair", "l1", "l2").agg(F.count("*").alias("n"), blocks("l2").alias("n1"), blocks("l1").alias("n2")).drop("l1", "l2")
    sizes = cut(sizes.where("n1 > 0 and n2 > 0"), "pair-sizes")
    own = lambda n: F.pmod(F.xxhash64("edge_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = hot_join(first, sizes, "pair").select("pair", own("n1").alias("i"), each("n2").alias("j"), F.col("edge_id").alias("a"), F.col("dist").alias("a1"), F.col("there").alias("a2"))
    y = hot_join(second, sizes, "pair").select("pair", each("n1").alias("i"), own("n2").alias("j"), F.col("edge_id").alias("b"), F.col("there").alias("b1"), F.col("dist").alias("b2"))
    bounds = (F.abs(F.col("a1") - F.col("b1")) < loose(threshold)) & (F.abs(F.col("a2") - F.col("b2")) < loose(threshold))
    met = x.join(y, ["pair", "i", "j"]).where(bounds).select("a", "b")
    named = lambda c: trips.select(F.col("edge_id").alias(c), F.col("trj").alias(f"trj_{c}"))
    near = met.join(named("a"), "a").join(named("b"), "b").where(distance("trj_a", "trj_b") < threshold).select("a", "b")
    return cut(links.unionByName(near), "links")
