"""Checks on a graph: roots, idle nodes, order in time, and what can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut

#: Ways of a graph up to which chains are followed step by step.
FEW_WAYS = 2000


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to (loops aside)."""
    return nodes.join(edges.where("src <> dst").select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(_ends(edges), "node_id", "left_anti")


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge."""
    return nodes.join(_ends(edges), "node_id", "left_semi")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))


def loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def monotonicity_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that start at or after the first time of the node that they lead to."""
    to = nodes.select(F.col("node_id").alias("dst"), F.col("bbox.t1").alias("opens"))
    return edges.join(to, "dst").where(F.col("trj")[0]["t"] >= F.col("opens")).select("edge_id", "src", "dst", F.col("trj")[0]["t"].alias("starts"), "opens")


def reachable(edges: DataFrame, start: DataFrame, *, few: int = FEW_WAYS) -> DataFrame:
    """``node_id, steps`` of every node that can be reached from those of ``start``, with the fewest steps.

    In a graph of more than ``few`` ways chains are contracted first: a node with one
    way in and one way out points back to the one before it, and doubled pointers
    lead to the head of its chain.  Rounds then follow junctions alone, each a join of
    what the last one has improved; nodes in chains count on from their heads.
    """
    ways = cut(edges.select("src", "dst").where("src <> dst").distinct())
    first = cut(start.select("node_id").distinct().withColumn("steps", F.lit(0).cast("long")))
    if ways.limit(few + 1).count() <= few:
        return _relaxed(ways.withColumn("len", F.lit(1).cast("long")), first).withColumn("steps", F.col("steps").cast("int"))
    ends = ways.select(F.col("src").alias("node_id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(ways.select("dst", F.lit(0), F.lit(1)))
    single = ends.groupBy("node_id").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out = 1 and into = 1").select("node_id")
    inner = cut(single.join(first, "node_id", "left_anti"))
    back = cut(ways.join(inner.withColumnRenamed("node_id", "dst"), "dst").select(F.col("dst").alias("node_id"), F.col("src").alias("head"), F.lit(1).cast("long").alias("dist")))
    rounds = max(1, inner.count()).bit_length()  # a ring of such nodes has no head
    beyond = lambda df: df.select(F.col("node_id").alias("head"), F.col("head").alias("head2"), F.col("dist").alias("dist2"))
    for _ in range(rounds):
        open_ = back.join(inner.withColumnRenamed("node_id", "head"), "head", "left_semi")
        if not open_.limit(1).count():
            break
        joined = back.join(beyond(back), "head", "left")
        back = cut(joined.select("node_id", F.coalesce("head2", "head").alias("head"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist")))
    tails = ways.join(inner.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    via = tails.join(back.withColumnRenamed("node_id", "src"), "src", "left")
    short = via.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("dist", F.lit(0)) + 1).alias("len"))
    found = _relaxed(cut(short.groupBy("src", "dst").agg(F.min("len").alias("len"))), first)
    inside = back.join(found.withColumnRenamed("node_id", "head"), "head").select("node_id", (F.col("dist") + F.col("steps")).alias("steps"))
    return found.union(inside).withColumn("steps", F.col("steps").cast("int"))


def _relaxed(ways: DataFrame, front: DataFrame) -> DataFrame:
    """Fewest steps from ``front`` (node_id, steps) over ways (src, dst, len)."""
    best = front
    while front.limit(1).count():
        new = ways.join(front, ways["src"] == front["node_id"]).groupBy(F.col("dst").alias("node_id")).agg(F.min(F.col("len") + F.col("steps")).alias("new"))
        better = new.join(best, "node_id", "left").where("steps is null or new < steps")
        front = cut(better.select("node_id", F.col("new").alias("steps")))
        best = cut(best.union(front).groupBy("node_id").agg(F.min("steps").alias("steps")))
    return best


def reachable_in_time(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node_id, opens`` of the nodes that ``start`` reaches by ways none of whose nodes begins after the node itself has ended.

    ``opens`` is the latest beginning on the way where that is earliest; roots are always reached.
    Each round improves what the last one has changed, so it ends when nothing changes.
    """
    own = nodes.select("node_id", F.col("bbox.t1").alias("t1"), F.col("bbox.t2").alias("t2"))
    ways = edges.select("src", "dst").where("src <> dst").distinct()
    ways = cut(ways.join(own.select(F.col("node_id").alias("dst"), "t1"), "dst").select("src", "dst", "t1"))
    low = F.lit(float("-inf"))
    front = cut(start.select("node_id").distinct().join(own, "node_id").select("node_id", low.alias("opens")))
    best = front
    while front.limit(1).count():
        new = ways.join(front, ways["src"] == front["node_id"]).groupBy(F.col("dst").alias("node_id")).agg(F.min(F.greatest("opens", "t1")).alias("new"))
        better = new.join(best, "node_id", "left").where("opens is null or new < opens")
        front = cut(better.select("node_id", F.col("new").alias("opens")))
        best = cut(best.unionByName(front).groupBy("node_id").agg(F.min("opens").alias("opens")))
    return best.join(own, "node_id").where("opens <= t2").select("node_id", "opens")


def constraint_report(nodes: DataFrame, edges: DataFrame, *, in_time: bool = False) -> DataFrame:
    """``node_id, is_root, is_orphan, is_reachable, is_valid``: roots (nodes marked is_root) are those without incoming edges, and reach all.

    ``in_time`` takes only ways that a node can lie on by its times (``reachable_in_time``).
    """
    incoming = edges.where("src <> dst").select(F.col("dst").alias("node_id")).distinct().withColumn("has_incoming", F.lit(True))
    first = nodes.where("is_root")
    found = reachable_in_time(nodes, edges, first) if in_time else reachable(edges, first)
    found = found.select("node_id", F.lit(True).alias("is_reachable"))
    rows = nodes.join(incoming, "node_id", "left").join(found, "node_id", "left")
    rows = rows.select("node_id", "is_root", F.col("has_incoming").isNull().alias("is_orphan"), F.coalesce("is_reachable", F.lit(False)).alias("is_reachable"))
    return rows.withColumn("is_valid", (F.col("is_root") == F.col("is_orphan")) & F.col("is_reachable"))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some nodes and their edges; roots are found anew."""
    kept = nodes.join(gone.select("node_id"), "node_id", "left_anti")
    ids = kept.select("node_id")
    left = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    first = roots(kept, left).select("node_id", F.lit(True).alias("is_root"))
    return kept.drop("is_root").join(first, "node_id", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False))), left
