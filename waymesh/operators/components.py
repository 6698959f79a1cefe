"""Connected components of an edge table by alternating star contractions.

Each round points every larger neighbour of a node at the node's least
neighbour (large star), then every smaller one (small star).  Rounds are joins
and grouped minima, written to the shared folder between rounds, so lineage
stays short and a lost executor costs one round at most.  A node with many
neighbours meets them by broadcast of its row, not in one task.  Nothing is
collected but a count.  A table of few links is no matter for rounds: its
components are found in one task, which reads a bounded number of ids.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..shared import cut as _cut, hot_join

#: Below so many links a node's neighbours fit a task, whatever node it is, and so do all links.
FEW_LINKS = 10_000


def _in_one_task(links: DataFrame) -> DataFrame:
    """``id, component`` of few links (u, v): each end is led to the least node by way of those before it."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches):
        least: dict = {}

        def top(n):
            while (above := least.setdefault(n, n)) != n:
                least[n] = least[above]  # halves the way
                n = above
            return n

        own = pa.null()
        for batch in batches:
            own = batch.schema.types[0]
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = sorted((top(u), top(v)))
                least[high] = low
        for i in range(0, len(least), FEW_LINKS):
            nodes = list(least)[i : i + FEW_LINKS]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, own), pa.array([top(n) for n in nodes], own)], ["id", "component"])

    ids = links.select("u", "v").coalesce(1)
    return ids.mapInArrow(run, f"id {kind}, component {kind}")


def connected_components(
    edges: DataFrame, a: str = "a", b: str = "b", *, cut: Callable[[DataFrame, str], DataFrame] = _cut, one_task: int = FEW_LINKS
) -> DataFrame:
    """``id, component`` for every node of ``edges``; the component is its least node.

    Edges with a null end and self-loops are ignored; repeated edges count once.
    ``cut`` materialises a table (by default a checkpoint).  It halves path lengths, so rounds are few, and goes on until stars are left.
    Fewer than ``one_task`` links, between numbers or texts, take no rounds.
    """
    links = cut(
        edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    if one_task and isinstance(links.schema["u"].dataType, (IntegralType, StringType)) and links.limit(one_task).count() < one_task:
        return cut(_in_one_task(links), "components")
    nodes = links.select(F.col("u").alias("id")).union(links.select(F.col("v").alias("id"))).distinct()
    few = False
    while True:
        few = few or links.count() < FEW_LINKS  # rounds don't add links
        # large star: for each node, all larger neighbours point at the least of node and neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        up = both.where("v > u")
        large = (up.join(least, "u") if few else hot_join(up, cut(least, "least"), "u", cut=cut)).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: for each node, itself and its smaller neighbours point at the least of them
        large = large if few else cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(least, "u") if few else hot_join(large, cut(least, "least"), "u", cut=cut)
        contracted = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        contracted = cut(contracted, "links")
        # stars: no node is both a centre and a leaf, and each leaf has one centre
        ends = contracted.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(contracted.select(F.col("v").alias("id"), F.lit(0).alias("up")))
        unsettled = ends.groupBy("id").agg(F.sum("up").alias("centres"), F.count("*").alias("n")).where("centres > 1 or centres > 0 and n > centres")
        links = contracted
        if not unsettled.limit(1).count():
            break
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
