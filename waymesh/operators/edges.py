"""Groups of parallel edges: distances, clusters by shape, and one representative each."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bbox, shapes
from ..shared import bounded_batches, cut, hot_join, spread, written
from . import balls
from .components import connected_components

GROUP = ["src", "dst"]

#: Edges of a block, as so many points count as one edge more: two blocks of a group meet in a task, so these bound the pairs and points that stay together.
PAIR_BLOCK, EDGE_POINTS = 64, 2000


def edge_groups(edges: DataFrame) -> DataFrame:
    """How many edges lead from each source to each target."""
    return edges.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def _array(points) -> np.ndarray:
    return np.array([(p["x"], p["y"], p["t"]) for p in points], float).reshape(-1, 3)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trajectories of an Arrow column as rows x, y, t of one array, and where each begins."""
    points = column.flatten()
    offsets = np.asarray(column.offsets, np.int64)
    return np.stack([np.asarray(points.field(c), float) for c in range(3)], axis=1), offsets - offsets[0]


def edge_pairs(edges: DataFrame, group: list[str] = GROUP, *, block: int = PAIR_BLOCK, near: float | None = None) -> DataFrame:
    """Pairs a < b of edges of one group, with trj_a and trj_b (in either order): equi-join on the group.

    Groups of more than ``block`` edges are dealt into blocks, each two of which
    meet under a key of their own, so no task has a whole large group.  Work on a
    pair grows with the lengths of both, not with the bytes that are read, so keys
    are dealt over all cores.  ``near``
    drops pairs before their points are looked at, by a side of their boxes that
    differs by as much: no such pair has a Hausdorff distance below it.
    Batches of pairs that go to Python are bounded by bytes, as trips are of any length.
    """
    bounded_batches(edges.sparkSession)
    box = bbox.of_array(F.col("trj"))
    rows = edges.select(F.struct(*group).alias("g"), *group, "edge_id", "trj", *([box.alias("box")] if near is not None else []))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("trj"), F.lit(0))).alias("points"))
    blocks = F.least("n", F.ceil((F.col("n") + F.floor(F.col("points") / EDGE_POINTS)) / block)).cast("int")
    sizes = written(sizes.select("g", "n", blocks.alias("blocks")), "group-sizes")
    if (sizes.agg(F.max("blocks")).first()[0] or 0) <= 1:
        dealt = rows.withColumn("own", F.lit(0)).withColumn("first", F.lit(0)).withColumn("second", F.lit(0))
    else:
        dealt = hot_join(rows, sizes, "g", keep_n=True)
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("edge_id"), "blocks").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("first", F.least("own", "met")).withColumn("second", F.greatest("own", "met"))
    side = lambda c, own: dealt.where(F.col("own") == F.col(own)).select(
        *group, "first", "second", F.col("edge_id").alias(c), F.col("trj").alias(f"trj_{c}"), *([F.col("box").alias(f"box_{c}")] if near is not None else [])
    )
    keys = [*group, "first", "second"]
    met = spread(side("a", "first"), *keys).join(spread(side("b", "second"), *keys), keys).where("first < second or a < b")
    if near is not None:
        for s in bbox.SIDES[:4]:
            met = met.where(F.abs(F.col(f"box_a.{s}") - F.col(f"box_b.{s}")) < near)
    return met.select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "trj_a", "trj_b")


def _pair_measure(measure) -> Column:
    """A measure of two arrays (rows x, y, t) that doesn't depend on their order, as a column function."""

    @F.arrow_udf("double")
    def over(a: pa.Array, b: pa.Array) -> pa.Array:
        (p, at), (q, bt) = _flat(a), _flat(b)
        return pa.array([measure(p[i:j], q[k:m]) for i, j, k, m in zip(at[:-1], at[1:], bt[:-1], bt[1:], strict=True)], pa.float64())

    return over


def hausdorff(a: Column, b: Column) -> Column:
    """Symmetric discrete Hausdorff distance in the plane."""
    return _pair_measure(shapes.hausdorff)(a, b)


def hausdorff_pairs(edges: DataFrame) -> DataFrame:
    return edge_pairs(edges).select(*GROUP, "a", "b", hausdorff("trj_a", "trj_b").alias("dist"))


def dissim_pairs(edges: DataFrame) -> DataFrame:
    """Integral of the distance of each pair over its common time span."""
    return edge_pairs(edges).select(*GROUP, "a", "b", _pair_measure(shapes.dissim)("trj_a", "trj_b").alias("dissim"))


def area_pairs(edges: DataFrame) -> DataFrame:
    """Area between the curves of each pair, in (x, t) and (y, t)."""
    return edge_pairs(edges).select(*GROUP, "a", "b", _pair_measure(shapes.area_between)("trj_a", "trj_b").alias("area"))


def equal_trips(rows: DataFrame, keys: list[str], columns: str) -> tuple[DataFrame, DataFrame]:
    """Trips of equal ``keys`` and equal ``columns`` (of x, y, t) of all points, found by SHA-256: ``edge_id, same`` of each, and ``same, spot, n`` (their least id and number).

    A trip that has no points, or any that is not finite, is equal to none.
    """
    sound = (F.size("trj") > 0) & F.forall("trj", lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")) & (F.abs(p["t"]) < float("inf")), F.lit(False)))
    shape = F.sha2(F.to_json(F.transform("trj", lambda p: F.struct(*(p[c].alias(c) for c in columns)))), 256)
    key = F.struct(*keys, F.when(sound, shape).alias("shape"), F.when(~F.coalesce(sound, F.lit(False)), F.col("edge_id")).alias("alone"))
    named = written(rows.select("edge_id", key.alias("same")), "trip-shapes")
    return named, written(named.groupBy("same").agg(F.min("edge_id").alias("spot"), F.count("*").alias("n")), "trip-spots")


def shape_clusters(edges: DataFrame, max_meters: float, *, block: int = 512) -> DataFrame:
    """``edge_id, cluster_id``: components of edges of one group closer than ``max_meters``.

    Edges with the same points are one to the others.  Pairs are compared in
    groups of up to ``block`` edges; larger ones are covered by balls
    (``balls.near_links``), with the same components.
    """
    every = edges.select(F.struct(*GROUP).alias("grp"), *GROUP, "edge_id", "trj").dropna(subset=GROUP)
    named, spots = equal_trips(every, ["grp"] if max_meters > 0 else ["grp", "edge_id"], "xy")
    rows = cut(every.join(spots.select(F.col("spot").alias("edge_id")), "edge_id"), "trip-heads")
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("n")), "group-sizes")
    some_large = bool(sizes.where(F.col("n") > block).limit(1).count())
    sized = hot_join(rows, sizes, "grp", keep_n=True) if some_large else rows
    small = sized.where(F.col("n") <= block) if some_large else rows
    pairs = edge_pairs(small.select(*GROUP, "edge_id", "trj"), block=min(block, PAIR_BLOCK), near=max_meters)
    links = pairs.select("a", "b", hausdorff("trj_a", "trj_b").alias("dist")).where(F.col("dist") < max_meters).select("a", "b")
    if some_large:
        large = sized.where(F.col("n") > block).select("grp", "edge_id", "trj", bbox.of_array(F.col("trj")).alias("box"))
        links = links.unionByName(balls.near_links(large, hausdorff, max_meters, edge_pairs, block=min(block, PAIR_BLOCK)))
    found = connected_components(links).withColumnRenamed("id", "spot")
    placed = spots.join(found, "spot", "left").select("same", F.coalesce("component", "spot").alias("cluster_id"), "n")
    members = hot_join(named, written(placed, "trip-places"), "same").select("edge_id", "cluster_id")
    return edges.select("edge_id").join(members, "edge_id", "left").select("edge_id", F.coalesce("cluster_id", "edge_id").alias("cluster_id"))


def medoids(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """The edge of least total dissimilarity in each cluster, with the cluster's size as weight; ties: the least id.

    Totals are compared as whole metre milliseconds, so the order in which they are summed up decides nothing.
    Equal edges have one total, in which an edge counts as often as it is there.
    """
    own = edges.join(clusters, "edge_id").select("edge_id", *GROUP, "cluster_id", "trj")
    _, spots = equal_trips(own, [*GROUP, "cluster_id"], "xyt")
    times = spots.select(F.col("spot").alias("edge_id"), "n")
    heads = cut(own.join(times, "edge_id"), "trip-heads")
    pairs = edge_pairs(heads, [*GROUP, "cluster_id"])
    d = pairs.select("a", "b", _pair_measure(shapes.dissim)("trj_a", "trj_b").alias("d"))
    both = F.array(F.struct(F.col("a").alias("edge_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("edge_id"), F.col("a").alias("other")))
    each = d.select(F.explode(both).alias("e"), "d").select("e.*", "d").join(times.withColumnRenamed("edge_id", "other"), "other")
    total = each.groupBy("edge_id").agg(F.sum(F.col("d") * F.col("n")).alias("total"))
    ranked = heads.drop("trj").join(total, "edge_id", "left").withColumn("total", F.round(F.coalesce("total", F.lit(0.0))))
    best = ranked.groupBy(*GROUP, "cluster_id").agg(F.min(F.struct("total", "edge_id")).alias("m"), F.sum("n").alias("weight"))
    return best.select(F.col("m.edge_id").alias("edge_id"), F.col("weight").cast("int").alias("weight")).join(heads.select("edge_id", *GROUP, "trj"), "edge_id")


def centroids(edges: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """One averaged trajectory a cluster: members in order of their id are merged one by one, half and half.

    The fold begins with the last member.  Each weighs half of what came before,
    so its order is part of the result and a cluster is folded in one task; but
    its rows come sorted, in bounded batches, and only the mean is held.
    """
    bounded_batches(edges.sparkSession)
    keys = [*GROUP, "cluster_id"]
    rows = edges.join(clusters, "edge_id").select("edge_id", *keys, "weight", "trj")
    begin = rows.groupBy(*keys).agg(F.max("edge_id").alias("edge_id")).select("edge_id", F.lit(0).alias("turn"))
    turns = rows.join(begin, "edge_id", "left").withColumn("turn", F.coalesce("turn", F.lit(1)))
    schema = "edge_id long, src string, dst string, weight int, trj array<struct<x:double,y:double,t:double>>"
    trj_type = pa.list_(pa.struct([(c, pa.float64()) for c in "xyt"]))
    out_type = pa.schema([("edge_id", pa.int64()), ("src", pa.string()), ("dst", pa.string()), ("weight", pa.int32()), ("trj", trj_type)])

    def fold(batches):
        key, least, weight, mean = None, 0, 0, None
        text = lambda v: None if v is None else str(v)

        def result():
            points = [dict(zip("xyt", p, strict=True)) for p in mean.tolist()]
            return {"edge_id": least, "src": text(key[0]), "dst": text(key[1]), "weight": weight, "trj": points}

        for batch in batches:
            done = []
            p, at = _flat(batch.column("trj"))
            ids, weights = batch.column("edge_id").to_pylist(), batch.column("weight").to_pylist()
            for k, own in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True)):
                trip = shapes.strictly_later(p[at[k] : at[k + 1]])
                if mean is None or own != key:
                    if mean is not None:
                        done.append(result())
                    key, least, weight, mean = own, ids[k], weights[k], trip
                    continue
                least, weight = min(least, ids[k]), weight + weights[k]
                mean = shapes.merged(trip, mean, threshold) if len(mean) > 1 and len(trip) > 1 else mean
            if done:
                yield pa.RecordBatch.from_pylist(done, out_type)
        if mean is not None:
            yield pa.RecordBatch.from_pylist([result()], out_type)

    return turns.repartition(*keys).sortWithinPartitions(*keys, "turn", "edge_id").mapInArrow(fold, schema)


def simplify(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges with simplified trajectories; only these go to Python, and nothing is moved between partitions."""
    bounded_batches(edges.sparkSession)

    @F.arrow_udf("array<boolean>")
    def kept(column: pa.Array) -> pa.Array:
        p, at = _flat(column)
        found = [shapes.simplified(p[i:j, 0], p[i:j, 1], threshold) for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.array(found, pa.list_(pa.bool_()))

    both = F.arrays_zip(F.col("trj").alias("p"), kept("trj").alias("k"))
    return edges.withColumn("trj", F.transform(F.filter(both, lambda z: z["k"]), lambda z: z["p"])).select(*edges.columns)


def merge_pair(threshold: float) -> Column:
    """Column function of two trajectories: the one half way between them."""

    @F.pandas_udf("array<struct<x:double,y:double,t:double>>")
    def merge(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            mean = shapes.merged(shapes.strictly_later(_array(p)), shapes.strictly_later(_array(q)), threshold)
            out.append([{"x": x, "y": y, "t": t} for x, y, t in mean.tolist()])
        return pd.Series(out)

    return merge
