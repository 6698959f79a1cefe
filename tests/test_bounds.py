"""What is held at once in a worker or sent to all of them is bounded, however long trips are."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from waymesh.config import Config
from waymesh.functions import shapes
from waymesh.operators import edges as edge_ops, paths
from waymesh.plans import graph

POINTS = "transform(sequence(0, {n}), i -> struct(cast(id % 7 + i as double) as x, cast(i as double) as y, cast(i as double) as t))"


def test_batches_of_pairs_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")
    edges = spark.range(60).select(F.col("id").alias("edge_id"), F.lit(1).alias("src"), F.lit(2).alias("dst"), F.expr(POINTS.format(n=2000)).alias("trj")).coalesce(1)

    @F.arrow_udf("long")
    def batch_bytes(trj: pa.Array) -> pa.Array:
        return pa.array([len(trj.flatten()) * 24] * len(trj), pa.int64())

    most = edge_ops.edge_pairs(edges).select(batch_bytes("trj_a").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert most[1] == 60 * 59 // 2 and most[0] <= 2 << 20


def test_hausdorff_in_pieces_of_any_size():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(37, 3)), rng.normal(size=(23, 3))
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    want = max(d.min(axis=1).max(), d.min(axis=0).max())
    assert all(np.isclose(shapes.hausdorff(a, b, cells=cells), want) for cells in (1, 24, 100, 1 << 17))


def test_trips_are_not_broadcast(spark):
    p = lambda k: F.col("trj")[k].alias("start" if not k else "end")
    trips = spark.range(10).select(F.col("id").alias("trj_id"), F.expr(POINTS.format(n=1)).alias("trj")).select("trj_id", p(0), p(1), "trj")
    _, edges = graph.place_graph(trips, Config())
    assert edges.count() == 10
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert "SortMergeJoin" in edges._jdf.queryExecution().sparkPlan().toString().splitlines()[1]


def test_walk_reads_its_columns_only(spark):
    points = spark.range(8).selectExpr("id % 2 as k", "id as seq", "cast(id as double) as x", "0D as y", "id * 1000 as t_ms", "-1 as stop", "uuid() as note")
    found = paths.paths(points, ["k"], ["seq"], 2.0)
    assert "note" not in found._jdf.queryExecution().optimizedPlan().toString()
