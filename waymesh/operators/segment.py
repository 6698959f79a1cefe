"""Segments of a stream, trajectories and their endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bbox, geo


def timeout_segments(points: DataFrame, keys: list[str], order: list[str], timeout: int, t: str = "t_ms") -> DataFrame:
    """Numbers the segments of a stream: a new one where a gap is longer than ``timeout``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = points.withColumn("__gap", F.col(t) - F.lag(t).over(w))
    running = F.sum(F.when(F.col("__gap") > timeout, 1).otherwise(0)).over(w)
    return gap.withColumn("seg", running.cast("bigint")).drop("__gap")


def alive(points: DataFrame, keys: list[str], order: list[str], timeout: int, t: str = "t_ms") -> DataFrame:
    """Flags rows that come less than ``timeout`` after their predecessor; the first row is alive."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return points.withColumn("is_alive", F.coalesce(F.col(t) - F.lag(t).over(w) < timeout, F.lit(True)))


def trajectories(segments: DataFrame, keys: list[str], order: list[str], t: str = "t_ms", *, min_points: int = 1, id: str | None = None) -> DataFrame:
    """One row a segment: n, start, end, box and the points in order; ``id`` names rows whose least value becomes trj_id.

    A segment is as long as a trip, not as a stream: the array is bounded by the timeout split.
    """
    p = geo.point("x", "y", t)
    rows = segments.groupBy(*keys, "seg").agg(
        F.array_sort(F.collect_list(F.struct(*order, p.alias("p")))).alias("__rows"), bbox.of_rows("x", "y", t).alias("bbox"),
        *([F.min(id).alias("trj_id")] if id else []),
    )
    rows = rows.withColumn("trj", F.transform("__rows", lambda r: r["p"])).drop("__rows").withColumn("n", F.size("trj"))
    return rows.where(F.col("n") >= min_points).select(*(["trj_id"] if id else []), *keys, "seg", "n", F.col("trj")[0].alias("start"), F.element_at("trj", -1).alias("end"), "bbox", "trj")


def segment_summary(segments: DataFrame, keys: list[str], order: list[str], t: str = "t_ms") -> DataFrame:
    """n, first and last point and box of each segment, without gathering its points."""
    o, p = F.struct(*order), geo.point("x", "y", t)
    return segments.groupBy(*keys, "seg").agg(
        F.count("*").alias("n"), F.min_by(p, o).alias("start"), F.max_by(p, o).alias("end"), bbox.of_rows("x", "y", t).alias("bbox")
    )


def endpoints(trips: DataFrame) -> DataFrame:
    """Start and end of each trajectory: ep_id = 2 * trj_id + is_end."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("is_end"), F.col("start").alias("p")), F.struct(F.lit(1).alias("is_end"), F.col("end").alias("p"))))
    rows = trips.select("trj_id", both.alias("e"))
    return rows.select(
        (F.col("trj_id") * 2 + F.col("e.is_end")).alias("ep_id"), "trj_id", (F.col("e.is_end") == 1).alias("is_end"),
        F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"), F.col("e.p.t").alias("t"),
    )


def path_stats(trips: DataFrame) -> DataFrame:
    """Number of trips, and least, upper median and greatest number of points, in one row."""
    counts = trips.groupBy("n").agg(F.count("*").alias("k"))  # as many rows as there are lengths
    lengths = F.array_sort(F.collect_list(F.struct("n", "k")))
    rows = counts.agg(lengths.alias("lengths"), F.sum("k").alias("trips"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("n"))
    median = F.aggregate(
        "lengths", start,
        lambda acc, x: F.struct((acc["upto"] + x["k"]).alias("upto"), F.when(acc["n"].isNull() & (acc["upto"] + x["k"] > F.floor(F.col("trips") / 2)), x["n"]).otherwise(acc["n"]).alias("n")),
    )["n"]
    return rows.select(F.coalesce("trips", F.lit(0)).cast("long").alias("trips"), "shortest", median.alias("median"), "longest")
