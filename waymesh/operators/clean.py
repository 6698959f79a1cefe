"""Cleaning of point streams: runs of days, the time guard, and the spike filter.

Points are rows with ``keys`` (the stream) and an order; nothing here is sorted
globally.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes
from ..shared import written


def _before(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def day_runs(points: DataFrame, keys: list[str], order: list[str], day: str = "day", out: str = "run") -> DataFrame:
    """Numbers the runs of equal days in a stream from 0: A, B, A are three runs."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(day).eqNullSafe(F.lag(day).over(w))) & (F.row_number().over(w) > 1)
    return points.withColumn("__new", new.cast("long")).withColumn(out, F.sum("__new").over(w)).drop("__new")


def is_in_time(keys: list[str], order: list[str], t: str = "t_ms") -> Column:
    """The time guard: not before the latest earlier row (dropped rows never raise it)."""
    return F.coalesce(F.col(t) >= F.max(t).over(_before(keys, order)), F.lit(True))


def time_guard(points: DataFrame, keys: list[str], order: list[str], t: str = "t_ms") -> DataFrame:
    """Drops rows whose time lies before an earlier row's; ties stay, rows without time go."""
    return points.where(F.col(t).isNotNull()).withColumn("__ok", is_in_time(keys, order, t)).where("__ok").drop("__ok")


#: Rows of a stream from which on it is filtered in chunks, and about as many rows a chunk has.
CHUNK_ROWS = 200_000
_OPEN = "array<struct<part:int,pos:long,x:double,y:double>>"


def spike_filter(points: DataFrame, keys: list[str], order: list[str], window_size: int = 5, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Drops points that stand out of the convex hull of a window of points.

    The window slides in order, and what was dropped from it changes what it sees
    next.  Streams of up to ``chunk_rows`` are a group each; if one is longer, all
    are cut into chunks, with the same result (see ``_spikes_in_chunks``).
    """
    longest = points.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"), F.sum("n").alias("all")).first()
    if (longest["longest"] or 0) > chunk_rows:
        return _spikes_in_chunks(points, keys, order, window_size, math.ceil(longest["all"] / chunk_rows))
    schema = points.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows[shapes.without_spikes(rows["x"].to_numpy(), rows["y"].to_numpy(), window_size)]

    return points.groupBy(*keys).applyInPandas(run, schema)


def _spikes_in_chunks(points: DataFrame, keys: list[str], order: list[str], size: int, parts: int) -> DataFrame:
    """The spike filter over ranges of streams, each begun with the window that the range before it left.

    All ranges first begin with an empty window.  Those whose predecessor left
    another one than they began with are folded again, until none is left: after
    round n at the latest the n-th range is right, and mostly after the second,
    as a window soon forgets how it began.  A window holds fewer than ``size`` points.
    """
    ranged = points.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = written(ranged.withColumns({"__part": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()}), "chunks")
    # null keys meet as well: a chunk is named by its first row
    named = rows.groupBy(*keys, "__part").agg(F.min("__pos").alias("__chunk"))
    stream = Window.partitionBy(*keys).orderBy("__part")
    chunks = written(named.select("__chunk", "__part", F.lag("__chunk").over(stream).alias("before")), "chunk-names")
    last_start = F.max(F.when(F.col("__new"), F.col("__pos"))).over(Window.partitionBy("__part").orderBy("__pos"))
    new = ~F.struct(*keys).eqNullSafe(F.lag(F.struct(*keys)).over(Window.partitionBy("__part").orderBy("__pos")))
    rows = written(rows.withColumn("__new", new).withColumn("__chunk", last_start).drop("__new"), "chunks")

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("__pos")
        begun = list(right["begun"].iloc[0])
        x = np.concatenate([[p["x"] for p in begun], left["x"].to_numpy(float)])
        y = np.concatenate([[p["y"] for p in begun], left["y"].to_numpy(float)])
        keep, window = shapes.spike_window(x, y, size, len(begun))
        own, part = left["__pos"].to_numpy(), int(left["__part"].iloc[0])
        at = [(p["part"], p["pos"]) for p in begun] + [(part, int(p)) for p in own]
        name = lambda i: {"part": at[i][0], "pos": at[i][1], "x": float(x[i]), "y": float(y[i])}
        before = range(len(begun))
        rows = (int(left["__chunk"].iloc[0]), [name(i) for i in before], [name(i) for i in window], [name(i) for i in before if keep[i]])
        return pd.DataFrame([rows], columns=["__chunk", "begun", "ended", "late"])

    narrow = rows.select("__chunk", "__part", "__pos", "x", "y")
    schema = f"__chunk long, begun {_OPEN}, ended {_OPEN}, late {_OPEN}"
    todo, done = chunks.select("__chunk", F.array().cast(_OPEN).alias("begun")), None
    while True:
        mine = narrow if done is None else narrow.join(todo.select("__chunk"), "__chunk", "left_semi")
        new_states = mine.groupBy("__chunk").cogroup(todo.groupBy("__chunk")).applyInPandas(fold, schema)
        if done is not None:
            new_states = done.join(todo.select("__chunk"), "__chunk", "left_anti").unionByName(new_states)
        done = written(new_states, "chunk-states")
        ends = done.select(F.col("__chunk").alias("before"), F.col("ended").alias("wanted"))
        asked = chunks.join(ends, "before").join(done, "__chunk").where(~F.col("wanted").eqNullSafe(F.col("begun")))
        todo = written(asked.select("__chunk", F.col("wanted").alias("begun")), "chunks-to-do")
        if not todo.limit(1).count():
            break

    # rows that a later chunk, or the end of the stream, let out of the window
    final = chunks.select(F.col("before").alias("__chunk")).where("__chunk is not null")
    rest = done.join(final, "__chunk", "left_anti").select(F.explode("ended").alias("p"))
    late = done.select(F.explode("late").alias("p")).unionByName(rest).select(F.col("p.part").alias("__part"), F.col("p.pos").alias("__pos"))
    owner = late.join(rows.select("__part", "__pos", "__chunk"), ["__part", "__pos"]).groupBy("__chunk").agg(F.collect_list("__pos").alias("late"))
    given = done.select("__chunk", "begun").join(owner, "__chunk", "left").select("__chunk", "begun", F.coalesce("late", F.array().cast("array<long>")).alias("late"))

    def emit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("__pos")
        begun = list(right["begun"].iloc[0])
        x = np.concatenate([[p["x"] for p in begun], left["x"].to_numpy(float)])
        y = np.concatenate([[p["y"] for p in begun], left["y"].to_numpy(float)])
        keep = shapes.spike_window(x, y, size, len(begun))[0][len(begun) :]
        return left[keep | left["__pos"].isin(list(right["late"].iloc[0])).to_numpy()]

    kept = rows.groupBy("__chunk").cogroup(given.groupBy("__chunk")).applyInPandas(emit, rows.schema)
    return kept.select(*points.columns)
