"""Motion and stop detection in window functions.

The velocity of a point looks back over a time span; the motion state is a walk
on -1, 0, +1 that moving and resting points push up and down.  Two equal pushes
in a row fix the state, and from there pushes alternate, so the walk has a
closed form and needs no fold over the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def velocity(points: DataFrame, keys: list[str], order: list[str], timespan: int, t: str = "t_ms") -> DataFrame:
    """``kmh``: way over time since the latest point more than ``timespan`` ms ago (else since the first).

    Points of one time: infinite if there was a way between, else null.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.coalesce(geo.distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)), F.lit(0.0))
    rows = points.withColumn("__step", step).withColumn("__way", F.sum("__step").over(w))
    at = F.struct(F.col(t).alias("t"), F.col("__way").alias("way"))
    earlier = Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, -(int(timespan) + 1))
    # ways only grow, so the greatest (time, way) is the latest point
    rows = rows.withColumn("__from", F.coalesce(F.max(at).over(earlier), F.min(at).over(Window.partitionBy(*keys))))
    way, time = F.col("__way") - F.col("__from.way"), F.col(t) - F.col("__from.t")
    kmh = F.when(time > 0, way / time * 3600).when(way > 0, F.lit(float("inf")))
    return rows.withColumn("kmh", kmh).drop("__step", "__way", "__from")


def motion_state(points: DataFrame, keys: list[str], order: list[str], least_kmh: float) -> DataFrame:
    """``moving`` and ``motion`` (+1 fast, 0 undecided, -1 slow) of points with ``kmh``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = points.withColumn("moving", F.coalesce(F.col("kmh") > least_kmh, F.lit(False)))
    rows = rows.withColumn("__n", F.row_number().over(w)).withColumn("__push", F.when(F.col("moving"), 1).otherwise(-1))
    rows = rows.withColumn("__fixed", F.when((F.col("__n") == 1) | (F.col("__push") == F.lag("__push").over(w)), F.col("__n")))
    since = F.col("__n") - F.last("__fixed", ignorenulls=True).over(w)
    rows = rows.withColumn("__since", since)
    return rows.withColumn("motion", F.when(F.col("__since") % 2 == 0, F.col("__push")).otherwise(0)).drop("__n", "__push", "__fixed", "__since")


def stop_state(points: DataFrame, keys: list[str], order: list[str], meters: float, minutes: float, t: str = "t_ms") -> DataFrame:
    """``epoch`` and ``stop`` (+1 stopped, 0 maybe, -1 not) of points with ``motion``.

    Slow motion opens a new epoch.  Within an epoch the box of its points so far
    decides: small enough and long enough is a stop, small enough maybe one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = points.withColumn("epoch", F.sum((F.col("motion") == -1).cast("long")).over(w))
    own = Window.partitionBy(*keys, "epoch").orderBy(*order)
    side = lambda c: F.max(c).over(own) - F.min(c).over(own)
    small = F.greatest(side("x"), side("y")) < meters
    long_enough = side(t) / 60_000 > minutes
    stop = F.when(F.row_number().over(own) == 1, -1).when(small & long_enough, 1).when(small, 0).otherwise(-1)
    return rows.withColumn("stop", stop)
