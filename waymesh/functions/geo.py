"""Column functions on points: projection, distances, interpolation, triangles and lines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAY_MS

#: Radius of the sphere of EPSG:3857 in metres.
RADIUS = 6_378_137.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def mercator_x(lon) -> Column:
    return RADIUS * F.radians(_c(lon))


def mercator_y(lat) -> Column:
    return RADIUS * F.log(F.abs(F.tan(math.pi / 4 + F.radians(_c(lat)) / 2)))


def longitude(x) -> Column:
    return F.degrees(_c(x) / RADIUS)


def latitude(y) -> Column:
    return F.degrees(math.pi / 2 - 2 * F.atan(F.exp(-_c(y) / RADIUS)))


def time_of_day_ms(ts) -> Column:
    """Whole milliseconds since midnight; works on timestamps with and without time zone."""
    t = _c(ts)
    return (F.hour(t) * 3_600_000 + F.minute(t) * 60_000 + F.floor(F.extract(F.lit("SECOND"), t) * 1000)).cast("bigint")


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def time_weight(slack_ms: float) -> float:
    """Metres squared a millisecond squared counts for: nought at a slack of 24 hours."""
    return (DAY_MS - slack_ms) / 1000.0


def spatiotemporal_distance(x1, y1, t1, x2, y2, t2, slack_ms: float) -> Column:
    dx, dy, dt = _c(x1) - _c(x2), _c(y1) - _c(y2), _c(t1) - _c(t2)
    return F.sqrt(dx * dx + dy * dy + time_weight(slack_ms) * dt * dt)


def point(x, y, t) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"), _c(t).cast("double").alias("t"))


def interpolate(t, p: Column, q: Column) -> Column:
    """The point between p and q at time t; exact at both ends, null outside."""
    t = _c(t)
    share = (t - p["t"]) / (q["t"] - p["t"])
    inner = point(p["x"] + (q["x"] - p["x"]) * share, p["y"] + (q["y"] - p["y"]) * share, t)
    return F.when(t == p["t"], p).when(t == q["t"], q).when((t > p["t"]) & (t < q["t"]), inner)


def mean_point(a: Column, b: Column) -> Column:
    """Mean of x and y, at the first point's time."""
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, a["t"])


def line_intersection(a: Column, b: Column, c: Column, d: Column, *, either: bool = False) -> Column:
    """Where segments ab and cd meet; null if they don't or are parallel. ``either``: within one of the two is enough."""
    det = (a["x"] - b["x"]) * (c["y"] - d["y"]) - (a["y"] - b["y"]) * (c["x"] - d["x"])
    along = F.when(det != 0, ((a["x"] - c["x"]) * (c["y"] - d["y"]) - (a["y"] - c["y"]) * (c["x"] - d["x"])) / det)
    across = F.when(det != 0, ((a["x"] - c["x"]) * (a["y"] - b["y"]) - (a["y"] - c["y"]) * (a["x"] - b["x"])) / det)
    in_ab, in_cd = along.between(0, 1), across.between(0, 1)
    meets = in_ab | in_cd if either else in_ab & in_cd
    at = F.struct((a["x"] + along * (b["x"] - a["x"])).alias("x"), (a["y"] + along * (b["y"] - a["y"])).alias("y"))
    return F.when(meets, at)


def triangle_area(p: Column, q: Column, r: Column) -> Column:
    return F.abs((p["x"] * (q["y"] - r["y"]) + q["x"] * (r["y"] - p["y"]) + r["x"] * (p["y"] - q["y"])) / 2)


def clock(t) -> Column:
    """Milliseconds since midnight as HH:MM:SS."""
    s = F.floor(_c(t) / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def advanced(line: Column, p: Column) -> Column:
    """The line from the end of ``line`` (struct of start and end) to ``p``."""
    return F.struct(line["end"].alias("start"), p.alias("end"))


def line_length(line: Column) -> Column:
    return distance(line["start"]["x"], line["start"]["y"], line["end"]["x"], line["end"]["y"])


def is_monotone(trj: Column) -> Column:
    """Whether each point of an array is later than the one before; true for none and one."""
    n = F.size(trj)
    steps = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: (F.try_element_at(trj, k)["t"] > F.try_element_at(trj, k - 1)["t"]))
    return (n < 2) | F.forall(steps, lambda x: x)


def dimensions(box: Column) -> Column:
    """A box's width and height, as ``12.30m x 4.00m``."""
    return F.format_string("%.2fm x %.2fm", box["x2"] - box["x1"], box["y2"] - box["y1"])


def plain_number(x) -> Column:
    """A double as digits without exponent and without trailing zeros."""
    return F.regexp_replace(_c(x).cast("decimal(38,9)").cast("string"), r"(\.0+|(\.\d*?)0+)$", "$2")
