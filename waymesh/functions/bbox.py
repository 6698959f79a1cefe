"""Column functions on boxes, structs of x1, x2, y1, y2, t1, t2; all intervals are closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "x2", "y1", "y2", "t1", "t2")


def make(**sides: Column) -> Column:
    return F.struct(*(sides[s].cast("double").alias(s) for s in SIDES))


def of_rows(x="x", y="y", t="t") -> Column:
    """Aggregate: the box of all rows of a group (or window)."""
    return make(x1=F.min(x), x2=F.max(x), y1=F.min(y), y2=F.max(y), t1=F.min(t), t2=F.max(t))


def of_array(points: Column) -> Column:
    """The box of an array of points."""
    each = lambda f: F.transform(points, lambda p: p[f])
    return make(**{f"{f}{n}": g(each(f)) for f in "xyt" for n, g in ((1, F.array_min), (2, F.array_max))})


def contains(box: Column, p: Column) -> Column:
    return in_spatial(box, p) & in_temporal(box, p)


def in_temporal(box: Column, p: Column) -> Column:
    return p["t"].between(box["t1"], box["t2"])


def in_spatial(box: Column, p: Column) -> Column:
    return p["x"].between(box["x1"], box["x2"]) & p["y"].between(box["y1"], box["y2"])


def is_before(a: Column, b: Column) -> Column:
    return a["t2"] < b["t1"]


def is_single_point(box: Column) -> Column:
    """In time only."""
    return box["t1"] == box["t2"]


def fits_spatially(box: Column, meters: float) -> Column:
    return F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"]) < meters


def fits_temporally(box: Column, minutes: float) -> Column:
    return (box["t2"] - box["t1"]) / 60_000 > minutes


def interval_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def overlap_share(a: Column, b: Column) -> Column:
    """Common area as a share of the smaller box; 0 if that has none."""
    common = interval_overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * interval_overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, common / smaller).otherwise(0.0)


def overlaps_spatially(a: Column, b: Column, share: float = 0.5) -> Column:
    return overlap_share(a, b) >= share


def union(a: Column, b: Column) -> Column:
    return make(**{f"{f}{n}": g(a[f"{f}{n}"], b[f"{f}{n}"]) for f in "xyt" for n, g in ((1, F.least), (2, F.greatest))})


def with_point(box: Column, p: Column) -> Column:
    return make(**{f"{f}{n}": g(box[f"{f}{n}"], p[f]) for f in "xyt" for n, g in ((1, F.least), (2, F.greatest))})


def can_contain(box: Column, points: Column, meters: float) -> Column:
    """Whether the box grown by all the points still fits."""
    return fits_spatially(union(box, of_array(points)), meters)


def longest_side(box: Column, *, shorter: bool = False) -> Column:
    """The longer side; ``shorter``: minus the shorter one, as an order of growth."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    return -F.least(w, h) if shorter else F.greatest(w, h)


def split_at(box: Column, t: Column) -> Column:
    """Two boxes: up to t, and from t + 1 on; times out of order are put in order."""
    first = make(**{s: box[s] for s in SIDES[:4]}, t1=F.least(box["t1"], t), t2=F.greatest(box["t1"], t))
    second = make(**{s: box[s] for s in SIDES[:4]}, t1=F.least(t + 1, box["t2"]), t2=F.greatest(t + 1, box["t2"]))
    return F.array(first, second)


def time_order(box: Column) -> Column:
    """What boxes are sorted by."""
    return F.struct(box["t1"], box["t2"])


def padded(box: Column, meters: float) -> Column:
    return make(x1=box["x1"] - meters, x2=box["x2"] + meters, y1=box["y1"] - meters, y2=box["y2"] + meters, t1=box["t1"], t2=box["t2"])
