"""Numpy helpers on single trajectories: arrays x, y, t. They serve the pandas functions of the operators."""

from __future__ import annotations

import heapq

import numpy as np


def hull_members(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Marks the points on the corners of the convex hull (monotone chain; collinear points are no corners)."""
    n = len(x)
    if n < 3:
        return np.ones(n, bool)
    order = np.lexsort((y, x)).tolist()

    def chain(ids: list[int]) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    corner = {(x[i], y[i]) for i in chain(order) + chain(order[::-1])}
    return np.fromiter(((a, b) in corner for a, b in zip(x, y, strict=True)), bool, n)


def spike_window(x: np.ndarray, y: np.ndarray, size: int, carried: int = 0) -> tuple[np.ndarray, list[int]]:
    """Marks the points that have left the convex-hull filter's window as kept, and tells which are still in it.

    The first ``carried`` points are those that an earlier call left in the window.
    After each push the corners of the window's hull are taken in stream order;
    an inner one that is farther from either neighbour than those are from each
    other is a spike.  Each spike takes the first point at its position from the
    window, behind the one that the spike before it has taken; other points at
    that position stay.  A full window emits its head.
    """
    keep = np.zeros(len(x), bool)
    window = list(range(carried))
    for i in range(carried, len(x)):
        window.append(i)
        corners = [w for w, on in zip(window, hull_members(x[window], y[window]), strict=True) if on]
        spikes = []
        for p, q, r in zip(corners, corners[1:], corners[2:], strict=False):
            base = np.hypot(x[p] - x[r], y[p] - y[r])
            if np.hypot(x[p] - x[q], y[p] - y[q]) > base or np.hypot(x[q] - x[r], y[q] - y[r]) > base:
                spikes.append((x[q], y[q]))
        if spikes:
            left = []
            for w in window:
                if spikes and (x[w], y[w]) == spikes[0]:
                    spikes.pop(0)
                else:
                    left.append(w)
            window = left
        if len(window) >= size:
            keep[window.pop(0)] = True
    return keep, window


def without_spikes(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Marks the points that the convex-hull filter keeps, in stream order; at the end the window is kept."""
    keep, window = spike_window(x, y, size)
    keep[window] = True
    return keep


def simplified(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Marks the points that Visvalingam-Whyatt simplification keeps: both ends, and inner ones of more than ``threshold`` area."""
    n = len(x)
    keep = np.ones(n, bool)
    if n < 3:
        return keep
    x, y = x.tolist(), y.tolist()  # plain numbers are read much faster one by one
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    size = lambda a, b, c: abs((x[a] * (y[b] - y[c]) + x[b] * (y[c] - y[a]) + x[c] * (y[a] - y[b])) / 2)
    area = [0.0] * n
    heap = []
    for i in range(1, n - 1):
        area[i] = size(i - 1, i, i + 1)
        heap.append((area[i], i))
    heapq.heapify(heap)
    while heap:
        a, i = heapq.heappop(heap)
        if not keep[i] or a != area[i]:
            continue
        if a > threshold:
            break
        keep[i] = False
        l, r = left[i], right[i]
        right[l], left[r] = r, l
        for j in (l, r):
            if 0 < j < n - 1:
                area[j] = size(left[j], j, right[j])
                heapq.heappush(heap, (area[j], j))
    return keep


def at_times(trj: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Positions of a trajectory (rows x, y, t) at times within its span."""
    return np.stack([np.interp(t, trj[:, 2], trj[:, 0]), np.interp(t, trj[:, 2], trj[:, 1]), t], axis=1)


def strictly_later(trj: np.ndarray) -> np.ndarray:
    """Keeps the first point, then each one later than all before it."""
    if len(trj) < 2:
        return trj
    latest = np.maximum.accumulate(trj[:, 2])
    return trj[np.append(True, trj[1:, 2] > latest[:-1])]


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both moved in time by half the gap between their starts, so that they start together."""
    a, b = a.copy(), b.copy()
    start = (a[0, 2] + b[0, 2]) / 2
    a[:, 2] += start - a[0, 2]
    b[:, 2] += start - b[0, 2]
    return a, b


def morphed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both stretched in time to their mean duration; they start together."""
    spans = a[-1, 2] - a[0, 2], b[-1, 2] - b[0, 2]
    mean = sum(spans) / 2
    out = []
    for trj, span in zip((a, b), spans, strict=True):
        trj = trj.copy()
        begin = trj[0, 2]
        if span > 0:
            trj[:, 2] = begin + (trj[:, 2] - begin) * (mean / span)
        trj[-1, 2] = begin + mean
        out.append(trj)
    return out[0], out[1]


def averaged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mean of both at all their times."""
    if not len(a) or not len(b):
        return np.empty((0, 3))
    t = np.unique(np.concatenate([a[:, 2], b[:, 2]]))
    t = t[(t >= max(a[0, 2], b[0, 2])) & (t <= min(a[-1, 2], b[-1, 2]))]
    return (at_times(a, t) + at_times(b, t)) / 2


def merged(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """One trajectory half way between two: aligned, stretched, averaged and simplified."""
    mean = strictly_later(averaged(*morphed(*aligned(a, b))))
    return mean[simplified(mean[:, 0], mean[:, 1], threshold)]


def clipped(trj: np.ndarray, start: float, end: float) -> np.ndarray:
    """The part within a time span, with interpolated ends."""
    if not len(trj) or start > end or end < trj[0, 2] or start > trj[-1, 2]:
        return trj[:0]
    start, end = max(start, trj[0, 2]), min(end, trj[-1, 2])
    inner = trj[(trj[:, 2] > start) & (trj[:, 2] < end), 2]
    return at_times(trj, np.unique(np.concatenate([[start], inner, [end]])))


def _over_common_span(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = max(a[0, 2], b[0, 2]), min(a[-1, 2], b[-1, 2])
    t = np.unique(np.concatenate([a[:, 2], b[:, 2], [start, end]]))
    t = t[(t >= start) & (t <= end)] if start <= end else t[:0]
    return t, at_times(a, t), at_times(b, t)


def _nearest(a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    """Squared distance of each point of ``a`` to the nearest of ``b``; about ``cells`` distances are held."""
    piece = max(1, cells // max(1, len(b)))
    parts = [((a[i : i + piece, None, 0] - b[None, :, 0]) ** 2 + (a[i : i + piece, None, 1] - b[None, :, 1]) ** 2).min(axis=1) for i in range(0, len(a), piece)]
    return np.concatenate(parts)


def _quartered(p: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes of points (``start`` tells where each begins) parted at their middles: points, where each part begins, and its box before."""
    box = np.repeat(np.arange(len(start) - 1), np.diff(start))
    middle = (np.minimum.reduceat(p, start[:-1]) + np.maximum.reduceat(p, start[:-1])) / 2
    part = box * 4 + (p > middle[box]) @ np.array([2, 1])
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return p[order], np.append(first, len(p)), part[first] // 4


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) + np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size)


#: What rounding may take from a bound, as a share; pairs of boxes that are held at once.
_LOOSE, _PAIRS = 1 + 1e-9, 1 << 16


def _farthest(a: np.ndarray, b: np.ndarray, least: float, cells: int) -> float:
    """The greatest squared distance of a point of ``a`` to the nearest of ``b``, ``least`` at least.

    Boxes of both are parted again and again: those of ``b`` that can't have the nearest
    point of a box of ``a`` go, and those of ``a`` that can't have the farthest one.
    """
    starts = [np.array([0, len(a)]), np.array([0, len(b)])]
    i = j = np.zeros(1, int)
    bound = least
    while True:
        (low_a, high_a), (low_b, high_b) = ((np.minimum.reduceat(p, s[:-1]), np.maximum.reduceat(p, s[:-1])) for p, s in zip((a, b), starts, strict=True))
        near = (np.maximum(0, np.maximum(low_b[j] - high_a[i], low_a[i] - high_b[j])) ** 2).sum(axis=1)
        far = (np.maximum(high_b[j] - low_a[i], high_a[i] - low_b[j]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        upper = np.repeat(np.minimum.reduceat(far, first), np.diff(np.append(first, len(i)))) * _LOOSE
        bound = max(bound, float(np.minimum.reduceat(near, first).max()))
        open_ = (near <= upper) & (upper * _LOOSE >= bound)
        i, j, upper = i[open_], j[open_], upper[open_]
        sizes = [np.diff(s) for s in starts]
        if not len(i) or len(i) > _PAIRS or int((sizes[0][i] * sizes[1][j]).sum()) <= 4 * (len(a) + len(b)):
            break
        parts = []
        for k, p in enumerate((a, b)):
            p, starts[k], above = _quartered(p, starts[k])
            begin = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            parts.append((p, begin, np.diff(np.append(begin, len(above)))))
        (a, at_a, n_a), (b, at_b, n_b) = parts
        pair = np.repeat(np.arange(len(i)), n_a[i])
        i, j = _ranges(at_a[i], n_a[i]), j[pair]
        i, j = np.repeat(i, n_b[j]), _ranges(at_b[j], n_b[j])
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
    last = np.append(first[1:], len(i))
    for k in np.argsort(-upper[first], kind="stable").tolist():
        if upper[first[k]] * _LOOSE < least:
            break
        box = i[first[k]]
        there = j[first[k] : last[k]]
        others = b[_ranges(starts[1][there], sizes[1][there])]
        least = max(least, float(_nearest(a[starts[0][box] : starts[0][box + 1]], others, cells).max()))
    return least


def _positions(p: np.ndarray) -> np.ndarray:
    """Distinct x, y."""
    at = np.empty(len(p), complex)
    at.real, at.imag = p[:, 0], p[:, 1]
    at = np.unique(at)
    return np.stack([at.real, at.imag], axis=1)


def hausdorff(a: np.ndarray, b: np.ndarray, cells: int = 1 << 17) -> float:
    """Symmetric discrete Hausdorff distance in the plane; about ``cells`` distances are held, and of longer trajectories few are computed."""
    if len(a) * len(b) > 16 * cells and np.isfinite(a[:, :2]).all() and np.isfinite(b[:, :2]).all():
        a, b = _positions(a), _positions(b)
        if len(a) * len(b) > 16 * cells:
            return float(np.sqrt(_farthest(b, a, _farthest(a, b, 0.0, cells), cells)))
    there, back, piece = 0.0, np.full(len(b), np.inf), max(1, cells // max(1, len(b)))
    for i in range(0, len(a), piece):
        d = (a[i : i + piece, None, 0] - b[None, :, 0]) ** 2 + (a[i : i + piece, None, 1] - b[None, :, 1]) ** 2
        there = max(there, float(d.min(axis=1).max()))
        np.minimum(back, d.min(axis=0), out=back)
    return float(np.sqrt(max(there, float(back.max()))))


def dissim(a: np.ndarray, b: np.ndarray) -> float:
    """Integral of the distance over the common time span (trapezoid rule over all times of both)."""
    t, p, q = _over_common_span(a, b)
    d = np.hypot(p[:, 0] - q[:, 0], p[:, 1] - q[:, 1])
    return float(((d[1:] + d[:-1]) / 2 * np.diff(t)).sum())


def area_between(a: np.ndarray, b: np.ndarray) -> float:
    """Exact area between the curves in (x, t) plus that in (y, t), over the common time span."""
    t, p, q = _over_common_span(a, b)
    total = 0.0
    for k in (0, 1):
        d = p[:, k] - q[:, k]
        u, v, w = d[:-1], d[1:], np.diff(t)
        cross = u * v < 0
        size = np.abs(u) + np.abs(v)
        safe = np.where(size > 0, size, 1)
        total += float(np.where(cross, (u * u + v * v) / (2 * safe), size / 2) @ w)
    return total
