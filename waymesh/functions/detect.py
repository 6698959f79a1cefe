"""Motion and stop states of one segment in order, as numpy folds: for streams, where no window spans the batches.

The same states as ``operators.motion`` computes with window functions.
"""

from __future__ import annotations

import numpy as np


def velocities(x: np.ndarray, y: np.ndarray, t: np.ndarray, timespan: float) -> np.ndarray:
    """km/h since the latest point more than ``timespan`` ms ago, else since the first; nan without way and time."""
    way = np.append(0.0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))) if len(x) else np.empty(0)
    earlier = np.searchsorted(t, t - timespan, "left") - 1
    since = np.maximum(earlier, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (way - way[since]) / (t - t[since]) * 3600


def motion_states(kmh: np.ndarray, least_kmh: float) -> np.ndarray:
    """A walk on -1, 0, 1 that starts at 0: up while moving, else down."""
    out, state = np.zeros(len(kmh), np.int64), 0
    for i, v in enumerate(kmh.tolist()):
        state = max(-1, min(1, state + (1 if v > least_kmh else -1)))
        out[i] = state
    return out


def stop_states(x: np.ndarray, y: np.ndarray, t: np.ndarray, motion: np.ndarray, meters: float, minutes: float) -> np.ndarray:
    """1 stopped, 0 maybe, -1 not: by the box of the points since slow motion began anew."""
    out, first = np.full(len(x), -1, np.int64), 0
    for i in range(len(x)):
        if i and motion[i] == -1:
            first = i
        if i > first:
            own = slice(first, i + 1)
            if max(np.ptp(x[own]), np.ptp(y[own])) < meters:
                out[i] = 1 if (t[i] - t[first]) / 60_000 > minutes else 0
    return out
