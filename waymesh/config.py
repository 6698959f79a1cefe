"""Tunables of the movement graph."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Config:
    """Distances are Web-Mercator metres, times milliseconds, velocities km/h unless the name says otherwise."""

    window_size: int = 5
    minimum_velocity: float = 2.5
    epsilon_velocity: float = 1.5
    motion_detector_timespan: int = 60_000
    bbox_max_meters: float = 50.0
    bbox_min_minutes: float = 15.0
    connection_timeout: int = 120_000
    max_hausdorff_meters: float = 100.0
    visvalingam_threshold: float = 0.5
    clustering_threshold: float = 50.0
    #: 24 h makes clustering purely spatial.
    temporal_slack_ms: float = float(DAY_MS)
    use_centroids: bool = False
    min_points: int = 2

    def __post_init__(self):
        if not 0 <= self.temporal_slack_ms <= DAY_MS:
            raise ValueError("temporal_slack_ms must lie between 0 and 24 hours")
        if self.window_size < 3:
            raise ValueError("window_size must be at least 3")

    @classmethod
    def from_json(cls, text: str) -> "Config":
        """Unknown keys are ignored, missing ones keep their defaults."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in names})

    def __str__(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def duration_ms(text: str) -> float:
    """``90`` (ms), ``15m`` or ``24h`` in milliseconds."""
    unit = {"m": 60_000, "h": 3_600_000}.get(text[-1:].lower())
    return float(text[:-1]) * unit if unit else float(text)
