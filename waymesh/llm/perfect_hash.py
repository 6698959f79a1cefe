"""Minimal perfect hash over byte keys or 64-bit hashes (hash and displace).

Keys go to buckets of about four; the largest bucket first, each bucket takes
the first displacement that puts its keys on free slots.  n keys fill exactly
n slots, so a lookup is one hash, one displacement and one slot.  A key that
is not in the set also gets a slot; callers compare the stored key or
fingerprint.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """``build`` from distinct 64-bit hashes; ``slots`` maps hashes to 0..n-1."""

    def __init__(self, n: int, seed: int, displace: np.ndarray):
        self.n, self.seed, self.displace = n, seed, displace

    @staticmethod
    def _parts(hashes: np.ndarray, seed: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = mixed(hashes + np.uint64(seed) * _GOLDEN)
        return (h >> np.uint64(40)) % np.uint64(n_buckets), h

    @staticmethod
    def _slot(h: np.ndarray, d: np.ndarray | np.uint64, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(h + d * _GOLDEN) % np.uint64(n)

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        hashes = np.asarray(hashes, np.uint64)
        n = len(hashes)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys must be distinct")
        n_buckets = max(1, n // 4)
        if n == 0:
            return cls(0, 0, np.zeros(1, np.int32))
        for seed in range(1, 64):
            displace = cls._try(hashes, n, n_buckets, seed)
            if displace is not None:
                return cls(n, seed, displace)
        raise RuntimeError("no perfect hash found")

    @classmethod
    def _try(cls, hashes: np.ndarray, n: int, n_buckets: int, seed: int) -> np.ndarray | None:
        bucket, h = cls._parts(hashes, seed, n_buckets)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket.astype(np.int64), minlength=n_buckets)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        h = h[order]
        free = np.ones(n, bool)
        displace = np.zeros(n_buckets, np.int32)
        tries = np.arange(1, 65, dtype=np.uint64)
        by_size = np.argsort(-counts, kind="stable")
        for b in by_size[: int((counts > 1).sum())]:
            own = h[starts[b] : starts[b] + counts[b]]
            base = np.uint64(0)
            while True:
                slots = cls._slot(own[None, :], (tries + base)[:, None], n).astype(np.int64)
                ok = free[slots].all(axis=1)
                ok[ok] = [len(set(s)) == len(s) for s in slots[ok].tolist()]
                if ok.any():
                    at = int(np.argmax(ok))
                    free[slots[at]] = False
                    displace[b] = int(tries[at] + base)
                    break
                base += np.uint64(64)
                if base > 1 << 22:
                    return None
        # buckets of one key name their slot outright, as -(slot + 1)
        singles = np.flatnonzero(counts == 1)
        displace[singles] = -(np.flatnonzero(free)[: len(singles)] + 1).astype(np.int32)
        return displace

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        hashes = np.asarray(hashes, np.uint64)
        if self.n == 0:
            return np.full(len(hashes), -1, np.int64)
        bucket, h = self._parts(hashes, self.seed, len(self.displace))
        d = self.displace[bucket.astype(np.int64)].astype(np.int64)
        found = self._slot(h, np.maximum(d, 0).astype(np.uint64), self.n).astype(np.int64)
        return np.where(d < 0, -d - 1, found)
