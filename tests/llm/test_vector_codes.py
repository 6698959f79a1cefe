"""Operator 13 against Lloyd's algorithm in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from waymesh.llm import vector_codes

SCHEMA = "vec_id long, embedding array<{}>, label int, part int, codes string, n long"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label error), digest; components as Python integers."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    if not good:
        return [], None
    whole = lambda x: math.floor(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024)
    width = -(-len(good[0][1]) // parts)
    cut = []
    for r in good:
        v = [whole(x) for x in r[1]]
        v += [0] * (parts * width - len(v))
        cut.append([v[p * width : (p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(col) // len(g) for col in zip(*g)]
    found, by_label = [], {}
    for r, c in zip(good, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        found.append((r[0], "".join(f"{k:02x}" for _, k in best), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), code, error, by_label[label]) for i, code, error, label in found), digest


def compared(spark, rows, item="float"):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA.format(item))
    coded, books = vector_codes.encode(frame)
    found = sorted((str(r.vec_id), bytes(r.codes).hex(), r.error, r.label_error) for r in coded.collect())
    return found, vector_codes.digest(books) if found else None


def f32(x):
    return float(np.float32(x))


def test_many_vectors(spark):
    rng = random.Random(3)
    rows = [(i * 3, [f32(rng.gauss(0, 0.2)) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(700)]
    rng.shuffle(rows)
    assert compared(spark, rows) == plain(rows)


def test_ties_and_odd_rows(spark):
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.randrange(-2, 3) / 1024 for _ in range(6)], i % 3 or None) for i in range(400)]  # a length four doesn't divide, many equal parts
    rows += [(1, [0.0] * 6, 1), (None, [0.5] * 6, 2), (None, [0.25] * 6, None), (900, None, 1), (901, [], 1), (902, [1.0] * 5, 1), (903, [None] + [1.0] * 5, 1), (904, [nan] * 6, 1), (905, [-inf] + [0.0] * 5, 1)]
    assert compared(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [2.0**22, 2.0**34, 2.0**60 / 1024])
def test_large_components(spark, size):
    rng = random.Random(6)
    rows = [(i, [f32(rng.uniform(-1, 1) * size) for _ in range(4)], 1) for i in range(20)] + [(20 + i, [f32(size * (i % 7) / 8)] * 4, None) for i in range(270 if size < 2**30 else 3)]
    assert compared(spark, rows) == plain(rows)


def test_few_and_none(spark):
    assert compared(spark, [(5, [1.0, 2.0, 3.0, 4.0], None)], "double") == plain([(5, [1.0, 2.0, 3.0, 4.0], None)])
    assert compared(spark, []) == ([], None)
    assert compared(spark, [(1, None, 1)]) == ([], None)


def test_bounds_spare_scans():
    rng = np.random.default_rng(1)
    x = np.floor(np.concatenate([rng.normal(c, 5, (100, 4)) for c in (0, 500, 1000)]))
    book, scanned = x[[0, 100, 200]], []
    codes, upper, lower, before = None, np.zeros(300), np.zeros(300), None
    for _ in range(4):
        codes, upper, lower, n = vector_codes.Round(book, before).assign(x, codes, upper, lower)
        assert (codes == vector_codes.distances(x, book).argmin(1)).all()
        scanned.append(n)
        before, book = book, np.array([np.floor(x[codes == k].mean(0)) for k in range(3)])
    assert scanned[0] == 300 and not any(scanned[1:])
