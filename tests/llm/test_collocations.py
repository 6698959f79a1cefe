"""Operator 11 against plain Python: counts, cuts, containment, ranks."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, piece string, size int"


def plain(docs, longest=3, least=10, inside=50, first=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, p), a in cand.items():
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (g, q), b in cand.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * b >= inside * a for b in longer):
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, rows in found.items():
        n = sum(c for (g, p), c in f.items() if g == lang and len(p) == 1)
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, g, 1, "p", "q", 2) for i, (t, g) in enumerate(docs)], SCHEMA)


def corpus(seed, n, lang):
    rng = random.Random(seed)
    words = ["New", "york", "ÉTÉ", "a", "b", "c", "of", "the", "中文", "x-1", "it's", "Ä"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!\r\n"]) for _ in range(rng.randrange(60))), lang) for _ in range(n)]


ODD = [(None, "en"), ("", None), ("., ;\n", "en"), ("same words here. " * 15, None), ("same words here. " * 15, None), ("x y z " * 4000, "de"), ("a a a a a a a a a a a a a", "fr")]


@pytest.mark.parametrize("longest,least,inside,first", [(3, 10, 50, 2000), (4, 3, 80, 20), (2, 2, 50, 5)])
def test_against_plain(spark, monkeypatch, longest, least, inside, first):
    docs = ODD + corpus(1, 150, "en") + corpus(2, 60, None)
    monkeypatch.setattr(collocations, "RANKED_ROWS", 30)
    found = collocations.mine(frame(spark, docs), longest=longest, least=least, inside=inside, first=first, buckets=5)
    assert sorted(tuple(r) for r in found.collect()) == plain(docs, longest, least, inside, first)


def test_empty(spark):
    assert collocations.mine(frame(spark, []).limit(0)).collect() == []
    assert collocations.mine(frame(spark, [(None, None), ("a b", "en")])).collect() == []


def test_pieces_have_multiplicities(spark):
    found = collocations.pieces(frame(spark, [("One  two.\tone TWO, three", "en"), ("one two", "en"), ("one two", None)]))
    assert sorted(tuple(r) for r in found.collect()) == [("en", "one two", 3), ("en", "three", 1), ("und", "one two", 1)]


def test_chunks_and_spilling(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 1 << 10)
    monkeypatch.setattr(collocations, "MEMORY", "40MB")
    rng = random.Random(7)
    docs = [(" ".join(str(rng.randrange(10**6)) for _ in range(20_000)), "en") for _ in range(20)] + [("often said " * 30, "en")]
    found = collocations.counted(collocations.pieces(frame(spark, docs)).coalesce(1), 2, least=2, buckets=1)
    want = Counter()
    for text, _ in docs:
        w = text.split()
        want.update(" ".join(w[i : i + 2]) for i in range(len(w) - 1))
    assert {r.phrase: r.f for r in found.collect()} == {p: c for p, c in want.items() if c > 1}


def test_bitmap_has_what_is_frequent(spark):
    docs = corpus(9, 80, "en") + ODD + [(" ".join(f"rare{i}" for i in range(200)), "en")]
    found = collocations.pieces(frame(spark, docs))
    counts = collocations.counted(found, 2, least=3, buckets=2)
    bits = collocations.frequent_bits(counts, 2)
    every = pa.Table.from_pylist([r.asDict() for r in found.collect()])
    phrases, hashes = collocations._phrases(every, 2, None)
    known = {(r.lang, r.phrase) for r in counts.collect()}
    told = collocations._has(bits, hashes)
    assert all(t for t, r in zip(told, phrases.to_pylist()) if (r["lang"], r["phrase"]) in known) and not told.all() and known


def test_scores_beyond_64_bits(spark):
    rng = random.Random(3)
    rows = [(a, a + rng.randrange(10**12), a + rng.randrange(10**12)) for a in (rng.randrange(1, 10 ** rng.randrange(1, 16)) for _ in range(200))]
    rows += [(10**15, 10**15, 10**15), (3, 7, 3)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.score_of(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a**2 // (r.l * r.r) for r in got)
