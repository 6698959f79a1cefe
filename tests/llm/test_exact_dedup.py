"""Operator 12 against plain Python: odd rows, colliding digests, batches and restarts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from waymesh.llm import exact_dedup

SCHEMA = "doc_id long, text string, n int, digest string, file string, row long, body string, keep_id long"
ODD = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, "a b c"), (4, "a b c"), (5, "abc"), (6, "a  b\nc"), (7, "a b  c"), (None, "a\tb\tc\t"), (None, "x"), (8, "é 中\U0001f600"), (9, "é中\U0001f600 "), (10, "A b c"), (11, "a bc"), (12, "word " * 50_000)]


def plain(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    found = []
    for body, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        found += [(str(i), str(best[0]), len(rows), hashlib.sha256(body.encode()).hexdigest()) for i, _ in rows]
    return sorted(found), len(groups)


def stored(spark, texts, path, files=1):
    spark.createDataFrame([(i, t, 1, "d", "f", 2, "b", 3) for i, t in texts], SCHEMA).repartition(files).write.mode("append").parquet(path)


def compared(found):
    rows = found.collect()
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows), sum(r.kept for r in rows)


def weak(bits):
    return lambda body, sha: F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(body), F.lit(1 << bits))), 4, "0"))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak(2), weak(0)])
def test_odd_rows(spark, tmp_path, digest):
    stored(spark, ODD, f"{tmp_path}/t", 3)
    found = exact_dedup.deduplicate(spark, f"{tmp_path}/t", digest=digest, files_a_batch=1, keep=("n", "body"))
    assert found.columns[:2] == ["n", "body"]
    assert compared(found) == plain(ODD)


def test_large_groups_and_collisions(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, "hot text" + " " * (i % 3)) for i in range(1500)] + [(i, f"text {rng.randrange(40)}") for i in range(1500, 2500)]
    rng.shuffle(texts)
    stored(spark, texts, f"{tmp_path}/t", 4)
    for digest in (exact_dedup.sha256, weak(1)):
        assert compared(exact_dedup.deduplicate(spark, f"{tmp_path}/t", digest=digest)) == plain(texts)


def test_state_goes_on(spark, tmp_path):
    path, state = f"{tmp_path}/t", f"file://{tmp_path}/state"
    texts = []
    for part in ([(5, "a b"), (6, "c")], [(3, "ab"), (7, "a  b")], [(4, "a  b"), (8, "c ")]):
        texts += part
        stored(spark, part, path)
        query = exact_dedup.start(spark, path, state)
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == len(part)  # only the new file is read
        assert compared(exact_dedup.resolve(spark, path, exact_dedup.entries(spark, state))) == plain(texts)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/t")
    assert exact_dedup.deduplicate(spark, f"{tmp_path}/t").collect() == []
    with pytest.raises(ValueError):
        exact_dedup.resolve(spark, f"{tmp_path}/t", None, keep=("kept",))
