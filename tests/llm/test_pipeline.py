"""The pipeline: each stage keeps what the one before kept, and its last rows are those documents' ids."""

import hashlib

from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from waymesh.llm import common


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    n = [len(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= before
        before = now
        n.append(len(now))
    assert n[1] < n[0] and n[-1] > n[0] // 3
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(last) == set(texts)
    assert all(last[i].decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i in texts)
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {i: r.ids_sha256 for i, r in last.items()}


def test_odd_rows_and_no_rows(spark):
    """Nulls, empty and very long texts, repeated and null ids, and columns named like those that stages use inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    row = docs.where("doc_id = 1").first().asDict() | {"doc_id": 900_001}
    odd = [row | {"doc_id": None}, row | {"text": None}, row | {"text": ""}, row | {"doc_id": 900_002, "lang": None}, row | {"doc_id": 900_003, "text": " ".join(f"w{i} of" for i in range(40_000))}]
    own = docs.unionByName(spark.createDataFrame([*odd, odd[3]], docs.schema))
    for name in ("logit", "gone", "row", "stat_n_words", "kept"):
        own = own.withColumn(name, F.lit(name))
    n = own.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = common.written(stage(spark, own, SF), name)
        assert own.columns == [*docs.columns, "logit", "gone", "row", "stat_n_words", "kept"] and 0 < own.count() <= n
        n = own.count()
    assert not own.where("coalesce(text, '') = '' or kept <> 'kept'").count()
    last = corpus_pipeline.STAGES[-1][1](spark, own, SF)
    assert last.count() == n
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = common.written(stage(spark, none, SF), name)
        assert none.count() == 0
