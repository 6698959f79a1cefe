"""Bitmaps of bounded size before joins: they lose no key, and keep wide rows out of the shuffle."""

from pyspark.sql import functions as F

import corpus_pipeline
from waymesh import shared
from waymesh.llm import near_dedup


def test_sieve_holds_back_no_key_of_its_own(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("x").alias("_piece"))
    for most in (1 << 27, 1 << 14):
        monkeypatch.setattr(shared, "SIEVE_BITS", most)
        sieve = shared.Sieve.of(spark.range(0, 20_000, 10).select(F.col("id").alias("k")), "k")
        may, none = sieve.parted(rows, F.col("id"))
        assert sieve.bits <= most and may.columns == none.columns == rows.columns
        assert may.where("id % 10 = 0").count() == 1999 and none.where("id % 10 = 0").count() == 0
        assert may.count() + none.count() == 20_000 and may.count() < (2400 if most > 1 << 20 else 6000)
    may, none = shared.Sieve.of(spark.range(0).select(F.col("id").alias("k")), "k").parted(rows, F.col("id"))
    assert may.count() == 0 and none.count() == 20_000


def test_texts_that_stay_are_not_shuffled(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.md5(F.concat_ws("-", F.greatest("doc_id", F.lit(2)), k))))
    docs = spark.range(300).select(F.when(F.col("id") < 299, F.col("id")).alias("doc_id")).withColumn("text", text)
    kept = near_dedup.drop_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, *range(3, 299)]
    assert kept.where("doc_id is null").count() == 1
    plan = kept._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    assert "Anti" in plan.toString() and "Anti" not in plan.children().head().toString()


def test_sketches_of_sets_that_occur_once_are_not_shuffled(spark):
    digest = F.when(F.col("id") < 4, F.lit("same")).otherwise(F.col("id").cast("string")).cast("binary")
    sketched = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("n_shingles"), digest.alias("digest"))
    classes = sketched.groupBy(F.col("digest").alias("class")).agg(F.min("row_id").alias("node"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
    first = near_dedup._first_of_class(sketched, classes)
    assert sorted(r.row_id for r in first.collect()) == [0, *range(4, 50)]
    assert "Semi" not in first._jdf.queryExecution().optimizedPlan().children().head().toString()


def test_tables_of_a_stage_go_with_it(spark, monkeypatch):
    held = {}

    def stage(name):
        def keep(spark, docs, sf_dir):
            held[name] = shared.scratch_path(spark, name)
            spark.range(3).write.parquet(held[name])
            for before in [k for k in held if k != name]:
                assert not spark._jvm.java.io.File(held[before].removeprefix("file:")).exists()
            return spark.read.parquet(held[name])

        return keep

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n)) for n in ("one", "two", "three")])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 3
