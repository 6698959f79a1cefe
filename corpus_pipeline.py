"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet and rereads it as the next one's docs.  Stages fit what they need
(forest, network, thresholds) on the documents that their predecessor kept.

1. quality: documents that the base rules or the isolation forest reject go.
2. toxicity: documents at or above their language's threshold go.
3. near-dedup: of each group of near copies (five-word shingles, similarity of
   0.8 or more) the one with the least id stays.
4. decontaminate: documents with any window of a benchmark item go.
5. encode: byte-level BPE; returns the digests of ids and decoded bytes.

Defined cases: rows with null or empty text fail the quality rules, whatever
their id; rows of one id are judged each for itself, and near-dedup keeps or
drops them together; a row with a null id is never a copy; columns besides those
of documents stay with their rows up to the last stage, whatever their names; no
rows give no rows.  Documents without both toxicity labels among the training
rows are an error, as nothing could be filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymesh.llm import decontaminate, near_dedup, quality, toxicity
from waymesh.llm.common import scratch, table, written
from waymesh.llm.queries import bpe_digests


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.fit_and_filter(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_filter(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_duplicates(docs, near_dedup.Plan(shingle=5))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]

#: The forest, the network and the token ids are not expressible in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):  # a stage's own tables, some with all texts, go when its result is written
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}", lasting=1 + (name == STAGES[-1][0]))
    return docs
