"""Operator 12: stateful streaming deduplication of equal texts, in DataFrame operations only.

Texts are equal when they are identical once spaces, tabs and line breaks are
deleted.  A file stream reads the table; an aggregation keyed by the SHA-256 of
the normalised text keeps, on disk (RocksDB) and without expiry, one entry a
digest: how many rows bear it, and of the row that stays its length, its id and
a content locator (file and row number in it).  A later row of more code points,
or of as many and a smaller id, replaces what the entry retains.  A stream that
is started again on the same folder reads only new files.

A row whose digest is already there is a hit, and on hits full bytes are
compared: ``resolve`` reads the table by locator, and each hit meets the retained
row's normalised text.  Rows that differ in spite of the digest form groups by
their text itself, so a result never rests on the digest alone.

Scale: only entries (some 200 bytes a distinct text) are state; map-side partial
sums take a hot digest's rows before they are shuffled.  Rows meet their entries
in a shuffled join whose large partitions Spark may split (AQE); in the check of
bytes a group is dealt to blocks of ``BLOCK_ROWS`` rows, each with a copy of the
retained text.  Texts that occur once are never compared.

Defined cases: null text is an empty text, and equal to one of spaces only; rows
of one id are rows each for themselves; a null id stays only if no row of as many
code points has one; among rows of equal length and id the last by file and row
stays; an empty table gives no rows; columns other than id and text are not
read unless ``keep`` names them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .common import scratch, scratch_path, written

#: What is deleted from a text before it is compared: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Hits that meet one copy of the retained text.
BLOCK_ROWS = 256

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store takes four megabytes of disk at once
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}

Digest = Callable[[Column, Column], Column]


def sha256(body: Column, sha: Column) -> Column:
    """The 32 bytes of the SHA-256 that every row has anyway."""
    return F.unhex(sha)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(docs: DataFrame, *, key: str, text: str, digest: Digest = sha256, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id, normalised text, digests, length and locator; ``docs`` is read from files, once or as a stream."""
    named = docs.select(
        *(F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)),
        F.col(key).alias("doc_id"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars"),
        F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "").alias("body"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    summed = named.withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
    return summed.withColumn("digest", digest(F.col("body"), F.col("text_sha256")))


def _best() -> Column:
    """Greatest for the row that stays: most code points, then the smallest id (its complement the greatest; null is least)."""
    return F.max(F.struct("n_chars", F.bitwise_not(F.col("doc_id").cast("long")).alias("turned"), "file", "row")).alias("best")


def start(
    spark: SparkSession, path: str, state: str, *, key: str = "doc_id", text: str = "text", digest: Digest = sha256, files_a_batch: int = 4096
) -> StreamingQuery:
    """Starts the stream over the Parquet files at ``path`` that ``state`` has not seen; it ends when all there are have been read.

    The folder ``state`` must be shared.  It fixes the number of state partitions
    to the ``spark.sql.shuffle.partitions`` of its first start.
    """
    schema = spark.read.parquet(path).schema
    found = f"{path[:-1]}[{path[-1]}]"  # as a pattern it may name one file, not only a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(found)
    entries = rows_of(stream, key=key, text=text, digest=digest).groupBy("digest").agg(F.count("*").alias("n"), _best())
    with _settings(spark, _STATE):
        return entries.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()


def entries(spark: SparkSession, state: str) -> DataFrame:
    """What the state retains: digest, number of rows, and of the row that stays its id and locator."""
    with _settings(spark, _STATE):
        stored = spark.read.format("statestore").load(state)
    best = F.col("value.max")
    return stored.select(
        F.col("key.digest").alias("digest"),
        F.col("value.count").alias("n"),
        F.bitwise_not(best["turned"]).alias("keep_id"),
        best["file"].alias("keep_file"),
        best["row"].alias("keep_row"),
    )


def _differing(members: DataFrame) -> DataFrame:
    """Hits whose normalised text is not, byte for byte, that of the row their digest's entry retains."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("long")
    retained = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    shared = members.where("n > 1")
    reps = shared.where(retained).select("digest", F.col("body").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    hits = shared.where(~retained).withColumn("block", F.pmod(F.xxhash64("file", "row"), blocks))
    return hits.join(reps, ["digest", "block"]).where(F.col("body").cast("binary") != F.col("rep").cast("binary")).drop("block", "rep")


def resolve(
    spark: SparkSession, path: str, found: DataFrame, *, key: str = "doc_id", text: str = "text", digest: Digest = sha256, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and ``keep`` of every row, after the hits' full bytes are checked."""
    if clash := set(keep) & {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}:
        raise ValueError(f"the result has columns of its own of these names: {sorted(clash)}")
    own = [f"keep_{k}" for k in range(len(keep))]
    rows = rows_of(spark.read.parquet(path), key=key, text=text, digest=digest, keep=keep)
    members = written(rows.join(found, "digest").withColumn("body", F.when(F.col("n") > 1, F.col("body"))), "members")
    differing = written(_differing(members), "differing")
    if differing.limit(1).count():  # texts that share a digest: by the text itself
        others = differing.groupBy("digest", "body").agg(F.count("*").alias("n"), _best())
        best = F.col("best")
        regrouped = differing.drop("n", "keep_id", "keep_file", "keep_row").join(
            others.select("digest", "body", "n", F.bitwise_not(best["turned"]).alias("keep_id"), best["file"].alias("keep_file"), best["row"].alias("keep_row")), ["digest", "body"]
        )
        gone = differing.groupBy("digest").agg(F.count("*").alias("gone"))
        equal = members.join(differing.select("file", "row"), ["file", "row"], "left_anti").join(gone, "digest", "left")
        members = equal.withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).drop("gone").unionByName(regrouped)
    return members.select(
        *(F.col(n).alias(c) for n, c in zip(own, keep, strict=True)),
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def deduplicate(spark: SparkSession, path: str, *, key: str = "doc_id", text: str = "text", digest: Digest = sha256, keep: tuple[str, ...] = (), files_a_batch: int = 4096) -> DataFrame:
    """Streams the whole table at ``path`` through a new state and resolves every row of it."""
    with scratch(spark):
        state = scratch_path(spark, "digests")
        start(spark, path, state, key=key, text=text, digest=digest, files_a_batch=files_a_batch).awaitTermination()
        found = written(entries(spark, state), "entries")
        return written(resolve(spark, path, found, key=key, text=text, digest=digest, keep=keep), "deduplicated", lasting=True)
