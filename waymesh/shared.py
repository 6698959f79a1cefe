"""The folder that driver and executors share, tables written there, and joins whose keys may be hot."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which a join sends them elsewhere than to the key's task, and how many such keys are broadcast.
HOT_ROWS, HOT_KEYS = 500, 1000

#: Bits of the largest sieve (16 MB), and of a piece of it.
SIEVE_BITS, PIECE_BITS = 1 << 27, 1 << 12

#: Bytes of an Arrow batch; a longer row is a batch by itself.
BATCH_BYTES = 2 << 20

#: The folders of each ``scratch`` around, outermost first; of this thread or task alone.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on an Arrow batch to ``BATCH_BYTES``: the tasks of an executor hold a few batches each."""
    found = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not found.rstrip("b").isdigit() or not 0 < int(found.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="waymesh-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str, *, lasting: int = False) -> str:
    """A new path in the shared folder; it goes with the ``scratch`` around it, or if it is ``lasting`` with the one around that (2: the next one)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/waymesh/{name}-{uuid.uuid4().hex}"
    around = _SCRATCH.get()
    around = around[: max(0, len(around) - lasting)]
    if around:
        around[-1].append(path)
    return path


def written(df: DataFrame, name: str, *, lasting: int = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name, lasting=lasting)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end, but for those that are ``lasting``: what is returned must not read the others."""
    own: list[str] = []
    before = _SCRATCH.set((*_SCRATCH.get(), own))
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in own:
            delete(spark, path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` computed once and kept in the shared folder: short lineage, and a lost executor loses nothing.

    A table, as an eager checkpoint would compute ``df`` twice: to count it and to write it.
    """
    return written(df, name)


def hot_join(left: DataFrame, right: DataFrame, key: str, *, n: str = "n", keep_n: bool = False, cut: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose ``key`` is unique and whose ``n`` says how many rows of ``left`` bear it.

    The ``HOT_KEYS`` keys with most rows (``HOT_ROWS`` at least) meet their rows by
    broadcast, where these are: so many narrow rows at most, whatever the data.
    The others are joined by the key, and none of their groups is larger than a
    thousandth of ``left`` or ``HOT_ROWS``.  ``right`` should be a written table.
    """
    out = right if keep_n else right.drop(n)
    top = cut(right.where(F.col(n) >= HOT_ROWS).orderBy(F.desc(n), key).limit(HOT_KEYS), "hot")
    if not top.limit(1).count():
        return left.join(out, key)
    names = F.broadcast(top.select(key))
    cool = left.join(names, key, "left_anti").join(out.join(names, key, "left_anti"), key)
    return left.join(F.broadcast(top if keep_n else top.drop(n)), key).unionByName(cool)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores and some, for work that doesn't follow its bytes: a number, so that few bytes are not put into few tasks."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def salted_join(rows: DataFrame, heads: DataFrame, key: str, by: str, block: int) -> DataFrame:
    """Inner join of ``rows`` with ``heads``, of which a key has several or wide ones, so that none is broadcast.

    The rows of a key are dealt by a hash of ``by`` into parts of about ``block``,
    and its heads are repeated for each part.
    """
    sizes = written(rows.groupBy(key).agg(F.count("*").alias("n")), "key-sizes")
    salts = F.ceil(F.col("n") / block).cast("int")
    left = hot_join(rows, sizes, key, keep_n=True).withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("n")
    right = heads.join(sizes, key).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return left.join(right, [key, "salt"]).drop("salt")


@dataclass(frozen=True)
class Sieve:
    """A bitmap of hashed keys, in pieces of ``PIECE_BITS`` (piece, words); it lets other keys pass now and then, but holds back none of its own."""

    pieces: DataFrame
    bits: int

    @classmethod
    def of(cls, keys: DataFrame, key: str, *, lasting: bool = False) -> "Sieve":
        """64 bits a row of ``keys``, up to ``SIEVE_BITS`` in all, whatever their number."""
        bits = min(SIEVE_BITS, 1 << max(16, (64 * keys.count()).bit_length()))
        words = keys.select(cls._at(F.col(key), bits).alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("word"))
        per = PIECE_BITS // 64
        by_slot = F.map_from_entries(F.collect_list(F.struct(F.col("slot") % per, "word")))
        pieces = words.groupBy(F.floor(F.col("slot") / per).alias("piece")).agg(by_slot.alias("own"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.coalesce(F.get(F.map_values(F.map_filter("own", lambda k, _: k == i)), F.lit(0)), F.lit(0)))
        return cls(written(pieces.select("piece", dense.alias("words")), "sieve", lasting=lasting), bits)

    @staticmethod
    def _at(key: Column, bits: int) -> Column:
        return F.xxhash64(key).bitwiseAND(F.lit(bits - 1))

    def parted(self, df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """``df`` in two, without a shuffle: rows whose key may be one of the sieve's, and rows whose key is none (a null one may be in either)."""
        taken, mark = {c.lower() for c in df.columns}, "_"
        while {mark + "piece", mark + "words"} & taken:
            mark += "_"
        at = self._at(key, self.bits)
        pieces = F.broadcast(self.pieces.select(F.col("piece").alias(mark + "piece"), F.col("words").alias(mark + "words")))
        met = df.join(pieces, F.shiftright(at, PIECE_BITS.bit_length() - 1) == F.col(mark + "piece"), "left")
        word = F.get(F.col(mark + "words"), F.shiftright(at.bitwiseAND(F.lit(PIECE_BITS - 1)), 6).cast("int"))
        may = F.coalesce(F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
        return tuple(met.where(c).drop(mark + "piece", mark + "words") for c in (may, ~may))
