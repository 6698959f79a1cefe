"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import BATCH_BYTES, Sieve, bounded_batches, delete, hot_join, scratch, scratch_path, written  # noqa: F401  (operators take them from here)

#: Entries that a worker's memo of words holds before it is emptied.
MEMO_ENTRIES = 400_000
#: Hashes are made faster than a large memo is searched.
HASH_MEMO_ENTRIES = 120_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Freed memory back to the system: workers outlive their tasks, and an executor holds several."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: What this worker process keeps from task to task: at most one value, (name, key, value).
_KEPT: list[tuple[str, object, object]] = []


def kept(name: str, key: object, make: Callable[[], object]):
    """The value of ``make``, kept by the worker for its next tasks of the same name and key."""
    if not _KEPT or _KEPT[0][:2] != (name, key):
        _KEPT.clear()
        _KEPT.append((name, key, make()))
    return _KEPT[0][2]


def map_batches(
    df: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    *,
    keeps: str | None = None,
) -> DataFrame:
    """``mapInArrow`` over batches of bounded size; a worker gives back what a task has freed.

    Workers outlive their tasks: what other operators left in one (``kept``) goes
    when a task begins that doesn't name it with ``keeps``.
    """
    bounded_batches(df.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _KEPT and _KEPT[0][0] != keeps:
            _KEPT.clear()
            give_back()
        yield from work(batches)
        give_back()

    return df.mapInArrow(bounded, schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as UTF-8 bytes, null as None, without Python strings between."""
    if pa.types.is_null(column.type):
        yield from [None] * len(column)
        return
    yield from column.cast(pa.binary()).to_pylist()


def small_table(spark: SparkSession, columns: dict[str, tuple[list, pa.DataType]]) -> DataFrame:
    """A table from values of the driver (name -> values and type), sent as Arrow: no Python worker reads it."""
    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()}))


def crc_split(column: str, mod: int):
    """crc32 of a column written as text, modulo ``mod``: the folds of the contracts (null ids: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def byte_shares(least: dict, total: int) -> dict:
    """``total`` bytes dealt to classes in equal shares, but to each no less than its smallest text (``least``) takes."""
    if sum(least.values()) > total:
        raise ValueError(f"a sample of {total} bytes has no room for a text of each of {len(least)} classes; smallest texts: {dict(sorted(least.items(), key=lambda x: -x[1])[:10])}")
    shares, left = {}, total
    for name in sorted(least, key=lambda k: (-least[k], k)):
        shares[name] = max(least[name], left // (len(least) - len(shares)))
        left -= shares[name]
    return shares


def fitting(rows: list, share: int) -> list:
    """Of ``rows`` in their order those that ``share`` has room for; one that doesn't fit is skipped."""
    found = []
    for r in rows:
        if r.size <= share:
            found.append(r)
            share -= r.size
    return found


class HashMemo(dict):
    """Word (bytes) -> 64-bit hash, remembered up to ``HASH_MEMO_ENTRIES`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_MEMO_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        near = {w: self[w] for w in set(words)}  # small: most look-ups are of words met in the same texts
        return np.fromiter(map(near.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
