"""Operator 13: product codes of vectors by Hamerly's form of Lloyd's algorithm, in exact integers.

Components become integers floor(1024 * x) and vectors are cut into ``PARTS``
equal consecutive parts.  Each part position has a codebook of up to ``ENTRIES``
entries: first the parts of the rows with the smallest ids, then four times the
floored means of the parts assigned to each entry.

Between rounds a row keeps, for each of its parts, the assigned entry, an upper
bound on the distance to it and one lower bound on the distance to the second
nearest.  After an update the bounds move by how far the entries moved.  While
the upper bound is strictly below the lower bound, or strictly below half the
distance from the entry to its nearest neighbour, the assigned entry is nearer
than all others and nothing is computed.  Else the exact distance to the entry
replaces the upper bound, and only if that fails too are all entries scanned, in
exact integers, ties to the lower index.  Bounds are doubles rounded outward, so
they never decide what integers would decide otherwise.

Scale: each round is one pass over the rows without a shuffle.  Tasks write the
rows with new bounds and one partial sum an entry side by side; partial sums are
added up on Spark, and only the codebooks (their size is fixed by dimension)
reach the driver and are broadcast.  Rounds are written tables in the shared
folder, the last but one is deleted as soon as the next is there.  Errors of
equal labels are pre-aggregated, and labels with many rows meet them by
broadcast.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
components are dropped; so are vectors of another length than that of the row
with the smallest id, as they can't be compared with it; a length that four
doesn't divide is padded with zeros; a null id comes after all others, repeated
ids are rows each for themselves, ordered by their vectors; fewer than 256 rows
make that many entries; null labels are equal to each other; an empty table
gives no rows; other columns are ignored, whatever their names.  Integers too
large for doubles are computed in 64 bits or without bound, as the largest
component needs; sums of more than 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, hot_join, map_batches, scratch, scratch_path, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
_CHUNK = 4096
#: Relative room for the rounding of a bound: some units in the last place for root, sum and conversion.
_ROOM = 4e-15
_STATE = "vec_id long, label {label}, vector array<{item}>, codes binary, bounds binary, error long, part int, entry int, count long, sums array<long>"


def integers(flat: np.ndarray, dtype: type) -> np.ndarray:
    """floor(SCALE * x), exactly: a power of two only moves the exponent; floats from 2^53 on are integers themselves."""
    if dtype is not object:
        return np.floor(flat.astype(np.float64) * SCALE).astype(dtype)
    out = np.empty(flat.shape, object)
    out[...] = [int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE)) for x in flat.astype(np.float64).tolist()]
    return out


def arithmetic(largest: float, width: int) -> type:
    """The number type in which every squared distance and every step to it is exact."""
    bound = 4 * width * (int(largest) * SCALE + SCALE + 1) ** 2
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    return (x * x).sum(1)[:, None] - 2 * x.dot(book.T) + (book * book).sum(1)[None, :]


class Round:
    """One position's codebook, and what the bounds need to know about its change."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None):
        self.book = book
        apart = _roots(distances(book, book)) if len(book) else np.zeros((0, 0))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1, initial=np.inf) * 0.5 * (1 - _ROOM)
        moved = np.zeros(len(book)) if before is None else _roots(((book - before) ** 2).sum(1)) * (1 + _ROOM)
        first = int(moved.argmax())
        rest = np.delete(moved, first).max(initial=0.0)
        self.moved, self.others = moved, np.full(len(book), moved[first])
        self.others[first] = rest

    def assign(self, x: np.ndarray, codes: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes, bounds and how many rows were scanned."""
        if codes is None:
            codes, open_ = np.zeros(len(x), np.uint8), np.arange(len(x))
        else:
            upper = (upper + self.moved[codes]) * (1 + _ROOM)
            lower = lower - self.others[codes] - _ROOM * (lower + self.others[codes])
            safe = np.maximum(lower, self.half[codes])
            open_ = np.flatnonzero(~(upper < safe))
            gap = x[open_] - self.book[codes[open_]]
            upper[open_] = _roots((gap * gap).sum(1)) * (1 + _ROOM)
            open_ = open_[~(upper[open_] < safe[open_])]
        for a in range(0, len(open_), _CHUNK):
            rows = open_[a : a + _CHUNK]
            squares = distances(x[rows], self.book)
            best = squares.argmin(1)  # the first of equals
            at = np.arange(len(rows))
            codes[rows], upper[rows] = best, _roots(squares[at, best]) * (1 + _ROOM)
            squares[at, best] = squares.max(initial=0) + 1
            lower[rows] = _roots(squares.min(1)) * (1 - _ROOM) if squares.shape[1] > 1 else np.inf
        return codes, upper, lower, len(open_)


def _components(batch: pa.RecordBatch, width: int, dtype: type) -> np.ndarray:
    """rows x PARTS x width"""
    vectors = batch.column("vector")
    flat = integers(np.asarray(vectors.flatten()), dtype).reshape(len(vectors), -1)
    padded = np.zeros((len(flat), PARTS * width), flat.dtype)
    padded[:, : flat.shape[1]] = flat
    return padded.reshape(len(flat), PARTS, width)


def _pass(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, dtype: type, *, last: bool, schema: str) -> DataFrame:
    """Rows with new codes and bounds, or with their errors in the ``last`` pass; before that also the task's partial sums."""
    width = books.shape[2]
    sent = rows.sparkSession.sparkContext.broadcast((books, before))  # PARTS codebooks: their size does not follow the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = sent.value
        rounds = [Round(now[p], None if old is None else old[p]) for p in range(PARTS)]
        sums = np.zeros((PARTS, now.shape[1], width), object if dtype is object else np.int64)
        counts = np.zeros((PARTS, now.shape[1]), np.int64)
        out = None
        for batch in batches:
            n, out = batch.num_rows, batch.schema
            if not n:
                continue
            x = _components(batch, width, dtype)
            codes, bounds, error = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS, 2)), np.zeros(n, sums.dtype)
            known = old is not None
            if known:
                codes[:] = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, PARTS)
                bounds[:] = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float64).reshape(n, PARTS, 2)
            for p, r in enumerate(rounds):
                own = x[:, p]
                codes[:, p], bounds[:, p, 0], bounds[:, p, 1], _ = r.assign(own, codes[:, p].copy() if known else None, bounds[:, p, 0].copy(), bounds[:, p, 1].copy())
                if last:
                    gap = own - r.book[codes[:, p]]
                    error += (gap * gap).sum(1).astype(sums.dtype)
                else:
                    np.add.at(sums[p], codes[:, p], own.astype(sums.dtype))
                    counts[p] += np.bincount(codes[:, p], minlength=len(r.book))
            columns = {name: batch.column(name) for name in ("vec_id", "label")}
            if last:
                columns["error"] = pa.array(error.tolist(), pa.int64())
            else:
                columns |= {"vector": batch.column("vector"), "bounds": pa.array([b.tobytes() for b in bounds], pa.binary())}
            columns["codes"] = pa.array([c.tobytes() for c in codes], pa.binary())
            yield _shaped(columns, n, out)
        if out is not None and not last and counts.any():
            part, entry = np.nonzero(counts)
            yield _shaped(
                {
                    "part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "count": pa.array(counts[part, entry]),
                    "sums": pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())),
                }, len(part), out,
            )

    return map_batches(rows, work, schema)


def _shaped(columns: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], names=schema.names)


def _updated(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after an update: floored means, by (part, entry, position); unused entries stay."""
    found = state.where("part is not null").select("part", "entry", "count", F.posexplode("sums").alias("at", "value"))
    out = book.copy()
    for r in found.groupBy("part", "entry", "at").agg(F.sum("value").alias("total"), F.sum("count").alias("n")).collect():  # as many as the codebooks have components
        out[r.part, r.entry, r.at] = r.total // r.n
    return out


def encode(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (a byte a part), error and the error of equal labels for each kept row; and the final codebooks, parts x entries x width."""
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    item = "double" if "double" in kinds[vector] else "float"
    schema = _STATE.format(label=kinds[label], item=item)
    plain = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast(f"array<{item}>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = plain.where("vector is not null and size(vector) > 0").where(~odd)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector"), F.col("label").asc_nulls_last()]
    first = whole.orderBy(*order).select(F.size("vector").alias("n")).first()
    length = first.n if first else 1
    kept = whole.where(F.size("vector") == length)
    width = -(-length // PARTS)
    largest = kept.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    dtype = arithmetic(largest, width)
    heads = pa.Table.from_pylist([{"vector": r.vector} for r in kept.orderBy(*order).limit(ENTRIES).select("vector").collect()], pa.schema([("vector", pa.list_(pa.float64()))]))
    book = np.zeros((PARTS, len(heads), width), dtype)
    if len(heads):
        book[:] = _components(heads.combine_chunks().to_batches()[0], width, dtype).transpose(1, 0, 2)
    if not len(heads):
        none = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("error", "long"), ("label_error", "long"))]
        return kept.select("vec_id", "label", *none), book
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {c.split(" ", 1)[0]: c.split(" ", 1)[1] for c in schema.split(", ")}
    with scratch(spark):
        state, before, gone = kept.select(*(F.col(c) if c in kept.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names)), None, None
        for _ in range(rounds):
            path = scratch_path(spark, "codes")
            _pass(state.where("part is null"), book, before, dtype, last=False, schema=schema).write.parquet(path)
            state = spark.read.schema(state.schema).parquet(path)
            if gone:
                delete(spark, gone)
            before, book, gone = book, _updated(state, book), path
        coded = written(_pass(state.where("part is null"), book, before, dtype, last=True, schema=schema).select("vec_id", "label", "codes", "error"), "coded")
        same = F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("of"))
        by_label = written(coded.select(same.alias("same"), "error").groupBy("same").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
        joined = hot_join(coded.withColumn("same", same), by_label, "same").select("vec_id", "label", "codes", "error", "label_error")
        return written(joined, "vector-codes", lasting=True), book


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()
