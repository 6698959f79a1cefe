"""Operator 6: benchmark decontamination by winnowed fingerprints.

A window is ``size`` (10) consecutive words of a benchmark item; an item of
fewer words is one window by itself.  Both sides are winnowed: of every ``span``
(6) consecutive hashes of ``gram`` (5) words the least is kept, so any shared
run of gram + span - 1 = 10 words has a fingerprint in common, whatever stands
around it.  Training and test fingerprints are joined, and each hit is extended
to the windows around it, which are compared word by word.  Windows of short
items are fingerprinted whole.

The benchmark's bytes are counted first.  Up to ``block_bytes`` of text its
index is sent to the tasks, and the documents are matched in one pass.  A larger
one stays a table: a bitmap of its fingerprints (``_MAP_BITS`` bits, whatever
its size) goes to the tasks, which put out the fingerprints that it lets pass;
these are joined with the benchmark's, the windows around those that are left are
joined with the benchmark's windows, and rows are put together again.  A
fingerprint or window that many documents hold meets them by broadcast of its row.

Memory: a task holds texts of about a million bytes (one text, if that is longer)
with some 150 bytes for each of their words.

Defined cases: null or empty texts have no words, no hits and no windows; rows
with the same key are matched each for itself (rows equal in key and text give
equal results, one each); an item with a null id is named by the empty text;
repeated item ids are one item with all its windows; equal fingerprints that are
least of a span (ties) are all kept; an empty benchmark leaves
every document clean; other columns are ignored, and kept by ``clean_only``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import salted_join
from .common import HashMemo, hot_join, map_batches, mixed, scratch, unused, utf8, written

SIZE, GRAM, SPAN = 10, 5, 6
#: Keeps digits, letters and all bytes of non-ASCII characters, in lower case; the rest separates words.
_TO_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_FACTORS = mixed(np.arange(1, SIZE + 1, dtype=np.uint64)) | np.uint64(1)
_BITS = 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    n = max(0, len(words) - size + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total += words[j : j + n] * _FACTORS[j]
    return mixed(total)


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Marks each hash that is the least of some ``SPAN`` consecutive ones (ties: all of them)."""
    n = max(0, len(hashes) - SPAN + 1)
    marked = np.zeros(len(hashes), bool)
    if n:
        least = hashes[:n].copy()
        for j in range(1, SPAN):
            np.minimum(least, hashes[j : j + n], out=least)
        for j in range(SPAN):
            marked[j : j + n] |= hashes[j : j + n] == least
    return marked


@dataclass
class Windows:
    """Distinct windows of one length, by hash, with their words and the items that have them."""

    hashes: np.ndarray
    words: np.ndarray
    first: np.ndarray
    items: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, size: int, found: list[tuple[np.ndarray, int]]) -> "Windows":
        words = np.concatenate([w for w, _ in found]).reshape(-1, size)
        item = np.concatenate([np.full(len(w) // size, i) for w, i in found])
        hashes = np.concatenate([grams(w, size) for w in words]) if size > 1 else grams(words[:, 0], 1)
        order = np.lexsort((item, hashes))
        hashes, words, item = hashes[order], words[order], item[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        if (words[1:][~new[1:]] != words[:-1][~new[1:]]).any():
            raise ValueError("two windows have one hash")
        return cls(hashes[new], words[new], np.append(np.flatnonzero(new), len(item)), item, bitmap(hashes))

    def find(self, hashes: np.ndarray, starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts whose window is one of these, compared word by word, and the windows' numbers."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        ok = self.hashes[at] == hashes
        starts, at = starts[ok], at[ok]
        for j in range(self.words.shape[1]):
            same = words[starts + j] == self.words[at, j]
            starts, at = starts[same], at[same]
        return starts, at


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return bits


def _maybe(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]


class BenchmarkIndex:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, rows: list[tuple]):
        memo = HashMemo()
        self.names = sorted({i for i, _ in rows})
        number = {name: k for k, name in enumerate(self.names)}
        prints, by_size = [np.empty(0, np.uint64)], {}
        for item, text in rows:
            words = memo.of(words_of(text.encode()))
            if not len(words):
                continue
            size = min(SIZE, len(words))
            windows = np.lib.stride_tricks.sliding_window_view(words, size).reshape(-1)
            by_size.setdefault(size, []).append((windows, number[item]))
            if size == SIZE:
                g = grams(words, GRAM)
                prints.append(g[winnowed(g)])
        self.prints = np.unique(np.concatenate(prints))
        self.print_bits = bitmap(self.prints)
        self.windows = {size: Windows.of(size, found) for size, found in by_size.items()}

    def hits(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, window numbers) of the windows in the texts put one after another; ``doc`` numbers the words' texts."""
        n = len(words)
        for size, windows in self.windows.items():
            if n < size:
                continue
            if size == SIZE:
                g = grams(words, GRAM)
                hit = np.flatnonzero(winnowed(g) & _maybe(g, self.print_bits))
                at = np.searchsorted(self.prints, g[hit])
                at[at == len(self.prints)] = 0
                hit = hit[self.prints[at] == g[hit]]
                starts = (hit[:, None] - np.arange(SPAN)[None, :]).ravel()
                starts = np.unique(starts[(starts >= 0) & (starts <= n - size)])
                starts = starts[doc[starts] == doc[starts + size - 1]]
                hashes = np.zeros(len(starts), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(size):
                        hashes += words[starts + j] * _FACTORS[j]
                hashes = mixed(hashes)
            else:
                g = grams(words, size)
                starts = np.flatnonzero(_maybe(g, windows.bitmap))
                starts = starts[doc[starts] == doc[starts + size - 1]]
                hashes = g[starts]
            yield size, *windows.find(hashes, starts, words)


def _matched(texts: Iterator[bytes | None], index: BenchmarkIndex, memo: HashMemo) -> list[tuple[int, list, list]]:
    """(words, merged spans of hit words, item names) of each text."""
    split = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(counts)
    words = memo.of([w for own in split for w in own])
    # winnowing also runs over the seams; windows of a text hold no seam, and so keep their fingerprints
    doc = np.repeat(np.arange(len(split)), counts)
    out: list[tuple[int, list, list]] = [(int(c), [], []) for c in counts]
    spans, pairs = [], []
    for size, starts, at in index.hits(words, doc):
        spans.append(np.stack([starts, starts + size], axis=1))
        windows = index.windows[size]
        many = windows.first[at + 1] - windows.first[at]
        begin = np.repeat(windows.first[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
        pairs.append(np.stack([np.repeat(doc[starts], many), windows.items[begin + np.arange(many.sum())]], axis=1))
    if spans and sum(map(len, spans)):
        found = np.concatenate(spans)
        found = found[np.argsort(found[:, 0], kind="stable")]
        reach = np.maximum.accumulate(found[:, 1])
        begin = doc[found[:, 0]]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, 0] > reach[:-1]) | (begin[1:] != begin[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(found)) - 1
        for a, z in zip(found[first, 0].tolist(), reach[last].tolist(), strict=True):
            d = int(doc[a])
            offset = int(ends[d] - counts[d])
            out[d][1].append((a - offset, z - offset))
        for d, item in np.unique(np.concatenate(pairs), axis=0).tolist():
            out[d][2].append(index.names[item])
    return out


_CHUNK_WORDS = 200_000


def _chunks(column: pa.Array) -> Iterator[list[bytes | None]]:
    """Texts in groups of about a million bytes: bounded memory, long arrays."""
    own, size = [], 0
    for text in utf8(column):
        own.append(text)
        size += len(text or b"")
        if size >= 5 * _CHUNK_WORDS:
            yield own
            own, size = [], 0
    if own:
        yield own


def small_index(rows: DataFrame, block_bytes: int) -> BenchmarkIndex | None:
    """The index over (item, text), if their text takes ``block_bytes`` at most (counted before anything is gathered)."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    return BenchmarkIndex([tuple(r) for r in rows.collect()]) if total <= block_bytes else None


_SPANS = "array<struct<start:int,end:int>>"


def _one_block(source: DataFrame, index: BenchmarkIndex) -> DataFrame:
    sent = source.sparkSession.sparkContext.broadcast(index)
    keep = source.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_words long", f"spans {_SPANS}", "items array<string>"])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(batch.num_columns - 1)):
                found = _matched(iter(texts), sent.value, memo)
                spans = [[{"start": a, "end": z} for a, z in s] for _, s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(at, len(texts)).columns[:-1],
                        pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, spans_type),
                        pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                    ],
                    names=[*(f.name for f in keep), "n_words", "spans", "items"],
                )
                at += len(texts)

    return map_batches(source, work, schema)


def covered(spans: Column) -> Column:
    """Words that lie in any of the spans, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["end"]).alias("end"),
        ),
    )["n"]


_MAP_BITS = 1 << 26
_SECOND = mixed(np.arange(101, 101 + SIZE, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each run of ``size`` words, as two arrays."""
    n = max(0, len(words) - size + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total += words[j : j + n] * _SECOND[j]
    return grams(words, size), mixed(total)


def _prints(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts one after another, for windows of one length: their places and hashes."""
    if size == SIZE:
        g = grams(words, GRAM)
        at = np.flatnonzero(winnowed(g))
        return at, g[at]
    g = grams(words, size)
    with np.errstate(over="ignore"):
        return np.arange(len(g)), mixed(g + np.uint64(size))


def _benchmark_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (size, h1, h2, item) and fingerprints (fp, size) of a benchmark of any size."""
    names = ["item", "size", "h1", "h2", "fp"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = memo.of(words_of(text))
                if not len(words):
                    continue
                size = min(SIZE, len(words))
                h1, h2 = window_hashes(words, size)
                fp = np.unique(_prints(words, size)[1])
                n = max(len(h1), len(fp))
                padded = lambda x: pa.array(x.view(np.int64).tolist() + [None] * (n - len(x)), pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([item] * n), pa.array(np.full(n, size, np.int32)), padded(h1), padded(h2), padded(fp)], names=names)

    both = written(map_batches(rows, work, "item string, size int, h1 long, h2 long, fp long"), "benchmark-windows")
    return both.where("h1 is not null").select("size", "h1", "h2", "item").distinct(), both.where("fp is not null").select("size", "fp").distinct()


def _print_map(prints: DataFrame) -> np.ndarray:
    """One bit for each possible head of a fingerprint: ``_MAP_BITS`` of them, gathered in pieces of 4 KB."""
    head = F.shiftrightunsigned("fp", 64 - (_MAP_BITS.bit_length() - 1)) + 1
    pieces = prints.select(F.bitmap_bucket_number(head).alias("piece"), F.bitmap_bit_position(head).alias("at")).groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = np.zeros(_MAP_BITS // 8, np.uint8)
    for r in pieces.collect():  # _MAP_BITS / 32768 rows at most
        bits[(r.piece - 1) * 4096 : r.piece * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - (_MAP_BITS.bit_length() - 1))).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


#: Documents with one window that meet its items in one task.
HOT_BLOCK = 100_000


def _by_tables(held: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """row, n_words, spans, items of every row of the written table ``held`` (row, text); ``rows`` are the benchmark's."""
    windows, prints = _benchmark_tables(rows)
    windows, prints = written(windows, "windows"), written(prints, "prints")
    sizes = sorted(r[0] for r in prints.select("size").distinct().collect())  # SIZE numbers at most
    bits = held.sparkSession.sparkContext.broadcast(_print_map(prints))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            counts, found = [], []
            for value in utf8(batch.column(1)):
                words = memo.of(words_of(value))
                own = [(size, h[_passes(bits.value, h)]) for size in sizes for h in [_prints(words, size)[1]]]
                counts.append(len(words))
                found.append([{"size": size, "fp": x} for size, h in own for x in np.unique(h).view(np.int64).tolist()])
            kind = pa.list_(pa.struct([("size", pa.int32()), ("fp", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["row", "n_words", "prints"])

    source = held.select("row", F.col(text).alias("text"))
    said = written(map_batches(source, told, "row long, n_words long, prints array<struct<size:int,fp:long>>"), "told")
    each = said.select("row", F.explode("prints").alias("print"))
    met = each.groupBy("print").agg(F.count("*").alias("n")).join(prints.select(F.struct("size", "fp").alias("print")), "print")
    hits = hot_join(each, written(met, "met-prints"), "print").groupBy("row").agg(F.collect_set("print").alias("prints"))  # as many as the text has

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            for row, value, own in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = memo.of(words_of(value))
                for size in sorted({p["size"] for p in own}):
                    at, h = _prints(words, size)
                    at = at[np.isin(h.view(np.int64), [p["fp"] for p in own if p["size"] == size])]
                    starts = np.unique((at[:, None] - np.arange(SPAN)[None, :]).ravel()) if size == SIZE else at
                    starts = starts[(starts >= 0) & (starts <= len(words) - size)]
                    h1, h2 = (x[starts].view(np.int64) for x in window_hashes(words, size))
                    for a in range(0, len(starts), 50_000):
                        s = slice(a, a + 50_000)
                        n = len(starts[s])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, row, np.int64)), pa.array(starts[s].astype(np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(h1[s]), pa.array(h2[s])],
                            names=["row", "start", "size", "h1", "h2"],
                        )

    asked = source.join(hits, "row").select("row", "text", "prints")
    near = map_batches(asked, around, "row long, start int, size int, h1 long, h2 long")
    near = written(near.select("row", "start", "size", F.struct("size", "h1", "h2").alias("window")), "near-windows")
    known = windows.select(F.struct("size", "h1", "h2").alias("window")).distinct()
    counted = written(near.groupBy("window").agg(F.count("*").alias("n")).join(known, "window"), "met-windows")
    found = written(hot_join(near, counted, "window"), "found-windows")

    ordered = Window.partitionBy("row").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(ordered))
    spans = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # a row for each document and item that it holds: the result itself
    held_by = windows.select(F.struct("size", "h1", "h2").alias("window"), "item").distinct()
    of_items = salted_join(found.select("row", "window").distinct(), held_by, "window", "row", HOT_BLOCK)
    items = of_items.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = said.select("row", "n_words").join(spans, "row", "left").join(items, "row", "left")
    return out.select("row", "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _benchmark(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))


def match(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", block_bytes: int = 4 << 20
) -> DataFrame:
    """``doc_id``, n_words, spans of hit words (start, end), and items (sorted as texts) of every document."""
    rows = _benchmark(benchmark, item, "text")
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    index = small_index(rows, block_bytes)
    if index is not None:
        return _one_block(source, index)
    with scratch(docs.sparkSession):
        held = written(source.withColumn("row", F.monotonically_increasing_id()), "held", lasting=True)
        found = written(_by_tables(held, rows, "text"), "matched", lasting=True)
    return held.select("row", "doc_id").join(found, "row").drop("row")


def clean_only(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their own columns; no shuffle up to ``block_bytes`` of benchmark."""
    rows = _benchmark(benchmark, item, "text")
    index = small_index(rows, block_bytes)
    if index is None:
        name = unused(docs, "row")
        with scratch(docs.sparkSession):
            held = written(docs.withColumn(name, F.monotonically_increasing_id()), "held", lasting=True)
            found = _by_tables(held.select(F.col(name).alias("row"), F.col(text).alias("text")), rows, "text")
            hit = written(found.where(F.size("spans") > 0).select(F.col("row").alias(name)), "hit", lasting=True)
        return held.join(hit, name, "left_anti").drop(name)
    at, schema = docs.columns.index(text), docs.schema
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            clean = [not s for texts in _chunks(batch.column(at)) for _, s, _ in _matched(iter(texts), sent.value, memo)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_batches(docs, work, schema)
