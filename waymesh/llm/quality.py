"""Operator 3: quality rules, and an isolation forest over their statistics.

Each document gets rule statistics (counts over its whole text).  The base
rules reject outright; the rest is judged by an isolation forest: trees of
random splits over the statistics of a sample, where an anomalous document is
isolated by few splits.  The mean path length becomes a score, and the
threshold on it is calibrated over all labelled good rows (the bad ones have no say in it): at most ``max_false`` of
the labelled good documents that pass the base rules score above it.

Bounds: the forest is fitted on at most ``sample_rows`` labelled good documents
and ``contamination`` times as many bad ones, those whose ids have the least
hash.  Statistics, threshold and verdicts cover every document and whole texts.

Memory: a task holds an Arrow batch of texts, or one text if that is longer, with
some 150 bytes for each word of the text at hand.

Defined cases: null or empty text has no words and fails the base rules; a score
at the threshold is kept; ids that repeat are scored row by row; a label counts once an id (the least where
rows disagree, null labels don't count); without labelled good documents the
forest is not fitted and only the base rules decide; columns of other names are
ignored, and kept as they are by ``quality_filter``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_batches, utf8, written

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
#: Continuation bytes of UTF-8: all bytes but these begin a code point.
_CONTINUATION = bytes(range(0x80, 0xC0))

_RATIO_OF = ("n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "n_marks")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    n = len(words)
    if n <= size:  # one window at most
        return 0
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    window = code[: n - size + 1]
    for k in range(1, size):
        _, window = np.unique(window, return_inverse=True) if k > 1 else (None, window)
        window = window * (len(numbers) + 1) + code[k : n - size + 1 + k]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    twin = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    if not twin.any():
        return 0
    at = order[twin]
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[at + k] = True
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The values of ``STATISTICS`` for one text (UTF-8)."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.translate(None, _SPACES)]
    points = len(text) - _count(text, _CONTINUATION)
    return (
        len(words),
        points - _count(text, _SPACES),
        _count(text, _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        _count(text, _UPPER),
        _count(text, _LETTERS),
        _count(text, b"!?"),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on, one row a document: ratios that do not follow a text's length.

    Repetition has a base rule of its own; good documents differ so much in it
    that a forest over it would mostly isolate them.
    """
    words, chars, symbols, upper, letters, marks = (stats[:, STATISTICS.index(c)].astype(float) for c in _RATIO_OF)
    per = lambda a, b: a / np.maximum(b, 1)
    return np.stack([per(chars, words), np.sqrt(per(symbols, words)), per(upper, letters), np.sqrt(per(marks, words))], axis=1)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as flat arrays: split column, split value, left child (right is the next), path length at leaves."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    size: int

    @classmethod
    def fit(cls, x: np.ndarray, *, trees: int, size: int, seed: int) -> "IsolationForest":
        rng = np.random.default_rng(seed)
        size = min(size, len(x))
        depth = int(np.ceil(np.log2(max(size, 2))))
        grown = [cls._grow(x[rng.choice(len(x), size, replace=False)], depth, rng) for _ in range(trees)]
        most = max(len(t) for t in grown)
        column, value, left, length = (np.zeros((trees, most), d) for d in (np.int64, float, np.int64, float))
        for i, nodes in enumerate(grown):
            for k, (c, v, at, path) in enumerate(nodes):
                column[i, k], value[i, k], left[i, k], length[i, k] = c, v, at, path
        return cls(column, value, left, length, size)

    @staticmethod
    def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> list[list]:
        nodes: list[list] = [[0, 0.0, 0, 0.0]]
        work = [(0, x, 0)]
        while work:
            at, rows, level = work.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if level >= depth or len(rows) < 2 or not len(open_columns):
                nodes[at] = [0, np.inf, at, level + float(average_path(len(rows)))]  # a leaf leads to itself
                continue
            c = int(rng.choice(open_columns))
            v = float(rng.uniform(low[c], high[c]))
            side = rows[:, c] < v
            child = len(nodes)
            nodes += [[0, 0.0, 0, 0.0], [0, 0.0, 0, 0.0]]
            nodes[at] = [c, v, child, 0.0]
            work += [(child, rows[side], level + 1), (child + 1, rows[~side], level + 1)]
        return nodes

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the minus mean path length over the average one."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        steps = int(np.ceil(np.log2(max(self.size, 2))))
        for column, value, left, length in zip(self.column, self.value, self.left, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(steps):
                leaf = np.isinf(value[at])
                at = np.where(leaf, at, left[at] + (x[rows, column[at]] >= value[at]))
            total += length[at]
        return 2.0 ** (-total / len(self.column) / max(float(average_path(self.size)), 1e-9))


_SCHEMA = ", ".join(f"{c} long" for c in STATISTICS)


def _batch_statistics(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in utf8(column)], np.int64).reshape(-1, len(STATISTICS))


def with_statistics(docs: DataFrame, *, text: str = "text", prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with their own columns and the rule statistics, in one pass over the texts; no shuffle."""
    at, names = docs.columns.index(text), [prefix + c for c in STATISTICS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _batch_statistics(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, stats.T)], names=[*batch.schema.names, *names])

    return map_batches(docs, work, StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)]))


def statistics_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the rule statistics of every row."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_statistics(source).drop("text")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class QualityModel:
    forest: IsolationForest | None
    threshold: float

    def rejects(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anomaly score and base verdict of each row of statistics."""
        words, repeat = (stats[:, STATISTICS.index(c)] for c in ("n_words", "n_repeat_words"))
        failed = (words < 50) | (100 * repeat > 50 * words)
        score = self.forest.score(features(stats)) if self.forest and len(stats) else np.zeros(len(stats))
        return score, failed


def judge(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``stats`` with base_failed, anomaly and kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([np.asarray(batch.column(c)) for c in STATISTICS], axis=1)
            score, failed = model.rejects(values)
            kept = ~failed & (score <= model.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (failed, score, kept))], names=[*batch.schema.names, "base_failed", "anomaly", "kept"])

    return map_batches(stats, work, f"doc_id long, {_SCHEMA}, base_failed boolean, anomaly double, kept boolean")


def fit(
    stats: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = 8000,
    contamination: float = 0.03,
    max_false: float = 0.003,
    trees: int = 200,
    size: int = 256,
    seed: int = 1,
) -> QualityModel:
    """The forest from a bounded sample of labelled rows, its threshold from all labelled good ones."""
    marked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
    )
    labelled = stats.where(~base_failed()).join(marked, "doc_id")
    take = lambda q, n: np.array(
        [tuple(r) for r in labelled.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), *STATISTICS).limit(n).select(*STATISTICS).collect()],
        np.int64,
    ).reshape(-1, len(STATISTICS))  # at most sample_rows rows of a few numbers
    good = take(1, sample_rows)
    if not len(good):
        return QualityModel(None, np.inf)
    bad = take(0, max(1, int(contamination * len(good))))
    forest = IsolationForest.fit(features(np.concatenate([good, bad])), trees=trees, size=size, seed=seed)
    scored = judge(labelled.where("quality = 1").select("doc_id", *STATISTICS), QualityModel(forest, np.inf))
    threshold = scored.agg(F.percentile_approx("anomaly", 1 - max_false, 100_000)).first()[0]
    return QualityModel(forest, float(threshold))


def _kept(model: QualityModel, names: list[str]) -> Column:
    """The verdict on columns of statistics: only these go to Python, texts stay where they are."""

    @F.arrow_udf("boolean")
    def verdict(*columns: pa.Array) -> pa.Array:
        score, failed = model.rejects(np.stack([np.asarray(c, np.int64) for c in columns], axis=1))
        return pa.array(~failed & (score <= model.threshold))

    return verdict(*(F.col(n) for n in names))


def _prefix(docs: DataFrame) -> str:
    prefix = "stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def quality_filter(docs: DataFrame, model: QualityModel, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a fitted model keeps, with their own columns; no shuffle."""
    prefix = _prefix(docs)
    names = [prefix + c for c in STATISTICS]
    return with_statistics(docs, text=text, prefix=prefix).where(_kept(model, names)).drop(*names)


def fit_and_filter(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", **fitting_options) -> DataFrame:
    """The rows of ``docs`` that a model fitted on them keeps; statistics are made once.

    The rows are written with their statistics, the forest and its threshold come from that table, and so do the rows that stay.
    """
    prefix = _prefix(docs)
    names = [prefix + c for c in STATISTICS]
    counted = written(with_statistics(docs, text=text, prefix=prefix), "statistics")
    stats = counted.select(F.col(key).cast("long").alias("doc_id"), *(F.col(n).alias(c) for n, c in zip(names, STATISTICS, strict=True)))
    return counted.where(_kept(fit(stats, labels, **fitting_options), names)).drop(*names)
