"""Operator 9: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams, hashed to ``BUCKETS``:
the share of a bucket among the text's n-grams (and a few more, so that short texts
stay uncertain), times the logarithm of how few
training documents have it.  Letters are lower-cased, whatever is no letter is
a blank.  Weights are learned by follow-the-regularised-leader with L1 and L2
penalties, one document at a time; a slice of the sample that is not learned
from sets the temperature of the softmax.

Bounds: the regression is fitted on at most ``sample_rows`` training rows (one a
language if there are more languages), as many of each language as far as there
are any, and on at most ``sample_bytes`` of their text, which languages share
equally.  A language's rows are those whose ids have the least hash; a text
that its share has no room for is skipped.  A language whose texts all exceed
the equal share is given room for its smallest; if there is none for each
language, fitting is an error.  Document counts for the IDF come from every
training row and predictions cover every row, always over whole texts.

Defined cases: null text or text without a letter is ``und`` with score 0, as is
every text if there is nothing to learn from; rows with null language are not
learned from; ids that repeat are predicted row by row, and of their rows of one
language and length the sample has the greatest text; of equal probabilities the
first language by name is taken; other columns are ignored.

Memory: a text is held whole with some 30 bytes for each of its characters; its
n-grams are made a piece of ``PIECE`` characters at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_shares, crc_split, fitting, map_batches, small_table, utf8, written

BITS, ORDERS = 17, (1, 2, 3)
BUCKETS = 1 << BITS
_SCALE = 100.0
#: Added to a text's number of n-grams, so that a few letters decide little.
_FEW = 60
#: Characters of a text that are in memory as n-grams at once.
PIECE = 1 << 18
_LETTER = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def letters_of(text: bytes | None) -> np.ndarray:
    """Code points of the text in lower case, blanks for what is no letter, one blank around; empty without a letter."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.decode().lower().encode("utf-32-le"), np.uint32)
    is_letter = _LETTER[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        is_letter[far] = [chr(c).isalpha() for c in points[far].tolist()]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    out = np.full(len(points) + 2, 32, np.uint64)
    out[1:-1] = np.where(is_letter, points, 32)
    return out


def buckets_of(points: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams, in pieces of the caller."""
    found = []
    with np.errstate(over="ignore"):
        for order in ORDERS:
            n = len(points) - order + 1
            if n > 0:
                h = points[:n] * _FACTORS[0]
                for k in range(1, order):
                    h = (h ^ (h >> np.uint64(29))) * _FACTORS[k] + points[k : k + n]
                h = (h + np.uint64(order)) * _FACTORS[0]
                found.append(((h ^ (h >> np.uint64(31))) * _FACTORS[1] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, a piece at a time; n-grams across the cuts belong to the earlier piece."""
    for a in range(0, len(points), PIECE):
        part = points[a : a + PIECE + max(ORDERS) - 1]
        if a + PIECE >= len(points):
            yield buckets_of(part)
        else:
            with_tail = [buckets_of_order(part, order, PIECE) for order in ORDERS]
            yield np.concatenate(with_tail)


def buckets_of_order(points: np.ndarray, order: int, n: int) -> np.ndarray:
    """The first ``n`` n-grams of one order."""
    at = sum(max(0, len(points) - k + 1) for k in ORDERS if k < order)
    return buckets_of(points)[at : at + n]


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # by bucket and language, times the IDF
    shift: np.ndarray
    temperature: float = 1.0

    def logits(self, points: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for found in pieces(points):
            total += self.weights[found].sum(axis=0, dtype=float)
            n += len(found)
        return total * (_SCALE / (n + _FEW)) + self.shift

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """The language and its probability, ``und`` and 0 without a letter."""
        langs, scores = [], []
        for text in texts:
            points = letters_of(text)
            if not len(points) or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            p = softmax(self.logits(points) / self.temperature)
            best = int(np.argmax(p))
            langs.append(self.langs[best])
            scores.append(float(p[best]))
        return langs, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sparse(points: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their TF-IDF weights."""
    found, counts = np.unique(np.concatenate(list(pieces(points))), return_counts=True)
    return found.astype(np.int32), (counts * (_SCALE / (counts.sum() + _FEW)) * idf[found]).astype(np.float32)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, *,
    epochs: int = 2, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 9,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket x class) and shifts by FTRL-proximal."""
    z = np.zeros((BUCKETS + 1, classes))  # the last row is the shift, which has no penalty
    n = np.zeros((BUCKETS + 1, classes))

    def weight(at: np.ndarray) -> np.ndarray:
        free = np.where(at == BUCKETS, 0.0, 1.0)[:, None]
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1 * free, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2 * free)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at = np.append(rows[r][0], BUCKETS).astype(np.int64)
            x = np.append(rows[r][1], 1.0)
            w = weight(at)
            p = softmax(x @ w)
            p[y[r]] -= 1
            g = x[:, None] * p
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = weight(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 241))  # a slice without errors must not make it certain
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_counts(docs: DataFrame, *, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and how many rows have any: sums of fixed size over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        total = np.zeros(BUCKETS + 1, np.int64)
        k = 0
        for batch in batches:
            for value in utf8(batch.column(0)):
                points = letters_of(value)
                if not len(points):
                    continue
                k += 1
                for found in pieces(points):
                    seen[found] = k
                total[:-1] += seen == k
                total[-1] += 1
        at = np.flatnonzero(total)
        for a in range(0, len(at), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 8192]), pa.array(total[at[a : a + 8192]])], names=["bucket", "n"])

    # BUCKETS + 1 rows at most
    rows = map_batches(docs.select(F.col(text).alias("text")), work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts[:-1], int(counts[-1])


def fit(
    docs: DataFrame, *, held_out: tuple[int, int] | None = (5, 0), sample_rows: int = 4000, sample_bytes: int = 24 << 20,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> LanguageModel:
    """The model from the rows with a language outside the held-out fold."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    own = own.where("lang is not null and text is not null")
    if held_out:
        own = own.where(crc_split("doc_id", held_out[0]) != held_out[1])
    df, n = document_counts(own)
    if not n:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    idf = np.log((1 + n) / (1 + df)) + 1
    # as many rows and bytes of each language, in its own order of hashes; equal rows of an id count once
    lettered = own.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.octet_length("text").alias("size"))
    sized = written(lettered.groupBy("doc_id", "lang", "size").agg(F.xxhash64("doc_id").alias("h")), "language-rows")
    least = {r.lang: r.size for r in sized.groupBy("lang").agg(F.min("size").alias("size")).collect()}
    if not least:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    shares = byte_shares(least, sample_bytes)
    each = max(1, sample_rows // len(shares))
    room = small_table(docs.sparkSession, {"lang": (list(shares), pa.string()), "room": (list(shares.values()), pa.int64())})
    ranked = sized.join(F.broadcast(room), "lang").where("size <= room").withColumn("salt", F.xxhash64("doc_id", "size") % 64)
    # the first of each part of a language, then of the language
    for parts in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy("h", "doc_id", "size"))).where(F.col("rank") <= each)
    of: dict[str, list] = {}
    for r in ranked.orderBy("lang", "rank").select("lang", "doc_id", "size").collect():
        of.setdefault(r.lang, []).append(r)
    picked = [(r.doc_id, lang, r.size) for lang, rows in of.items() for r in fitting(rows, shares[lang])]
    ids, names, sizes = (list(c) for c in zip(*picked, strict=True)) if picked else ([], [], [])
    sample = small_table(docs.sparkSession, {"id": (ids, pa.int64()), "name": (names, pa.string()), "bytes": (sizes, pa.int32())})
    # sample_rows rows, or one a language: a proven bound
    met = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("name")) & (F.octet_length("text") == F.col("bytes"))
    told = own.join(F.broadcast(sample), met).groupBy("doc_id", "lang", "bytes").agg(F.max("text").alias("text"))
    rows = told.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "bytes").collect()
    rows = [(r.lang, p) for r in rows if len(p := letters_of(r.text.encode()))]
    names = sorted({name for name, _ in rows})
    x = [sparse(p, idf) for _, p in rows]
    y = np.array([names.index(name) for name, _ in rows], np.int64)
    # the fifth, tenth, ... of each language set the temperature, so every language is learned
    met_before: Counter = Counter()
    kept = np.ones(len(rows), bool)
    for i, (name, _) in enumerate(rows):
        met_before[name] += 1
        kept[i] = met_before[name] % 5 != 0
    if len(names) < 2:
        return LanguageModel(names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names)))
    learn = np.flatnonzero(kept)
    w, shift = train([x[i] for i in learn], y[learn], len(names))
    logits = np.array([v @ w[at] + shift for at, v in (x[i] for i in np.flatnonzero(~kept))])
    return LanguageModel(names, (w * idf[:, None]).astype(np.float32), shift, best_temperature(logits, y[~kept]))


def predict(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = sent.value.predict(list(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(source, work, "doc_id long, lang_pred string, score double")
