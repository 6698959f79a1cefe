"""Operator 7: a convolutional text classifier for toxicity.

A word is the sum of hashed embeddings of the word and of its prefixes, so
inflected forms share what they begin with.  Filters of several widths run over
the words; the greatest value of each filter over the whole text feeds a
logistic output.  All of it is trained here in numpy (Adam; the gradient passes
only through the greatest positions).

Thresholds are calibrated on the scores of all labelled training rows: one for
each language and one over all.  The score is mapped so that the overall one
lies at ``cut`` (0.3), monotonically and without a look at the language; the
verdict ``toxic`` compares the score with the threshold of the row's language.

Bounds: the network is fitted on at most ``sample_rows`` labelled rows (half of
each label as far as there are any), those whose ids have the least hash, and
on at most ``sample_bytes`` of their text.  Labels share the bytes equally, a
text that its label's share has no room for is skipped, and a label whose texts
all exceed it is given room for its smallest; if there is none for each label,
fitting is an error.  Scores, thresholds and verdicts
cover every document and whole texts.

Memory: a text is held whole with some 60 bytes for each of its words; their
vectors are made for pieces of ``PIECE`` words, which overlap.

Defined cases: null or empty text has no words and gets the score of none; ids
that repeat are scored row by row, and the network learns from the greatest of
their texts; a label counts once an id (the greatest where rows disagree, null
labels don't count); a score at the threshold is toxic; equal F1 takes the
greater threshold; without both labels in the
training rows every score is 0, and ``toxicity_filter`` raises an error unless
there are no rows at all; a language without labelled rows of both kinds
uses the overall threshold; columns of other names are ignored, and kept by
``toxicity_filter``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import MEMO_ENTRIES, byte_shares, crc_split, fitting, give_back, map_batches, scratch, small_table, unused, utf8, written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7)
#: Words of a text that are in memory at once.
PIECE = 1 << 15
_PAD = max(WIDTHS) - 1
#: ASCII letters and all bytes of other characters; the rest separates words.
_TO_WORDS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").decode().lower().encode().translate(_TO_WORDS).split() if text else []


def buckets_of(word: bytes) -> list[int]:
    """The embedding rows of a word: itself and its prefixes of ``PREFIXES`` characters."""
    letters = word.decode()
    parts = [b"=" + word, *(b"<" + letters[:k].encode() for k in PREFIXES if len(letters) >= k)]
    found = [1 + xxhash.xxh3_64_intdigest(p) % (BUCKETS - 1) for p in parts]
    return found + [0] * (1 + len(PREFIXES) - len(found))


@dataclass
class ConvNet:
    """Embeddings, filters by width and the output layer; bucket 0 is always nought."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int) -> "ConvNet":
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        table[0] = 0
        filters = [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        return cls(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out)

    def pooled(self, x: np.ndarray, starts: np.ndarray, real: np.ndarray, where: bool = False):
        """Greatest value of each filter from each start to the next; rows of ``x`` that are padding are not ``real`` starts."""
        values, at = [], []
        for w, weight, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = len(x) - _PAD
            h = x[:n] @ weight[:DIM]
            for k in range(1, w):
                h += x[k : n + k] @ weight[k * DIM : (k + 1) * DIM]
            h += bias
            h[~real[:n]] = -np.inf
            values.append(np.maximum.reduceat(h, starts, axis=0))
            if where:
                ends = np.append(starts[1:], n)
                at.append(np.stack([a + h[a:z].argmax(axis=0) for a, z in zip(starts, ends, strict=True)]))
        return np.concatenate(values, axis=1), at


def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the texts one after another, each followed by padding (-1); starts; which rows are starts of windows."""
    starts = np.concatenate(([0], np.cumsum([len(d) + _PAD for d in docs]))).astype(np.int64)
    ids = np.full(starts[-1] + _PAD, -1, np.int64)
    for a, d in zip(starts, docs, strict=False):
        ids[a : a + len(d)] = d
    real = ids >= 0
    real[starts[:-1]] = True  # an empty text has the window of padding alone
    return ids, starts[:-1], real


def train(texts: Iterable[bytes | None], labels: Sequence[int], *, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ConvNet:
    """Logistic loss with both labels weighing the same; Adam, on the embedding rows of the greatest positions only."""
    net = ConvNet.fresh(seed)
    number: dict[bytes, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
    buckets = np.zeros((len(number) + 1, 1 + len(PREFIXES)), np.int32)  # the last row stays nought: padding
    for k, w in enumerate(number):
        buckets[k] = buckets_of(w)
    del number
    labels = np.asarray(labels, np.float32)
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(np.float32)
    rng = np.random.default_rng(seed)
    dense = [*net.filters, *net.bias, net.out]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    row_second = np.zeros(BUCKETS, np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        lr = rate * (1 - epoch / epochs)
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            ids, starts, real = _laid_out([docs[r] for r in rows])
            used, inverse = np.unique(ids, return_inverse=True)
            x = net.table[buckets[used]].sum(axis=1)[inverse]
            pooled, at = net.pooled(x, starts, real, where=True)
            active = np.maximum(pooled, 0)
            drop = (rng.random(active.shape) > 0.2) / np.float32(0.8)
            logit = (active * drop) @ net.out + net.shift
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
            back = (error[:, None] * net.out * drop) * (pooled > 0)
            grads_w, grads_b, x_grad_rows, x_grads = [], [], [], []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                window = at[k][:, :, None] + np.arange(w)
                seen = x[window].reshape(len(rows), FILTERS, w * DIM)
                grads_w.append(np.einsum("bf,bfd->df", g, seen))
                grads_b.append(g.sum(axis=0))
                x_grad_rows.append(window.ravel())
                x_grads.append((g[:, :, None] * net.filters[k].T[None]).reshape(-1, DIM))
            grads = [*grads_w, *grads_b, ((active * drop) * error[:, None]).sum(axis=0)]
            step += 1
            for p, g, m, v in zip(dense, grads, first, second, strict=True):
                g = g + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.shift -= lr * float(error.sum())
            touched = buckets[ids[np.concatenate(x_grad_rows)]]
            flat = touched.ravel()
            grad = np.repeat(np.concatenate(x_grads), touched.shape[1], axis=0)
            keep = (flat > 0) & (np.abs(grad).sum(axis=1) > 0)
            rows_hit, place = np.unique(flat[keep], return_inverse=True)
            total = np.zeros((len(rows_hit), DIM), np.float32)
            np.add.at(total, place, grad[keep])
            row_second[rows_hit] += (total * total).mean(axis=1)
            net.table[rows_hit] -= 0.1 * (1 - epoch / epochs) * total / (np.sqrt(row_second[rows_hit])[:, None] + 1e-6)
    return net


class Scorer:
    """Logits of whole texts; word vectors are remembered up to ``MEMO_ENTRIES`` words."""

    def __init__(self, net: ConvNet):
        self.net = net
        self._empty()

    def _empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.vectors = np.zeros((1024, DIM), np.float32)  # the last row stays nought: padding

    def _learn(self, words: set[bytes]) -> None:
        base = len(self.number)
        new = list(words)
        while base + len(new) + 1 > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.number.update(zip(new, range(base, base + len(new)), strict=True))
        for a in range(0, len(new), 4096):
            part = np.array([buckets_of(w) for w in new[a : a + 4096]], np.int64)
            self.vectors[base + a : base + a + len(part)] = self.net.table[part].sum(axis=1)

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.number) > MEMO_ENTRIES // 2:
            self._empty()
        new = {w for words in split for w in words if w not in self.number}
        if new:
            self._learn(new)
        pooled = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        own: list[np.ndarray] = []
        owner: list[int] = []
        size = 0
        get = self.number.__getitem__
        for i, words in enumerate(split):
            ids = np.fromiter(map(get, words), np.int64, len(words))
            for a in range(0, max(1, len(ids)), PIECE):
                own.append(ids[a : a + PIECE + _PAD])  # pieces overlap by the widest filter
                owner.append(i)
                size += len(own[-1])
                if size >= PIECE:
                    self._pool(own, owner, pooled)
                    own, owner, size = [], [], 0
        self._pool(own, owner, pooled)
        return np.maximum(pooled, 0) @ self.net.out + self.net.shift

    def _pool(self, own: list[np.ndarray], owner: list[int], pooled: np.ndarray) -> None:
        if own:
            ids, starts, real = _laid_out(own)
            values, _ = self.net.pooled(self.vectors[ids], starts, real)
            np.maximum.at(pooled, np.array(owner), values)


@dataclass
class ToxicityModel:
    net: ConvNet | None
    shift: float = 0.0  # added to logits, so that the overall threshold scores ``cut``
    thresholds: dict[str | None, float] = field(default_factory=dict)  # on the score, by language
    cut: float = 0.3

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits.astype(float) + self.shift, -60, 60)))


def _chunks(column: pa.Array) -> Iterator[list[bytes | None]]:
    own, size = [], 0
    for text in utf8(column):
        own.append(text)
        size += len(text or b"")
        if size >= 1 << 19:
            yield own
            own, size = [], 0
    if own:
        yield own


def with_logits(docs: DataFrame, net: ConvNet | None, *, text: str = "text", out: str = "logit") -> DataFrame:
    """The rows of ``docs`` with their own columns and the logit; no shuffle."""
    if net is None:
        return docs.withColumn(out, F.lit(-60.0))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a network of fixed size
    at, names = docs.columns.index(text), [*docs.columns, out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [np.zeros(0)] + [scorer.logits(texts) for texts in _chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found).astype(float))], names=names)

    return map_batches(docs, work, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def logits(docs: DataFrame, net: ConvNet | None, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang and the logit of every row."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return with_logits(source, net).drop("text")


def training_labels(labels: DataFrame, held_out: tuple[int, int] | None) -> DataFrame:
    """doc_id, toxic of the labelled rows to learn from: crc32 of the id modulo held_out[0] is not held_out[1]."""
    own = labels.where("doc_id is not null and toxic is not null")
    if held_out:
        own = own.where(crc_split("doc_id", held_out[0]) != held_out[1])
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def fit_net(
    docs: DataFrame, labels: DataFrame, *, held_out: tuple[int, int] | None = (4, 2), sample_rows: int = 6000, sample_bytes: int = 48 << 20,
    key: str = "doc_id", text: str = "text",
) -> ConvNet | None:
    """The network from a bounded sample of labelled rows."""
    with scratch(docs.sparkSession):
        return _fitted(docs, labels, held_out, sample_rows, sample_bytes, key, text)


def _fitted(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None, sample_rows: int, sample_bytes: int, key: str, text: str) -> ConvNet | None:
    own = training_labels(labels, held_out)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lengths = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    # an id counts once
    sized = written(own.join(lengths, "doc_id").groupBy("doc_id", "toxic").agg(F.max("size").alias("size")), "labelled-rows")
    least = {r.toxic: r.size for r in sized.groupBy("toxic").agg(F.min("size").alias("size")).collect()}
    if len(least) < 2:
        return None
    picked: list[tuple[int, int]] = []
    for toxic, share in byte_shares(least, sample_bytes).items():
        # at most sample_rows / 2 rows of three numbers
        rows = sized.where(F.col("toxic") == toxic).where(F.col("size") <= share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2).collect()
        picked += [(r.doc_id, toxic) for r in fitting(rows, share)]
    sample = small_table(docs.sparkSession, {"doc_id": ([i for i, _ in picked], pa.int64()), "toxic": ([t for _, t in picked], pa.int32())})
    # sample_rows rows at most: a proven bound
    got = written(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "training-texts")
    toxic_of = dict(picked)
    met: list[int] = []

    def each() -> Iterator[bytes]:
        for r in got.orderBy("doc_id").select("doc_id", "text").toLocalIterator():  # a partition at a time
            met.append(toxic_of[r.doc_id])
            yield (r.text or "").encode()

    net = train(each(), met)
    give_back()
    return net


def calibrate(scored: DataFrame, labels: DataFrame, net: ConvNet | None, *, held_out: tuple[int, int] | None = (4, 2), cut: float = 0.3) -> ToxicityModel:
    """Thresholds of greatest F1 over all labelled training rows, by language and over all."""
    model = ToxicityModel(net, cut=cut)
    step = 0.05
    counts = (
        scored.join(training_labels(labels, held_out), "doc_id")
        .groupBy("lang", "toxic", F.floor(F.least(F.greatest("logit", F.lit(-60.0)), F.lit(60.0)) / step).cast("int").alias("bin"))
        .count()
        .collect()
    )  # languages x 2 x 2400 bins at most, whatever the number of rows

    def best(rows: list) -> float | None:
        bins = sorted({r.bin for r in rows})
        hit = {(r.bin, r.toxic): 0 for r in rows}
        for r in rows:
            hit[r.bin, r.toxic] += r["count"]
        positive = sum(n for (_, t), n in hit.items() if t)
        if not positive or positive == sum(hit.values()):
            return None
        top, found, true, false = -1.0, None, 0, 0
        for i, b in reversed(list(enumerate(bins))):
            true, false = true + hit.get((b, 1), 0), false + hit.get((b, 0), 0)
            f1 = 2 * true / (true + false + positive)
            if f1 > top:
                # half way down to the next bin that holds anything
                top, found = f1, (b + (bins[i - 1] + 1 if i else b)) / 2 * step
        return found

    overall = best(counts)
    if overall is None:
        return model
    model.shift = float(np.log(cut / (1 - cut)) - overall)
    model.thresholds[None] = cut
    for lang in {r.lang for r in counts if r.lang is not None}:
        at = best([r for r in counts if r.lang == lang])
        if at is not None:
            model.thresholds[lang] = float(model.score(np.array([at]))[0])
    return model


def _score_and_threshold(model: ToxicityModel, logit: Column, lang: Column) -> tuple[Column, Column]:
    score = 1 / (1 + F.exp(-F.least(F.greatest(logit + model.shift, F.lit(-60.0)), F.lit(60.0))))
    threshold = F.lit(model.thresholds.get(None, model.cut))
    for name, value in model.thresholds.items():
        if name is not None:
            threshold = F.when(lang == name, value).otherwise(threshold)
    return score, threshold


def judge(scored: DataFrame, model: ToxicityModel) -> DataFrame:
    """``scored`` with score, the threshold of the row's language, and toxic."""
    score, threshold = _score_and_threshold(model, F.col("logit"), F.col("lang"))
    return scored.withColumn("score", score).withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def _must_have_both_labels(docs: DataFrame, model: ToxicityModel) -> None:
    if model.net is None and docs.limit(1).count():
        raise ValueError("toxicity can't be filtered: the training rows don't have both labels")


def toxicity_filter(docs: DataFrame, model: ToxicityModel, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that a fitted model doesn't find toxic, with their own columns; no shuffle."""
    _must_have_both_labels(docs, model)
    out = unused(docs, "logit")
    score, threshold = _score_and_threshold(model, F.col(out), F.col(lang).cast("string"))
    return with_logits(docs, model.net, text=text, out=out).where(score < threshold).drop(out)


def fit_and_filter(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", **fitting_options
) -> DataFrame:
    """The rows of ``docs`` that are not toxic by a network and thresholds fitted on them; texts are scored once.

    The rows are written with their logits, the thresholds come from that table, and so do the rows that stay.
    """
    net = fit_net(docs, labels, key=key, text=text, **fitting_options)
    out = unused(docs, "logit")
    scored = written(with_logits(docs, net, text=text, out=out), "toxicity")
    narrow = scored.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(out).alias("logit"))
    model = calibrate(narrow, labels, net)
    _must_have_both_labels(docs, model)
    score, threshold = _score_and_threshold(model, F.col(out), F.col(lang).cast("string"))
    return scored.where(score < threshold).drop(out)
