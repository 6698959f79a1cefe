"""Operator 4: byte-level BPE encoding and decoding over a rank file.

Two tiers.  Pre-tokens that are whole vocabulary entries are resolved by a
minimal perfect hash: one displacement, one slot, and a comparison with the
token stored there.  The others are merged: a heap of adjacent pairs by rank
over a linked list of their bytes, so a pre-token of n bytes costs O(n log n).
Both run on the distinct new pre-tokens of a batch; a memo of bounded size keeps
their ids, and a text's ids are the memo's entries one after another.

Defined cases: null or empty text has no ids and decodes to no bytes; repeated
rows are encoded alike; of pairs of equal rank the leftmost merges first; other
columns are ignored unless named in ``keep``.

Memory: a task holds an Arrow batch of texts, or one text if that is longer, with
some 80 bytes for each of its pre-tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches
from .perfect_hash import PerfectHash


#: Pre-tokens whose ids a worker remembers before it forgets them all.
MEMO_ENTRIES = 300_000


def ranks_of(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines())}


class Vocabulary:
    """Ranks of byte strings, with the perfect hash over them."""

    def __init__(self, rank_file: bytes):
        self.ranks = ranks_of(rank_file)
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        self.perfect = PerfectHash.build(hashes)
        slots = self.perfect.slots(hashes)
        self.stored: list[bytes] = [b""] * len(tokens)
        self.slot_id = np.zeros(len(tokens), np.uint32)
        for token, slot in zip(tokens, slots.tolist(), strict=True):
            self.stored[slot] = token
            self.slot_id[slot] = self.ranks[token]

        self.by_id = {i: t for t, i in self.ranks.items()}

    def whole(self, pieces: list[bytes]) -> list[int]:
        """The id of each piece that is a token, else -1."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
        slots = self.perfect.slots(hashes)
        ids = self.slot_id[slots].tolist()
        stored = self.stored
        return [i if stored[s] == p else -1 for p, s, i in zip(pieces, slots.tolist(), ids, strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by merging the adjacent pair of least rank, leftmost first, until none is left."""
        get, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is named by its first byte
        at = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of the part and the next one together
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(at) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & mask
            if at[i] != entry >> shift:
                continue  # one of the two has been merged since
            j = end[i]
            end[i] = k = end[j]
            at[i] = at[j] = -1
            if k < n:
                before[k] = i
                at[i] = r = get(piece[i : end[k]], -1)
                if r >= 0:
                    heapq.heappush(heap, r << shift | i)
            h = before[i]
            if h >= 0:
                at[h] = r = get(piece[h:k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << shift | h)
        ids, i = [], 0
        while i < n:
            ids.append(get(piece[i : end[i]]))
            i = end[i]
        return ids


class Encoder:
    """Texts to ids through both tiers; one a worker process."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.memo, self.older = {}, {}

    def learn(self, pieces: set[str]) -> None:
        strings = list(pieces)
        raw = [p.encode() for p in strings]
        for text, piece, found in zip(strings, raw, self.vocabulary.whole(raw), strict=True):
            ids = [found] if found >= 0 else self.vocabulary.merge(piece)
            self.memo[text] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_ENTRIES // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        own = set().union(*cut)
        if new := {p for p in own if p not in memo}:
            memo.update((p, older[p]) for p in new if p in older)  # what is met again stays
            self.learn({p for p in new if p not in older})
        near = {p: memo[p] for p in own}  # small: most look-ups are of pre-tokens met in the same texts
        return [b"".join(map(near.__getitem__, pieces)) for pieces in cut]


def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder a worker process."""
    return kept("bpe", (hash(rank_file), pattern), lambda: Encoder(Vocabulary(rank_file), pattern))


def decoded(ids: bytes, by_id: dict[int, bytes]) -> bytes:
    return b"".join(map(by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _sent(df: DataFrame, rank_path: str):
    """The rank file, read on the driver: one vocabulary, whose size does not follow the data."""
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _coded(
    docs: DataFrame, rank_path: str, pattern: str, text: str, keep: tuple[str, ...], chunk: int, out: str | None
) -> DataFrame:
    sent = _sent(docs, rank_path)
    source = docs.select(*keep, F.col(text).alias("__text"))
    names = [*keep, "ids", *([out] if out else [])]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{n}` binary" for n in names[len(keep) :]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, pattern)
        by_id = encoder.vocabulary.by_id
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                ids = encoder.encode(part.column(part.num_columns - 1).to_pylist())
                columns = [ids, [decoded(v, by_id) for v in ids]] if out else [ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.binary()) for c in columns)], names=names)

    return map_batches(source, work, schema, keeps="bpe")


def encode(
    docs: DataFrame, rank_path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = 64
) -> DataFrame:
    """``keep`` columns and ``ids``: the token ids of each whole text as little-endian uint32."""
    return _coded(docs, rank_path, pattern, text, keep, chunk, None)


def round_trip(
    docs: DataFrame, rank_path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded", chunk: int = 64
) -> DataFrame:
    """``encode``, and ``out``: the bytes that the ids stand for, decoded by the worker that encoded them."""
    return _coded(docs, rank_path, pattern, text, keep, chunk, out)


def decode(tokens: DataFrame, rank_path: str, *, ids: str = "ids", out: str = "decoded", chunk: int = 64) -> DataFrame:
    """``tokens`` with the bytes that ``ids`` stand for; null ids decode to no bytes."""
    sent = _sent(tokens, rank_path)
    names = tokens.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields] + [f"`{out}` binary"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = kept("tokens", hash(sent.value), lambda: {i: t for t, i in ranks_of(sent.value).items()})
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                text = [decoded(v or b"", by_id) for v in part.column(names.index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.binary())], names=[*names, out])

    return map_batches(tokens, work, schema, keeps="tokens")
