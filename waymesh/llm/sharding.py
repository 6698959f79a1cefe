"""Operator 5: shards of near equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id, hash of the row), so equal
texts are neighbours.  For every splitter between shards the job counts, exactly
and over all partitions, the bytes below evenly spaced probe keys; the probe
interval that holds the splitter's target is probed again, more finely, until a
probe is within ``tolerance`` of it.  Then each row's shard follows from its
key and the splitters, and rows are exchanged once.

A group of equal texts of at most ``WHOLE`` of a shard's bytes always stays in
one shard: a splitter whose target lies inside it goes to the nearer end of the
group, so a shard deviates by less than the groups at its two ends.  Only in a
larger group do the probes go on into its ids, and into the rows of an id: a hot
text or id is split, and no shard outgrows the others because of it.  Each
round collects at most 2^``DIGIT`` sums a splitter, whatever the number of rows.

Slots number a shard's rows without gaps: rows are dealt to pieces of bounded
size by their row hash, pieces' counts are summed up, and rows are numbered
inside their piece.

Defined cases: null text counts one byte, as does empty text; rows with a null
or a repeated id are rows like others; fewer rows than shards leave shards
empty; an empty table gives no rows; columns of other names are kept if
``keep`` names them, and a name that the result has itself is an error.  A text
of any length is one value of one row; nothing but its size and checksum is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of the key that a round of probes resolves; keys have three parts of 63 bits.
DIGIT = 9
_PARTS = ("key_text", "key_id", "key_row")
_ROUNDS = 63 // DIGIT * len(_PARTS)
#: Part of a shard's bytes up to which a group of equal texts is never split.
WHOLE = 0.5
#: Rows that are numbered together.
PIECE_ROWS = 100_000


def keyed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows with their size in bytes, checksum and three-part key."""
    body = F.coalesce(F.col(text), F.lit(""))
    short = lambda h: F.shiftrightunsigned(h, 1)
    return docs.select(
        *keep,
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        short(F.xxhash64(body)).alias("key_text"),
        short(F.xxhash64(F.col(key), F.lit("id"))).alias("key_id"),
        short(F.xxhash64(F.monotonically_increasing_id(), F.lit("row"))).alias("key_row"),
    )


class _Box:
    """A run of keys: the digits that all of them begin with."""

    def __init__(self, digits: tuple[int, ...] = (), below: int = 0):
        self.digits, self.below = digits, below

    def parts(self) -> list[tuple[str, int, int]]:
        """(part of the key, bits to drop, what is left) for each part that the digits reach into."""
        per = 63 // DIGIT
        out = []
        for i in range(0, len(self.digits), per):
            own = self.digits[i : i + per]
            value = 0
            for d in own:
                value = value << DIGIT | d
            out.append((_PARTS[i // per], 63 - DIGIT * len(own), value))
        return out

    def holds(self) -> Column:
        found = F.lit(True)
        for part, drop, value in self.parts():
            found = found & (F.shiftright(F.col(part), drop) == value)
        return found

    def next_digit(self) -> Column:
        per = 63 // DIGIT
        part, k = _PARTS[len(self.digits) // per], len(self.digits) % per
        return F.shiftright(F.col(part), 63 - DIGIT * (k + 1)).bitwiseAND((1 << DIGIT) - 1)

    def lower(self) -> list[int]:
        """The least key of the box, by part."""
        found = [value << drop for _, drop, value in self.parts()]
        return found + [0] * (len(_PARTS) - len(found))


def splitters(rows: DataFrame, shards: int, *, tolerance: float = 0.002) -> list[list[int]]:
    """The least keys of shards 1, 2, ...: as many bytes below each as its target, within ``tolerance`` of a shard or at the end of a text's group."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = {i: total * i / shards for i in range(1, shards)}
    allowed, whole = tolerance * total / shards, WHOLE * total / shards
    per = 63 // DIGIT
    found: dict[int, list[int]] = {}
    boxes = {i: _Box() for i in targets}
    for _ in range(_ROUNDS):
        waiting = {i: b for i, b in boxes.items() if i not in found}
        if not waiting or not total:
            break
        distinct = {b.digits: b for b in waiting.values()}
        names = {d: n for n, d in enumerate(distinct)}
        box, digit = F.lit(None).cast("int"), F.lit(None).cast("long")
        for d, b in distinct.items():  # the boxes don't overlap
            box, digit = F.when(b.holds(), names[d]).otherwise(box), F.when(b.holds(), b.next_digit()).otherwise(digit)
        sums: dict[int, dict[int, int]] = {n: {} for n in names.values()}
        for r in rows.select(box.alias("box"), digit.alias("digit"), "size").where("box is not null").groupBy("box", "digit").agg(F.sum("size").alias("size")).collect():
            sums[r.box][r.digit] = r.size
        for i, b in waiting.items():
            below, best = b.below, None
            inside, held = None, 0
            for d, size in sorted(sums[names[b.digits]].items()):
                for edge, where in ((below, d), (below + size, d + 1)):
                    if best is None or abs(edge - targets[i]) < best[0]:
                        best = (abs(edge - targets[i]), where)
                if below <= targets[i] < below + size:
                    inside, held = _Box((*b.digits, d), below), size
                below += size
            done = inside is None or len(inside.digits) == _ROUNDS or len(inside.digits) == per and held <= whole
            if best[0] <= allowed or done:
                at = best[1]
                found[i] = _after(b.digits, at)
            else:
                boxes[i] = inside
    last = [(1 << 63) - 1] * len(_PARTS)
    return [found.get(i, last) for i in sorted(targets)]


def _after(digits: tuple[int, ...], digit: int) -> list[int]:
    """The least key that begins with ``digits`` and then ``digit``, which may carry."""
    own = [*digits, digit]
    for k in range(len(own) - 1, -1, -1):
        if own[k] < 1 << DIGIT:
            return _Box(tuple(own)).lower()
        own[k] = 0
        if k == 0:
            return [(1 << 63) - 1] * len(_PARTS)
        own[k - 1] += 1
    raise AssertionError


def shard_of(cuts: list[list[int]]) -> Column:
    """How many of the splitters are not above the row's key."""
    found = F.lit(0)
    for cut in cuts:
        at_least = F.col(_PARTS[2]) >= cut[2]
        for part, value in ((_PARTS[1], cut[1]), (_PARTS[0], cut[0])):
            at_least = (F.col(part) > value) | ((F.col(part) == value) & at_least)
        found = found + at_least.cast("int")
    return found


def gapless(rows: DataFrame, group: list[str], piece: str, order: list[str], out: str) -> DataFrame:
    """``rows`` numbered from 0 without gaps in each group, piece after piece; only a piece is ever sorted in one task."""
    counts = rows.groupBy(*group, piece).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*group, piece).orderBy(*order)
    return rows.join(bases, [*group, piece]).withColumn(out, F.col("__base") + F.row_number().over(within) - 1).drop("__base")


def shard_documents(
    docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tolerance: float = 0.002
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, with the columns of ``keep``."""
    if clash := set(keep) & {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}:
        raise ValueError(f"the result has columns of its own of these names: {sorted(clash)}")
    own = {c: f"keep_{k}" for k, c in enumerate(keep)}
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(n) for c, n in own.items()))
    rows = written(keyed(kept, keep=tuple(own.values())), "keyed")
    cuts = splitters(rows, shards, tolerance=tolerance)
    n = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n / shards / PIECE_ROWS))))
    placed = rows.withColumn("shard", shard_of(cuts)).withColumn("piece", F.shiftright("key_row", 63 - bits) if bits else F.lit(0).cast("long"))
    numbered = gapless(placed, ["shard"], "piece", [*_PARTS], "slot")
    return numbered.select(
        *(F.col(n).alias(c) for c, n in own.items()), "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
