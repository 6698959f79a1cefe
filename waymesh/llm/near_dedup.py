"""Operator 8: MinHash near-duplicates with sequential Bayesian verification.

Each document is the set of its distinct word shingles.  MinHash signatures are
cut into bands; documents that agree on a band share a bucket.  A candidate
pair's signatures are compared batch by batch: after each batch the posterior
of the similarity (uniform prior, matches so far) tells how probable it is that
the pair reaches the threshold, and the pair is dropped once that is below
``miss``.  Pairs that are left are compared on their full shingle sets, and
only those that reach the threshold link.

Equal sets are one class: the least row stands for it in the search, and the
graph's nodes are classes.  First every member of a bucket is compared with the
bucket's least row alone, and each row's best pair is verified; the links'
components are contracted.  Then only buckets that still hold two or more
components are looked at again, by their least row: the rows of such a group are
compared across components, first on signatures, then on full sets: those of its
largest component only with the others.  A group with more than ``large`` others is first cut by ``sub_bands`` further bands of
``sub_rows`` signature values each, so rows that only share a common passage
part again; a row is written once a sub-band, whatever the group's size.  What
is left is compared inside tasks, in blocks of ``block`` rows, and only links
are written out.

Classes, components, least rows and buckets that hold many rows meet them by
broadcast of their own narrow row (``hot_join``), not in one task.  Texts and
sketches are shuffled only where a bitmap of bounded size (``Sieve``) leaves it
open whether a join asks for them.

Bands (``bands`` x ``rows``) miss a pair of similarity 0.8 with probability
(1 - 0.8^6)^40 = 5e-6; pruning adds ``miss`` a batch at most, and sub-bands of
large groups (1 - 0.8^8)^96 = 2e-8 for a pair whose signature agrees as expected,
and 1.1e-5 averaged over how many of its 240 values agree (binomial).  With a
``large`` above any group's size no group is cut, and that part falls away.

Memory: a task holds the texts of an Arrow batch (one text, if that is longer)
with some 100 bytes for each of its words, and two blocks of rows with their sets.

Defined cases: null or empty text has no shingles and links with nothing; a
text of fewer words than a shingle is one shingle; equal sets always link, and
one of them stands for all in the search; rows
with the same id are one document and are linked; a row with a null id links
with nothing, has a null component and is kept; an empty table gives no rows;
other columns are ignored, and kept by ``drop_duplicates``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import HashMemo, Sieve, hot_join, map_batches, mixed, scratch, unused, utf8, written

#: Hashes compared between two looks at the posterior.
BATCH = 16
_CHUNK_BYTES = 1 << 20


@dataclass(frozen=True)
class Plan:
    shingle: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 6
    miss: float = 1e-6
    block: int = 256
    large: int = 2048
    sub_bands: int = 96
    sub_rows: int = 8

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> np.ndarray:
        """For each batch, the fewest matches with which a pair stays a candidate."""
        return _least_matches(self)


@cache
def _least_matches(plan: Plan) -> np.ndarray:
    j = (np.arange(20_000) + 0.5) / 20_000
    log_j, log_not = np.log(j), np.log1p(-j)

    def stays(m: int, n: int) -> bool:
        log = m * log_j + (n - m) * log_not
        density = np.exp(log - log.max())
        return bool(density[j >= plan.percent / 100].sum() / density.sum() >= plan.miss)

    # more matches make the threshold likelier
    return np.array([bisect_left(range(n + 1), True, key=lambda m: stays(m, n)) for n in range(BATCH, plan.hashes + 1, BATCH)])  # noqa: B023


def shingle_sets(texts: list[bytes | None], size: int, memo: HashMemo) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    split = [(t or b"").lower().split() for t in texts]
    words = memo.of([w for own in split for w in own])
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - size + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total += words[j : j + n] * factors[j]
        runs = mixed(total)
        out, at = [], 0
        for own in split:
            k = len(own)
            if k >= size:
                out.append(np.unique(runs[at : at + k - size + 1]))
            elif k:
                out.append(mixed(np.array([(words[at : at + k] * factors[:k]).sum() + np.uint64(k)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            at += k
    return out


def signatures(sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """MinHash values (uint32) of non-empty sets, one row a set."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    draw = np.random.default_rng(8).integers(0, 1 << 32, (plan.hashes, 2), dtype=np.uint64).astype(np.uint32)
    out = np.empty((len(sets), plan.hashes), np.uint32)
    value = np.empty_like(x)
    for i, (a, b) in enumerate(draw):
        np.multiply(x, a | np.uint32(1), out=value)
        np.add(value, b, out=value)
        out[:, i] = np.minimum.reduceat(value, starts)
    return out


def _band_keys(values: np.ndarray, plan: Plan) -> np.ndarray:
    factors = mixed(np.arange(1, plan.rows + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        parts = (values.reshape(len(values), plan.bands, plan.rows).astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64)
        return mixed(parts + mixed(np.arange(plan.bands, dtype=np.uint64))).view(np.int64)


def _chunks(column: pa.Array) -> Iterator[list[bytes | None]]:
    own, size = [], 0
    for text in utf8(column):
        own.append(text)
        size += len(text or b"")
        if size >= _CHUNK_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def sketches(docs: DataFrame, plan: Plan, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, doc_id, n_shingles, digest of the set, one byte of each MinHash value, and band keys."""
    schema = "row_id long, doc_id long, n_shingles long, digest binary, sig binary, keys array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(2)):
                sets = shingle_sets(texts, plan.shingle, memo)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig, keys = [b""] * len(sets), [[]] * len(sets)
                if full:
                    values = signatures([sets[i] for i in full], plan)
                    with np.errstate(over="ignore"):
                        bytes_of = (values * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                    for i, s, k in zip(full, bytes_of, _band_keys(values, plan), strict=True):
                        sig[i], keys[i] = s.tobytes(), k
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["row_id", "doc_id", "n_shingles", "digest", "sig", "keys"],
                )
                at += len(texts)

    source = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(source, work, schema)


def _survives(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, plan: Plan, least: np.ndarray) -> np.ndarray:
    """Pairs of signature rows whose sizes allow the threshold and that no batch prunes."""
    alive = np.flatnonzero(100 * np.minimum(size_a, size_b) >= plan.percent * np.maximum(size_a, size_b))
    matches = np.zeros(len(alive), np.int64)
    for i, fewest in enumerate(least):
        s = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[alive, s] == b[alive, s]).sum(axis=1)
        stay = matches >= fewest
        alive, matches = alive[stay], matches[stay]
    return alive


def _prune(pairs: DataFrame, plan: Plan) -> DataFrame:
    """Pairs with both sketches -> a, b and the number of matches of those that stay."""
    least = plan.least_matches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, plan.hashes) for c in ("sig_a", "sig_b"))
            alive = _survives(a, b, np.asarray(batch.column("size_a")), np.asarray(batch.column("size_b")), plan, least)
            part = batch.take(pa.array(alive))
            matches = pa.array((a[alive] == b[alive]).sum(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), matches], names=["a", "b", "matches"])

    return map_batches(pairs, work, "a long, b long, matches int")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches in runs of equal leading columns."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[:n_keys] != group[0][:n_keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _pairs_batch(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)


_HEAD = ["pivot", "first", "second"]


def _alive_across(rows: list[tuple], plan: Plan, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a group the rows of another component that it is to meet there and that no batch prunes.

    Rows are (pivot, first, second, own, row_id, component, n_shingles, sig, ...), see ``_doubtful``.
    """
    first, second = rows[0][1:3]
    own, comps, sizes = (np.array([r[k] for r in rows]) for k in (3, 5, 6))
    sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(-1, plan.hashes)
    for i in np.flatnonzero(own == first).tolist():
        other = own == second
        if second == -1:
            other[i + 1 :] |= own[i + 1 :] == first
        j = np.flatnonzero(other & (comps != comps[i]))
        if len(j):
            yield i, j[_survives(np.broadcast_to(sig[i], (len(j), plan.hashes)), sig[j], np.full(len(j), sizes[i]), sizes[j], plan, least)]


def _sized(members: DataFrame) -> DataFrame:
    """``members`` (pivot, component, ...) with n, main and others: rows of the group, its largest component, and rows outside of that."""
    each = members.groupBy("pivot", "component").agg(F.count("*").alias("k"))
    sizes = each.groupBy("pivot").agg(F.sum("k").alias("n"), F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("k"))
    sizes = written(sizes.select("pivot", "n", "main", (F.col("n") - F.col("k")).alias("others")).where("others > 0"), "group-sizes")
    return hot_join(members, sizes, "pivot", keep_n=True)


def _doubtful(members: DataFrame, plan: Plan) -> DataFrame:
    """The rows of each group that agree with a row of another component: pivot, first, second, own, row_id.

    Rows of a group's largest component meet those outside of it, and these each
    other.  Both are dealt into blocks (own: 0, 1, ... outside, -1, -2, ... inside)
    and each two blocks that are to meet do so in a task of their own; a block
    outside meets itself where it meets -1.  So a large component that a few
    others touch costs a row for each of its rows.  Pairs stay inside the task.
    """
    least = plan.least_matches()
    names = [*_HEAD, "own", "row_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            hit: set[int] = set()
            for i, j in _alive_across(group, plan, least):
                if len(j):
                    hit.add(i)
                    hit.update(j.tolist())
            if hit:
                rows = [group[i][:5] for i in sorted(hit)]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    outside, inside = F.ceil(F.col("others") / plan.block).cast("int"), F.ceil((F.col("n") - F.col("others")) / plan.block).cast("int")
    of = lambda n: F.pmod(F.xxhash64("row_id"), n).cast("int")
    is_main = F.col("component") == F.col("main")
    own = F.when(is_main, -1 - of(inside)).otherwise(of(outside))
    below = F.transform(F.sequence(F.lit(0), inside - 1), lambda k: -1 - k)
    beside = F.filter(F.sequence(F.lit(0), outside - 1), lambda k: k != of(outside))
    met = F.when(is_main, F.sequence(F.lit(0), outside - 1)).otherwise(F.concat(below, beside))
    dealt = (
        members.withColumn("own", own).withColumn("met", F.explode(met))
        .select("pivot", F.when(F.col("met") < 0, F.col("own")).when(F.col("own") < 0, F.col("met")).otherwise(F.least("own", "met")).alias("first"),
                F.when(F.col("met") < 0, F.col("met")).when(F.col("own") < 0, F.col("own")).otherwise(F.greatest("own", "met")).alias("second"),
                "own", "row_id", "component", "n_shingles", "sig")
        .repartition(*_HEAD).sortWithinPartitions(*_HEAD)
    )
    return map_batches(dealt, work, "pivot long, first int, second int, own int, row_id long")


def _sub_banded(rows: DataFrame, plan: Plan) -> DataFrame:
    """pivot, row_id of large groups' rows (pivot, row_id, component, sig), cut by bands of further signature values; those of one component go."""
    rng = np.random.default_rng(88)
    chosen = np.stack([rng.choice(plan.hashes, plan.sub_rows, replace=False) for _ in range(plan.sub_bands)])
    factors = mixed(np.arange(1, plan.sub_rows + 1, dtype=np.uint64)) | np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, plan.hashes)
                with np.errstate(over="ignore"):
                    own = (sig[:, chosen].astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64) + mixed(np.arange(plan.sub_bands, dtype=np.uint64))
                    keys = mixed(mixed(own) + np.asarray(part.column("pivot")).view(np.uint64)[:, None]).view(np.int64)
                each = lambda c: pa.array(np.repeat(np.asarray(part.column(c)), plan.sub_bands))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), each("row_id"), each("component")], names=["pivot", "row_id", "component"])

    cut = written(map_batches(rows.select("pivot", "row_id", "component", "sig"), work, "pivot long, row_id long, component long"), "sub-bands")
    return _sized(cut).select("pivot", "row_id")


def _late_links(doubtful: DataFrame, plan: Plan) -> DataFrame:
    """Links between components among the doubtful rows of each group (with sketches and sets), confirmed on full sets inside the task."""
    least = plan.least_matches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            values = [np.frombuffer(r[8], np.uint64) for r in group]
            lengths = np.array([len(v) for v in values])
            root = {r[5]: r[5] for r in group}

            def top(x: int) -> int:
                while root[x] != x:  # noqa: B023
                    root[x] = x = root[root[x]]  # noqa: B023
                return x

            found = []
            for i, j in _alive_across(group, plan, least):
                j = np.array([k for k in j.tolist() if top(group[k][5]) != top(group[i][5])], np.int64)
                if not len(j):
                    continue
                together = np.concatenate([values[k] for k in j])
                own = values[i]
                hits = own[np.minimum(np.searchsorted(own, together), len(own) - 1)] == together
                both = np.add.reduceat(hits, np.concatenate(([0], np.cumsum(lengths[j])[:-1])), dtype=np.int64)
                for k in j[100 * both >= plan.percent * (len(own) + lengths[j] - both)].tolist():
                    a, b = top(group[i][5]), top(group[k][5])
                    if a != b:
                        root[a] = b
                        found.append((group[i][4], group[k][4]))
            if found:
                yield _pairs_batch(found, ["a", "b"])

    rows = doubtful.select(*_HEAD, "own", "row_id", "component", "n_shingles", "sig", "shingles").repartition(*_HEAD).sortWithinPartitions(*_HEAD)
    return map_batches(rows, work, "a long, b long")


def _with_sets(asked: DataFrame, docs: DataFrame, rows: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """``asked`` (row_id, ...) with all shingles of each row, from the texts again: sets are never stored for all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(texts, plan.shingle, memo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())],
                    names=["doc_id", "digest", "shingles"],
                )
                at += len(texts)

    wanted = written(asked.join(rows.select("row_id", "doc_id", "digest"), "row_id"), "wanted")
    texts, _ = Sieve.of(wanted.select("doc_id").distinct(), "doc_id").parted(
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), F.col("doc_id")
    )
    sets = map_batches(texts, work, "doc_id long, digest binary, shingles binary")
    # each set is moved to its rows once; those of rows that repeat an id and a set are one
    return wanted.join(sets.dropDuplicates(["doc_id", "digest"]), ["doc_id", "digest"]).drop("doc_id", "digest")


def _verify(stars: DataFrame, docs: DataFrame, rows: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """Links among ``stars`` (a, b; a b has one a) whose full shingle sets reach the threshold.

    A star's members are dealt into blocks of about ``block``; the set of its
    centre goes to each block once, and members' sets pass it one after another.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, centre = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("a", "part", "b", "shingles")]
            for a, part, b, shingles in zip(*columns, strict=True):
                own = np.frombuffer(shingles, np.uint64)
                if b is None:
                    head, centre = (a, part), own
                    continue
                if head != (a, part):
                    raise ValueError("a star's part lacks its centre")
                x, y = sorted((own, centre), key=len)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= plan.percent * (len(x) + len(y) - both):
                    found.append((a, b))
            if found:
                yield _pairs_batch(found, ["a", "b"])

    parts = stars.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / plan.block).cast("int"))
    parts = written(parts, "star-parts")
    members = hot_join(stars, parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", F.col("b").alias("row_id"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("row_id"))
    asked = _with_sets(members.unionByName(centres), docs, rows, plan, key, text)
    dealt = asked.select("a", "part", "b", "shingles").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return map_batches(dealt, confirm, "a long, b long")


def _components(links: DataFrame) -> DataFrame:
    return written(connected_components(links, cut=written, one_task=0), "components")


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id of the component) and kept, for every row of ``docs``."""
    with scratch(docs.sparkSession):
        sketched = written(sketches(docs, plan, key=key, text=text), "sketches")
        # rows of equal sets are a class; those without words only with rows of their own id
        of_id = F.concat("digest", F.col("doc_id").cast("string").cast("binary"))
        own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("digest")).otherwise(of_id))
        rows = written(sketched.select("row_id", "doc_id", "n_shingles", "digest", own.alias("class")), "rows", lasting=True)
        known = rows.where("class is not null")
        classes = known.groupBy("class").agg(
            F.min("row_id").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles")
        )
        classes = written(classes, "classes")
        components = _class_components(docs, sketched, rows, classes, plan, key, text)
        placed = classes.join(components.select(F.col("id").alias("node"), "component"), "node", "left")
        placed = written(placed.select("class", "least", "n", F.coalesce("component", "node").alias("component")), "placed")
        ids = written(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "component-ids")
        found = written(hot_join(placed, ids, "component", n="m").select("class", "component_id", "n"), "found", lasting=True)
    last = lambda df, name: written(df, name, lasting=True)
    in_component = hot_join(known, found, "class", cut=last).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = rows.where("class is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return in_component.unionByName(alone)


def _same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that rows of one id lie in."""
    pairs = written(rows.where("class is not null").select("doc_id", "class").distinct(), "id-classes")
    several = pairs.groupBy("doc_id").agg(F.min("class").alias("first"), F.count("*").alias("n")).where("n > 1")
    linked = hot_join(pairs, written(several, "repeated-ids"), "doc_id").where("class <> first").select("first", "class")
    node = lambda c, name: classes.select(F.col("class").alias(c), F.col("node").alias(name))
    return linked.join(node("first", "a"), "first").join(node("class", "b"), "class").select("a", "b")


def _first_of_class(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``sketched`` that stand for their class; wide rows of sets that occur once are not shuffled."""
    several = Sieve.of(classes.where("n > 1 and n_shingles > 0"), "class")
    open_rows, alone = several.parted(sketched.where("n_shingles > 0 and doc_id is not null"), F.col("digest"))
    return alone.unionByName(open_rows.join(classes.select(F.col("node").alias("row_id")), "row_id", "left_semi"))


def _class_components(docs: DataFrame, sketched: DataFrame, rows: DataFrame, classes: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """id, component of the classes' nodes that are linked with any other."""
    first = written(_first_of_class(sketched, classes), "first")
    named = lambda df, c: df.withColumnsRenamed({"row_id": c, "sig": f"sig_{c}", "n_shingles": f"size_{c}"})

    bands = first.select("row_id", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("row_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets, "buckets")
    shared, _ = Sieve.of(buckets, "key").parted(bands, F.col("key"))
    members = written(hot_join(shared, buckets, "key", keep_n=True), "members")

    stars = written(members.where("row_id <> pivot").select(F.col("pivot").alias("a"), F.col("row_id").alias("b")).distinct(), "stars")
    ends = stars.select(F.explode(F.array("a", "b")).alias("row_id"))
    sig, _ = Sieve.of(ends, "row_id").parted(first.select("row_id", "sig", "n_shingles"), F.col("row_id"))
    sig = written(sig, "star-sketches")
    centres = written(stars.groupBy("a").agg(F.count("*").alias("n")).join(named(sig, "a"), "a"), "centres")
    alike = written(_prune(hot_join(stars, centres, "a").join(named(sig, "b"), "b"), plan), "alike")
    best = alike.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b")
    best = written(best, "best")
    links = written(_verify(best, docs, rows, plan, key, text).union(_same_ids(rows, classes)), "links")
    components = _components(links)

    # what may still join two components: rows of one bucket, and pairs with a pivot that was not the best
    part = components.withColumnRenamed("id", "row_id")
    placed = members.where("n > 2").join(part, "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))
    placed = written(placed.select("key", "pivot", "row_id", "component"), "placed-members")
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    split = written(split.select("key", "n"), "split")
    other = written(alike.join(best, ["a", "b"], "left_anti").select("a", "b"), "other")
    of_a = other.groupBy("a").agg(F.count("*").alias("n")).join(part.withColumnRenamed("row_id", "a"), "a", "left").select("a", "n", F.coalesce("component", "a").alias("component_a"))
    of_b = part.select(F.col("row_id").alias("b"), F.col("component").alias("component_b"))
    rest = (
        hot_join(other, written(of_a, "centre-components"), "a").join(of_b, "b", "left").where("component_a <> coalesce(component_b, b)")
        .select(F.col("a").alias("pivot"), F.explode(F.array("a", "b")).alias("row_id"))
    )
    open_rows = written(hot_join(placed, split, "key").select("pivot", "row_id").union(rest).distinct(), "open-rows")
    if not open_rows.limit(1).count():
        return components
    known = sig.join(part, "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))
    known = written(known.join(open_rows.select("row_id").distinct(), "row_id", "left_semi"), "open-sketches")
    sized = written(_sized(open_rows.join(known, "row_id")), "sized")
    held = sized.where(F.col("others") > plan.large)
    members = sized.where(F.col("others") <= plan.large)
    if held.limit(1).count():
        apart = _sub_banded(held, plan).join(known, "row_id")
        members = members.unionByName(_sized(written(apart, "sub-members")))
    doubtful = written(_doubtful(members, plan), "doubtful")
    if not doubtful.limit(1).count():
        return components
    late = _late_links(_with_sets(doubtful.join(known, "row_id"), docs, rows, plan, key, text), plan)
    late = written(late, "late-links")
    return _components(links.union(late)) if late.limit(1).count() else components


def drop_duplicates(docs: DataFrame, plan: Plan = Plan(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component, with their own columns."""
    name = unused(docs, "gone")
    gone = near_duplicates(docs, plan, key=key, text=text).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = written(gone, "gone", lasting=True)
    # only texts that may go are shuffled
    own = docs[key].cast("long")
    doubtful, stay = Sieve.of(gone, name, lasting=True).parted(docs, own)
    return stay.unionByName(doubtful.join(gone, own == gone[name], "left_anti"))
