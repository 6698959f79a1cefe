"""Operator 11: phrases whose words stand together more often than their parts would by chance.

1. ``pieces``: texts are lower-cased (A-Z) and cut at punctuation and line ends;
   identical pieces of a language become one row with a multiplicity.
2. ``phrase_counts``: phrases of 1, 2, ... words, one length after the other.  Tasks
   expand pieces and sum up multiplicities chunk by chunk; sums go to hash buckets
   as compressed blocks, and one duckdb a bucket counts them out of core: beyond
   ``MEMORY`` it uses its task's own spill folder, which goes with the task.  A very
   frequent word is one row a chunk by then, not one an occurrence.  A phrase is not
   expanded if its first or its last words are no frequent phrase of the length
   before: a bitmap of bounded size tells, which may let others pass, but misses none.
3. ``scored``: every candidate asks for the counts of its parts.  Requests are
   shuffled to where the parts are counted (``hot_join``: parts that many
   candidates ask for meet them by broadcast), and answers are gathered by candidate.
4. ``contained``: longer candidates tell the phrases inside them how often they
   occur themselves; a phrase keeps the largest of these.
5. ``first_of_each``: the first rows of each language, in rounds over groups of
   bounded size, so that no language is sorted in one task.

A phrase occurs at least as often as any longer one that holds it, so only
phrases that reach ``least`` are kept after step 2, and nothing is lost by it.
Counts and products are exact (64 bits; 38 digits where counts are multiplied).

Defined cases: null and empty texts, and texts of punctuation, have no pieces;
null language is ``und``; phrases don't cross pieces; overlapping occurrences
count each; repeated rows count each; an empty table gives no rows; columns
other than text and language are ignored, whatever their names.  A piece is
expanded in one task, with memory of some thirty times its length.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, map_batches, mixed, scratch, written

#: What duckdb holds in memory in one task.
MEMORY = "256MB"
#: Bytes of pieces that are expanded together.
CHUNK_BYTES = 8 << 20
#: Words in distinct pieces for each hash bucket.
BUCKET_WORDS = 8_000_000
#: Size of the largest bitmap of frequent phrases (16 MB).
MOST_BITS = 1 << 27
#: Rows that are ranked together.
RANKED_ROWS = 100_000

#: Capitals to small letters, ends of pieces to line feeds, tabs to spaces.
_LETTERS = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _cut(texts: pa.Array, langs: pa.Array) -> pa.Table:
    """lang, piece, n of a batch; words of a piece are parted by one space."""
    texts = pc.fill_null(texts, "")
    raw = pa.array([t.translate(_LETTERS) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    parts = pc.split_pattern(raw, "\n")
    langs = langs.take(pc.list_parent_indices(parts))
    piece = pc.replace_substring_regex(pc.utf8_trim(parts.flatten(), " "), "  +", " ")
    whole = pc.not_equal(piece, "")
    found = pa.table({"lang": langs.filter(whole), "piece": piece.filter(whole)})
    return found.group_by(["lang", "piece"]).aggregate([([], "count_all")]).rename_columns(["lang", "piece", "n"])


def pieces(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Distinct pieces of each language with their multiplicity n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _cut(b.column("text"), b.column("lang")).to_batches()

    own = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    return map_batches(own, work, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _words() -> Column:
    return F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1


@contextmanager
def _duckdb() -> Iterator:
    """A duckdb of its own, with a spill folder that goes with it."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="spill-")  # on the executor: like Spark's own spill, nothing that another task reads
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _phrase_hash(words: Column, size: int) -> Column:
    """The hash of a phrase from its words' hashes, as ``_hashes`` has it."""
    parts = [_turned(F.xxhash64(F.get(words, F.lit(k))), k + 1) for k in range(size)]
    return reduce(lambda a, b: a.bitwiseXOR(b), parts)


def _hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hashes of the phrases that begin at positions ``at`` of the words with these hashes."""
    found = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = words[at + k]
        found ^= (h << np.uint64(k + 1)) | (h >> np.uint64(63 - k))
    return found


def frequent_bits(counts: DataFrame, size: int) -> np.ndarray:
    """A bitmap of the hashes of counted phrases: 32 bits each, between 8 KB and ``MOST_BITS``, whatever their number."""
    n = counts.count()
    bits = min(MOST_BITS, 1 << max(16, (32 * n - 1).bit_length() if n else 0))
    at = _phrase_hash(F.split("phrase", " "), size).bitwiseAND(F.lit(bits - 1)) + 1
    parts = counts.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # bits / 2^15 rows of 4 KB at most
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _phrases(chunk: pa.Table, size: int, bits: np.ndarray | None) -> tuple[pa.Table, np.ndarray]:
    """Phrases of ``size`` words in a chunk of pieces with their weighted counts, and their hashes.

    With ``bits`` only those whose first and last ``size`` - 1 words may be frequent phrases.
    """
    lists = pc.split_pattern(chunk.column("piece").combine_chunks(), " ")
    words = lists.flatten().dictionary_encode()
    names, ids = words.dictionary, np.asarray(words.indices).astype(np.int64)
    langs = chunk.column("lang").combine_chunks().dictionary_encode()
    piece = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names.cast(pa.binary()).to_pylist()), np.uint64, len(names))[ids]
    at = np.flatnonzero(piece[: len(piece) - size + 1] == piece[size - 1 :]) if len(piece) >= size else np.empty(0, np.int64)
    if bits is not None and len(at):
        at = at[_has(bits, _hashes(hashes, at, size - 1)) & _has(bits, _hashes(hashes, at + 1, size - 1))]
    code = np.asarray(langs.indices).astype(np.int64)[piece[at]]
    for k in range(size):  # dense numbers of the phrases so far, so that the next product fits
        code = np.unique(code * len(names) + ids[at + k], return_inverse=True)[1].astype(np.int64)
    first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    first[code[::-1]] = at[::-1]
    counts = np.zeros(len(first), np.int64)
    np.add.at(counts, code, np.asarray(chunk.column("n").combine_chunks())[piece[at]])
    joined = pc.binary_join_element_wise(*(names.take(pa.array(ids[first + k])) for k in range(size)), " ") if size > 1 else names.take(pa.array(ids[first]))
    lang = langs.dictionary.take(langs.indices.take(pa.array(piece[first])))
    return pa.table([lang, joined, pa.array(counts)], schema=_COUNTED), _hashes(hashes, first, size)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def counted(found: DataFrame, size: int, *, least: int, buckets: int, bits: np.ndarray | None = None) -> DataFrame:
    """lang, phrase and f of the phrases of ``size`` words that occur ``least`` times, or more, in the pieces of ``found``."""
    sent = found.sparkSession.sparkContext.broadcast(bits)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            rows, hashes = _phrases(chunk, size, sent.value)
            bucket = (mixed(hashes) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], rows.take(pa.array(order)).combine_chunks()
            ends = [*np.flatnonzero(np.diff(bucket)).tolist(), len(bucket) - 1] if len(bucket) else []
            begin = 0
            for end in ends:
                block = _packed(rows.slice(begin, end + 1 - begin))
                yield pa.RecordBatch.from_arrays([pa.array([bucket[begin]], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])
                begin = end + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block in b.column("block"):
                    yield from pa.ipc.open_stream(block.as_buffer())

        with _duckdb() as con:
            con.register("blocks", pa.RecordBatchReader.from_batches(_COUNTED, unpacked()))
            yield from con.sql(f"select lang, phrase, sum(f)::bigint as f from blocks group by lang, phrase having sum(f) >= {int(least)}").to_arrow_reader(100_000)

    dealt = map_batches(found, expand, "bucket int, block binary").repartition(buckets, "bucket")
    return map_batches(dealt, count, "lang string, phrase string, f long")


def phrase_counts(found: DataFrame, longest: int = 3, *, least: int = 10, buckets: int | None = None) -> DataFrame:
    """lang, size, phrase and f of the phrases of 1 to ``longest`` words that occur ``least`` times in the pieces of ``found``, a written table."""
    spark = found.sparkSession
    if buckets is None:
        words = found.agg(F.coalesce(F.sum(_words()), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET_WORDS))
    levels, bits = [], None
    for size in range(1, longest + 1):
        levels.append(written(counted(found, size, least=least, buckets=buckets, bits=bits), "counts"))
        bits = frequent_bits(levels[-1], size) if size < longest else None
    return reduce(DataFrame.unionByName, (df.withColumn("size", F.lit(k)) for k, df in enumerate(levels, 1)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _phrase(words: str, begin: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a) with l, r and score of the cut that scores lowest; of equal cuts the first."""
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), _phrase("words", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), _phrase("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )
    requests = cuts.select("lang", "phrase", "k", F.explode(sides).alias("s")).select("phrase", "k", "s.side", F.struct("lang", "s.part").alias("at"))
    asked = requests.groupBy("at").agg(F.count("*").alias("n"))
    answers = written(asked.join(counts.select(F.struct("lang", F.col("phrase").alias("part")).alias("at"), "f"), "at"), "answers")
    told = hot_join(requests, answers, "at")
    both = told.groupBy(F.col("at.lang").alias("lang"), "phrase", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    # the cuts of a phrase are as many as its words
    gathered = both.groupBy("lang", "phrase").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    best = F.array_min(F.transform("cuts", lambda c: F.struct(score_of(F.col("a"), c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    return candidates.drop("words").join(gathered, ["lang", "phrase"]).select("lang", "phrase", "size", "a", best.alias("best")).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)), exact up to counts of 10^16."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def contained(counts: DataFrame, longest: int = 3) -> DataFrame:
    """lang, phrase and ``above``: the largest count of a longer candidate that holds the phrase."""
    spans = [(b, n) for n in range(2, longest) for b in range(1, longest - n + 2)]
    if not spans:
        return counts.select("lang", "phrase", F.col("f").alias("above")).limit(0)
    longer = counts.where("size > 2").select("lang", "size", F.col("f"), F.split("phrase", " ").alias("words"))
    inside = F.array(*(F.when(F.lit(n) < F.col("size"), F.when(F.lit(b + n - 1) <= F.col("size"), _phrase("words", b, n))) for b, n in spans))
    told = longer.select("lang", "f", F.explode(inside).alias("phrase")).where("phrase is not null")
    return told.groupBy("lang", "phrase").agg(F.max("f").alias("above"))


def first_of_each(rows: DataFrame, group: str, order: Callable[[], list[Column]], first: int) -> DataFrame:
    """The ``first`` rows of each group with their ``rank`` from 1; ``order`` is total.

    As long as there are many rows they are dealt to pieces of some ``RANKED_ROWS``,
    and what is not among a piece's first goes; then groups are ranked whole.
    """
    n = rows.count()
    while n > max(RANKED_ROWS, 2 * first):
        parts = -(-n // max(RANKED_ROWS, 2 * first))
        dealt = rows.withColumn("piece", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
        within = Window.partitionBy(group, "piece").orderBy(*order())
        rows = written(dealt.withColumn("place", F.row_number().over(within)).where(F.col("place") <= first).drop("piece", "place"), "first")
        left = rows.count()
        if left > 0.8 * n:  # many small groups: none of them is large
            break
        n = left
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order()))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= first)


def mine(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, first: int = 2000, buckets: int | None = None
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` phrases of 2 to ``longest`` words.

    A phrase goes if a longer candidate that holds it occurs ``inside`` percent as often, or more.
    """
    with scratch(docs.sparkSession):
        found = written(pieces(docs, text=text, lang=lang), "pieces")
        totals = found.groupBy("lang").agg(F.sum(F.col("n") * _words()).alias("n"))
        counts = phrase_counts(found, longest, least=least, buckets=buckets)
        free = scored(counts).join(contained(counts, longest), ["lang", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < inside * F.col("a")))
        kept = written(free.select("lang", "phrase", "a", "l", "r", "score"), "scored")
        ranked = first_of_each(kept, "lang", lambda: [F.desc("score"), F.desc("a"), F.asc("phrase")], first)
        return written(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", lasting=True)
