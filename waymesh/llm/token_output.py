"""Operator 1: token ids as raw binary shards with a minimal perfect hash index.

``write_tokens`` range-partitions the documents by key, encodes each whole text
in the task that owns the key range and writes one payload file a partition, so
the files taken in order hold the documents in ascending key order.
``build_index`` then maps every key to its shard and offset: keys are dealt to
index files by hash, and each file is a minimal perfect hash whose slots store
a fingerprint, the shard, the offset and the length.  ``lookup`` answers keys
with one displacement, one slot and one fingerprint comparison each.

Files, all little-endian:

* ``shard-NNNNN.tok``: payload of ids (uint16 if every id fits, else uint32) of
  all documents one after another; then key (int64), key-is-null (uint8) and
  first token (uint64, n + 1 of them) of each document; then a trailer of four
  uint64: documents, tokens, bytes an id, magic.
* ``index-NNNNN.mph``: n, seed, number of displacements (uint64 each), the
  displacements (int32), and by slot: fingerprint (uint32), shard (uint32),
  first token in the shard (uint64), tokens (uint64).

Defined cases: null or empty text is the end id alone; null keys come first, in
the order of their text's hash, as do the rows of a repeated key, which are told
apart by their occurrence number (0, 1, ...); an empty table gives no files and
no rows; other columns are ignored, whatever their names.  Tasks write to a
name of their own and rename it; a repeated task makes equal bytes, and leaves
the file that an earlier attempt has put there.  ``path`` must be a new folder.

Sizes: shards follow the counted bytes and rows (``SHARD_BYTES``, ``SHARD_ROWS``),
so a task holds the footer of one shard (25 bytes a document), the index of as
many keys, and ``_CHUNK_BYTES`` of text, or one text if that is longer, with some
60 bytes for each of its words.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_batches, mixed, small_table, written
from .perfect_hash import PerfectHash

#: Words whose ids a worker remembers before it forgets those it has met in one chunk only.
MEMO_ENTRIES = 500_000
_CHUNK_BYTES = 8 << 20
#: Text and documents that a shard holds at most, as far as ranges are even; with more shuffle partitions shards are smaller, down to ``SMALL_SHARD`` bytes.
SHARD_BYTES, SHARD_ROWS, SMALL_SHARD = 256 << 20, 1_000_000, 4 << 20
MAGIC = 0x4B4F5459414D5741
_MANIFEST = (
    "shard int, n_docs long, n_tokens long, first_key long, first_null boolean, n_first long, "
    "last_key long, last_null boolean, n_last long"
)
_ENTRY = "key long, key_null boolean, occurrence long, hash long, index_id int, shard int, first_token long, n_tokens long"


def key_hashes(keys: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key, null flag, occurrence)."""
    with np.errstate(over="ignore"):
        h = mixed(keys.astype(np.int64).view(np.uint64)) + nulls.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        return mixed(h + occurrence.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _letters(word: bytes) -> bool:
    """Whether a word is letters only, also after composition and lower-casing."""
    return word.isalpha() or unicodedata.normalize("NFC", word.decode()).lower().isalpha()


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, word by word through a memo.

    Such a tokenizer never joins what ASCII white space separates, so the ids of a
    text are those of its words one after another.  Unknown runs of letters are
    encoded in one library call and told apart by the suffix that ends a word;
    the other unknown words are encoded as texts of their own.
    """

    def __init__(self, tokenizer, dtype):
        self.tokenizer, self.dtype, self.memo, self.again = tokenizer, dtype, {}, set()
        ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self.lower = ids("AB Cd") == ids("ab cd")
        spec = json.loads(tokenizer.to_str())
        # a run of letters is one pre-token whose last token bears the suffix, if the vocabulary has one,
        # and a stop after it is a pre-token of its own
        suffix = spec["model"].get("end_of_word_suffix")
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends, self.stops = np.zeros(max(vocabulary.values()) + 1, bool), {}
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            if all(ids(f"ab{x} é{x}") == ids(f"ab {x} é {x}") for x in ".,"):
                self.stops = {x.encode(): np.array(ids(x), dtype).tobytes() for x in ".,"}
        # lower-case ASCII letters come through these normalizers as they are
        steps = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
        plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in steps)
        self.plain = type(tokenizer).from_str(json.dumps(spec | {"normalizer": None})) if plain else tokenizer

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of unknown words into the memo: runs of letters first, by themselves, then what is left."""
        memo, stops = self.memo, self.stops
        ascii_letters, letters, rest, stopped = [], [], [], []
        seen = set()
        for w in words:
            raw = w
            if len(w) > 1 and w[-1:] in stops:
                raw = w[:-1]  # a stop is a pre-token of its own after letters
                if not _letters(raw):
                    rest.append(w.decode())
                    continue
                stopped.append(w)
            if raw in memo or raw in seen:
                continue
            seen.add(raw)
            if stops and raw.isalpha() and raw.islower():
                ascii_letters.append(raw.decode())
            elif stops and _letters(raw):
                letters.append(raw.decode())
            else:
                rest.append(raw.decode())
        for tokenizer, strings in ((self.plain, ascii_letters), (self.tokenizer, letters)):
            for at in range(0, len(strings), 1024):
                part = strings[at : at + 1024]
                (found,) = tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
                ids = np.array(found.ids, self.dtype)
                cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
                if len(cuts) != len(part):
                    rest += part
                    continue
                joined, before = ids.tobytes(), 0
                for s, cut in zip(part, cuts, strict=True):
                    memo[s.encode()] = joined[before:cut]
                    before = cut
        for at in range(0, len(rest), 1024):
            part = rest[at : at + 1024]
            for s, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                memo[s.encode()] = np.array(found.ids, self.dtype).tobytes()
        for w in stopped:
            memo[w] = memo[w[:-1]] + stops[w[-1:]]

    def _forget(self) -> None:
        """Words met in several chunks since the last time stay, if they leave half of the room."""
        stay = self.again if len(self.again) <= MEMO_ENTRIES // 2 else ()
        self.memo, self.again = {w: self.memo[w] for w in stay}, set()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text with its end id, and all those ids one after another."""
        texts = texts.fill_null("")
        if self.lower:
            # ASCII lower case, where that can't turn a text into a special token's name
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.memo) > MEMO_ENTRIES:
            self._forget()
        memo = self.memo
        new = [w for w in words if w not in memo]
        self.again.update(words)
        self.again.difference_update(new)
        if new:
            self.learn(new)
        known = [memo[w] for w in words]
        # the end id is one more word, after the last one of each text
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        numbers = np.insert(np.asarray(coded.indices), bounds[1:], len(words))
        pool = np.append(np.frombuffer(b"".join(known), self.dtype), np.array([end_id], self.dtype))
        lengths = np.append(np.fromiter(map(len, known), np.int64, len(words)) // pool.itemsize, 1)
        starts = np.cumsum(lengths) - lengths
        each = lengths[numbers]
        upto = np.cumsum(each)
        ids = pool[np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - each - starts[numbers], each)]
        return np.diff(upto[bounds[1:] + np.arange(len(texts))], prepend=0), ids


def _chunks(columns: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """The texts of batches in runs of about ``_CHUNK_BYTES``: long enough that words repeat in one, and bounded, whatever the texts' lengths."""
    held, total = [], 0
    for column in columns:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        at = 0
        while at < len(column):
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + _CHUNK_BYTES - total, "right")))
            held.append(column.slice(at, end - at))
            total += int(size[end - 1] - before)
            at = end
            if total >= _CHUNK_BYTES or at < len(column):
                yield pa.concat_arrays(held)
                held, total = [], 0
    if held:
        yield pa.concat_arrays(held)


def _encoder(spec: bytes, dtype) -> WordEncoder:
    """One encoder a worker process, kept from task to task."""
    from tokenizers import Tokenizer

    return kept("words", (hash(spec), np.dtype(dtype).str), lambda: WordEncoder(Tokenizer.from_buffer(spec), dtype))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _publish(fs: pafs.FileSystem, folder: str, name: str, write) -> None:
    """Writes under a name of this attempt, then renames: readers see whole files only."""
    fs.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        write(out)
    there = lambda: fs.get_file_info(f"{folder}/{name}").type == pafs.FileType.File
    if not there():
        try:
            fs.move(own, f"{folder}/{name}")
            return
        except OSError:  # some file systems don't replace what another attempt has just put there
            if not there():
                raise
    fs.delete_file(own)


def _shards(docs: DataFrame, text: str) -> int:
    """As many as shuffle partitions, unless shards get too large or small by the counted bytes and rows."""
    row = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    most = max(1, -(-row.size // SMALL_SHARD), -(-row.n // SHARD_ROWS))
    least = max(1, -(-row.size // SHARD_BYTES), -(-row.n // SHARD_ROWS))
    return min(most, max(least, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are and how their shards and index are numbered."""

    path: str
    n_shards: int
    n_index: int
    width: int
    base: dict[int, int] = field(default_factory=dict)  # shard -> ids of all shards before
    carried: dict[int, int] = field(default_factory=dict)  # shard -> rows of its first key in shards before


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    shards: int | None = None,
) -> TokenFiles:
    """Encodes ``text`` of every row and writes the shard files in ascending ``key`` order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    vocabulary = Tokenizer.from_buffer(spec).get_vocab_size(with_added_tokens=True)
    dtype = np.uint16 if max(vocabulary - 1, end_id) < 1 << 16 else np.uint32
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise ValueError(f"{path} exists")
    shards = shards or _shards(docs, text)
    sent = spark.sparkContext.broadcast(spec)  # one tokenizer file: its size does not follow the data
    width = np.dtype(dtype).itemsize

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = _encoder(sent.value, dtype)
        keys, nulls, counts = [], [], []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, folder = _open(path)

        def body(out) -> None:
            def told() -> Iterator[pa.Array]:
                for batch in chain([first], batches):
                    column = batch.column("key")
                    nulls.append(np.asarray(column.is_null()))
                    keys.append(np.asarray(column.fill_null(0)))
                    yield batch.column("text")

            for texts in _chunks(told()):
                n_ids, ids = encoder.encode(texts, end_id)
                counts.append(n_ids)
                out.write(ids.tobytes())
            firsts = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.uint64)
            out.write(np.concatenate(keys).astype(np.int64).tobytes())
            out.write(np.concatenate(nulls).astype(np.uint8).tobytes())
            out.write(firsts.tobytes())
            out.write(np.array([len(firsts) - 1, firsts[-1], width, MAGIC], np.uint64).tobytes())

        _publish(fs, folder, f"shard-{shard:05d}.tok", body)
        k, z = np.concatenate(keys), np.concatenate(nulls)
        same = lambda i: int(((k == k[i]) & (z == z[i])).sum())
        row = {
            "shard": shard, "n_docs": len(k), "n_tokens": int(sum(map(np.sum, counts))),
            "first_key": int(k[0]), "first_null": bool(z[0]), "n_first": same(0),
            "last_key": int(k[-1]), "last_null": bool(z[-1]), "n_last": same(-1),
        }
        yield pa.RecordBatch.from_pylist(
            [row],
            pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _MANIFEST.split(", "))]),
        )

    ordered = (
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(shards, "key", "tie", "row")
        .sortWithinPartitions("key", "tie", "row")
        .select("key", "text")
    )
    manifest = written(map_batches(ordered, write_shard, _MANIFEST, keeps="words"), "token-manifest")
    # one row a shard: as many rows as files, never as many as documents
    rows = manifest.orderBy("shard").collect()
    base, carried, total, run, last = {}, {}, 0, 0, None
    for r in rows:
        head, tail = (r.first_null, r.first_key), (r.last_null, r.last_key)
        base[r.shard], total = total, total + r.n_tokens
        carried[r.shard] = run if head == last else 0
        run = (carried[r.shard] if head == tail else 0) + r.n_last
        last = tail
    return TokenFiles(path, shards, max(1, len(rows)), width, base, carried)


def _footer(fs: pafs.FileSystem, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Keys, null flags, first tokens and the width of a shard."""
    with fs.open_input_file(path) as f:
        size = f.size()
        n, tokens, width, magic = np.frombuffer(f.read_at(32, size - 32), np.uint64).tolist()
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        raw = f.read_at(17 * n + 8, tokens * width)
    return (
        np.frombuffer(raw, np.int64, n),
        np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool),
        np.frombuffer(raw, np.uint64, n + 1, 9 * n).astype(np.int64),
        int(width),
    )


def entries(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """A row for each stored document, from the shards' own footers."""
    path, n_index, carried = files.path, files.n_index, files.carried
    shards = sorted(files.base)
    if not shards:
        return spark.createDataFrame([], _ENTRY)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                keys, nulls, firsts, _ = _footer(fs, f"{folder}/shard-{shard:05d}.tok")
                n = len(keys)
                new = np.ones(n, bool)
                new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
                at = np.arange(n)
                begin = np.maximum.accumulate(np.where(new, at, 0))
                occurrence = at - begin + np.where(begin == 0, carried[shard], 0)
                h = key_hashes(keys, nulls, occurrence)
                index_id = (h % np.uint64(n_index)).astype(np.int32)
                for a in range(0, n, 50_000):
                    s = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[s]), pa.array(nulls[s]), pa.array(occurrence[s]), pa.array(h[s].view(np.int64)),
                            pa.array(index_id[s]), pa.array(np.full(len(keys[s]), shard, np.int32)),
                            pa.array(firsts[:-1][s]), pa.array(np.diff(firsts)[s]),
                        ],
                        names=[c.split()[0] for c in _ENTRY.split(", ")],
                    )

    numbers = small_table(spark, {"shard": (shards, pa.int32())})
    return map_batches(numbers.repartition(len(shards), "shard"), read, _ENTRY)


def build_index(spark: SparkSession, files: TokenFiles) -> int:
    """Writes one minimal perfect hash file for each index number; returns the number of keys."""
    path = files.path
    columns = ["index_id", "hash", "shard", "first_token", "n_tokens"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        fs, folder = _open(path)
        rows = {c: np.concatenate([np.asarray(b.column(c)) for b in parts]) for c in columns}
        for index_id in np.unique(rows["index_id"]).tolist():
            own = rows["index_id"] == index_id
            h = rows["hash"][own].view(np.uint64)
            found = PerfectHash.build(h)
            slot = found.slots(h)
            by_slot = np.argsort(slot)
            head = np.array([found.n, found.seed, len(found.displace)], np.uint64).tobytes()
            data = [found.displace.astype(np.int32), fingerprints(h)[by_slot], rows["shard"][own][by_slot].astype(np.uint32)]
            data += [rows[c][own][by_slot].astype(np.uint64) for c in ("first_token", "n_tokens")]
            _publish(fs, folder, f"index-{index_id:05d}.mph", lambda out: out.write(head + b"".join(x.tobytes() for x in data)))  # noqa: B023
            yield pa.RecordBatch.from_pydict({"n_keys": pa.array([int(own.sum())], pa.int64())})

    dealt = entries(spark, files).select(columns).repartition(files.n_index, "index_id")
    return map_batches(dealt, build, "n_keys long").agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]


def _index(fs: pafs.FileSystem, path: str):
    with fs.open_input_file(path) as f:
        raw = f.read()
    n, seed, m = np.frombuffer(raw, np.uint64, 3).tolist()
    at = 24 + 4 * m
    return (
        PerfectHash(n, seed, np.frombuffer(raw, np.int32, m, 24)),
        np.frombuffer(raw, np.uint32, n, at),
        np.frombuffer(raw, np.uint32, n, at + 4 * n),
        np.frombuffer(raw, np.uint64, n, at + 8 * n).astype(np.int64),
        np.frombuffer(raw, np.uint64, n, at + 16 * n).astype(np.int64),
    )


def locate(keys: DataFrame, files: TokenFiles) -> DataFrame:
    """``key``, ``occurrence`` -> shard, first token and length, by the perfect hash index; absent keys give no row."""
    path, n_index = files.path, files.n_index
    schema = "key long, key_null boolean, occurrence long, shard int, first_token long, n_tokens long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("key")
            nulls = np.asarray(k.is_null())
            h = key_hashes(np.asarray(k.fill_null(0)), nulls, np.asarray(b.column("occurrence")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array((h % np.uint64(n_index)).astype(np.int32)), k, pa.array(nulls), b.column("occurrence")],
                names=["hash", "index_id", "key", "key_null", "occurrence"],
            )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(path)
        at, index = None, None
        for b in batches:
            ids = np.asarray(b.column("index_id"))
            for index_id in np.unique(ids).tolist():
                if index_id != at:
                    name = f"{folder}/index-{index_id:05d}.mph"
                    at, index = index_id, _index(fs, name) if fs.get_file_info(name).type == pafs.FileType.File else None
                if index is None:
                    continue
                rows = np.flatnonzero(ids == index_id)
                part = b.take(pa.array(rows))
                h = np.asarray(part.column("hash")).view(np.uint64)
                found, prints, shard, first, count = index
                slot = found.slots(h)
                hit = (slot >= 0) & (prints[slot] == fingerprints(h)) if found.n else np.zeros(len(h), bool)
                part, slot = part.filter(pa.array(hit)), slot[hit]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("key_null"), part.column("occurrence"), pa.array(shard[slot].astype(np.int32)), pa.array(first[slot]), pa.array(count[slot])],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    numbered = map_batches(
        keys.select(F.col("key").cast("long").alias("key"), F.col("occurrence").cast("long").alias("occurrence")),
        number, "hash long, index_id int, key long, key_null boolean, occurrence long",
    )
    dealt = numbered.repartition(n_index, "index_id").sortWithinPartitions("index_id")
    return map_batches(dealt, find, schema)


def lookup(keys: DataFrame, files: TokenFiles, *, batch_bytes: int = 8 << 20) -> DataFrame:
    """Token ids of the documents with these keys: key, occurrence, start, n_tokens, ids (uint32, little-endian)."""
    path, width, base = files.path, files.width, files.base
    schema = "key long, occurrence long, start long, n_tokens long, ids binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(path)
        dtype = {2: np.uint16, 4: np.uint32}[width]
        at, file = None, None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("key", "occurrence", "shard", "first_token", "n_tokens")]
            out, size = [], 0
            for key, occurrence, shard, first, n in zip(*columns, strict=True):
                if shard != at:
                    at, file = shard, fs.open_input_file(f"{folder}/shard-{shard:05d}.tok")
                ids = np.frombuffer(file.read_at(n * width, first * width), dtype).astype("<u4").tobytes()
                out.append((key, occurrence, base[shard] + first, n, ids))
                size += len(ids)
                if size >= batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES, strict=True)], names=names)

    found = locate(keys, files)
    dealt = found.repartition(max(1, files.n_shards), "shard").sortWithinPartitions("shard", "first_token")
    return map_batches(dealt.withColumn("key", F.when(~F.col("key_null"), F.col("key"))), read, schema)


_TYPES = [pa.int64()] * 4 + [pa.binary()]


def read_all(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Every stored document: the keys come from the shards' footers, their places from the index."""
    keys = entries(spark, files).select(F.when(~F.col("key_null"), F.col("key")).alias("key"), "occurrence")
    # written, so that a task has one worker at a time: a second one would keep a tokenizer of its own from the encoding
    return lookup(written(keys, "token-keys", lasting=True), files)
