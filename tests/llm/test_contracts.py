"""The numbered queries at a small scale against plain Python, the libraries, SQL or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import SF

from waymesh.llm import queries


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    found = queries.QUERIES[name](spark, SF).collect()
    return {r.doc_id: r for r in found}, found


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, found = rows(spark, "op1_token_ids")
    assert len(found) == len(docs)
    start = 0
    for i in sorted(docs):
        ids = tok.encode(docs[i].text or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3(spark, docs):
    got, found = rows(spark, "op3_quality")
    assert len(found) == len(docs)
    for i, d in docs.items():
        text = d.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count = Counter(windows)
        hit = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        r = got[i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (failed and r.kept)
    assert sum(r.kept for r in found) > 0.6 * sum(not r.base_failed for r in found)


def test_op4(spark, docs):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, found = rows(spark, "op4_bpe")
    assert len(found) == len(docs)
    for i, d in docs.items():
        ids = enc.encode_ordinary(d.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((d.text or "").encode()))


def test_op5(spark, docs):
    got, found = rows(spark, "op5_sharding")
    assert len(found) == len(docs)
    size, slots, of_text = Counter(), {}, {}
    for i, d in docs.items():
        r, raw = got[i], (d.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        of_text.setdefault(raw, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) <= set(range(16))
    assert all(len(shards) == 1 for shards in of_text.values())  # equal texts stay together: no group here is larger than a shard's tolerance
    largest = max(r.size for r in found)
    assert max(size.values()) - min(size.values()) <= 2 * largest + 0.01 * sum(size.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    same = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert same(got).equals(same(want))


def test_op7(spark, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got, found = rows(spark, "op7_toxicity")
    assert len(found) == len(docs)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)


def components(links, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {i: top(i) for i in ids}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def test_op8(spark, docs):
    got, found = rows(spark, "op8_near_dedup")
    assert len(found) == len(docs)
    sets = {i: shingles(d.text, 2) for i, d in docs.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, docs)
    assert links
    for i in docs:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)


def test_op9(spark, docs):
    got, found = rows(spark, "op9_language_id")
    assert len(found) == len(docs)
    langs = {d.lang for d in docs.values() if d.lang is not None}
    for r in found:
        text = docs[r.doc_id].text
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1 and r.lang_pred in langs | {"und"}
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r.lang_pred == docs[r.doc_id].lang for r in found if r.held_out and docs[r.doc_id].lang]
    assert sum(held) >= 0.9 * len(held)


def test_op2(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    found = queries.QUERIES["op2_html_text"](spark, SF).collect()
    assert len(found) == pages and all("<script" not in (r.text or "") for r in found)
