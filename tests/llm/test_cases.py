"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for each operator."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waymesh import shared
from waymesh.llm import bpe, chat_format, common, decontaminate, html_text, language_id, near_dedup, quality, sharding, token_output, toxicity

LONG = " ".join(f"word{i % 997} stone{i}" for i in range(60_000))
#: Extra columns bear names that operators use inside.
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (5, "a b c"), (None, "null id"), (None, None), (6, LONG), (7, "É ß 中文 \U0001f600 x\x00y")]
EXTRA = "doc_id long, text string, lang string, row long, size long, n_words long, hash string, key string, shard int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "h", "k", 4) for i, t in texts], EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_tokens(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_output.write_tokens(docs, path, f"file://{tmp_path}/t", shards=3)
    assert token_output.build_index(spark, files) == len(TEXTS)
    found = token_output.read_all(spark, files).collect()
    assert len(found) == len(TEXTS) and sorted(r.start for r in found)[0] == 0
    assert sum(r.n_tokens == 1 for r in found) == 4
    spans = sorted((r.start, r.n_tokens) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    wanted = spark.createDataFrame([(4, 1), (6, 0), (99, 0), (4, 5)], "key long, occurrence long")
    assert sorted((r.key, r.occurrence) for r in token_output.lookup(wanted, files).collect()) == [(4, 1), (6, 0)]
    none = token_output.write_tokens(empty, path, f"file://{tmp_path}/e", shards=2)
    assert token_output.read_all(spark, none).count() == 0


def test_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "text", "key"))
    for r in bpe.decode(ids, path).collect():
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.decode(bpe.encode(empty, path, public_tokenizers.PATTERN), path).count() == 0


def test_merge_of_long_pieces():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        v = bpe.Vocabulary(f.read())

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((v.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in v.ranks), default=None)
            if best is None:
                return [v.ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    for _ in range(200):
        piece = bytes(rng.choice(b"aaabthe ingst\xc3\xa9") for _ in range(rng.randrange(1, 60)))
        assert v.merge(piece) == plain(piece)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for d, n in ((docs, len(TEXTS)), (empty, 0)):
        stats = quality.statistics_of(d)
        model = quality.fit(stats, labels)
        assert quality.judge(stats, model).count() == n
        kept = quality.quality_filter(d, model)
        assert kept.columns == d.columns
    assert {r.doc_id for r in quality.quality_filter(docs, quality.QualityModel(None, np.inf)).collect()} == {6}


def test_forest_matches_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 4))
    forest = quality.IsolationForest.fit(x, trees=20, size=64, seed=5)
    mean = 2 * (np.log(63) + 0.5772156649015329) - 2 * 63 / 64
    for row, score in zip(x[:50], forest.score(x[:50])):
        total = 0.0
        for t in range(20):
            at = 0
            while np.isfinite(forest.value[t, at]):
                at = int(forest.left[t, at]) + int(row[forest.column[t, at]] >= forest.value[t, at])
            total += forest.length[t, at]
        assert score == pytest.approx(2 ** (-total / 20 / mean))


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2000, 3))
    forest = quality.IsolationForest.fit(x, trees=100, size=256, seed=1)
    assert forest.score(np.full((1, 3), 9.0))[0] > np.quantile(forest.score(x), 0.999)


def test_sharding(docs, empty):
    found = sharding.shard_documents(docs, 4, keep=("row", "lang")).collect()
    assert len(found) == len(TEXTS) and {r.row for r in found} == {1}
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(empty, 4).count() == 0


def test_sharding_keeps_columns(docs):
    found = sharding.shard_documents(docs, 2, keep=("key", "n_words", "hash"))
    assert found.columns[:3] == ["key", "n_words", "hash"] and found.first()[:3] == ("k", 3, "h")
    with pytest.raises(ValueError, match="shard"):
        sharding.shard_documents(docs, 2, keep=("shard", "lang"))


def test_sharding_splits_a_hot_text(spark):
    rng = random.Random(1)
    own = table(spark, [(7 if i % 2 else i, "hot text" if i % 3 else "x" * rng.randrange(50)) for i in range(3000)])
    size = {}
    for r in sharding.shard_documents(own, 8).collect():
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert len(size) == 8 and max(size.values()) < 1.05 * sum(size.values()) / 8


def test_decontaminate(spark, docs, empty):
    long_item = " ".join(f"stone{i}" for i in range(0)) or LONG[1000:1200]
    bench = spark.createDataFrame([("a", "A, b C"), ("b", None), ("c", long_item), (None, "null id"), ("a", "zz"), ("d", "  ")], "item_id string, text string")
    for block_bytes in (4 << 20, 20):
        got = decontaminate.match(docs, bench, block_bytes=block_bytes).collect()
        assert len(got) == len(TEXTS)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append((r.n_words, [tuple(s) for s in r.spans], list(r["items"])))
        assert by[4] == [(3, [(0, 3)], ["a"])] * 2 and by[2] == [(0, [], [])]
        assert by[6][0][2] == ["c"] and sorted(by[None]) == [(0, [], []), (2, [(0, 2)], [""])]
    kept = decontaminate.clean_only(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, None} and kept.columns == docs.columns
    assert decontaminate.match(empty, bench).count() == 0 and decontaminate.clean_only(docs, bench.limit(0)).count() == len(TEXTS)


def test_decontaminate_a_window_that_many_share(spark, monkeypatch):
    """A licence line in every item and most documents: its documents meet the items in parts, and each finds all of them."""
    monkeypatch.setattr(decontaminate, "HOT_BLOCK", 100)
    line = " ".join(f"licence{i}" for i in range(12))
    own = table(spark, [(i, f"w{i} {line} v{i}" if i % 5 else f"w{i} own words") for i in range(1500)])
    bench = spark.createDataFrame([(f"i{k}", f"{line} q{k}") for k in range(6)], "item_id string, text string")
    got = decontaminate.match(own, bench, block_bytes=1).collect()
    assert len(got) == 1500
    for r in got:
        want = ([(1, 13)], [f"i{k}" for k in range(6)]) if r.doc_id % 5 else ([], [])
        assert ([tuple(s) for s in r.spans], list(r["items"])) == want


@pytest.mark.parametrize("block_bytes", [4 << 20, 1])
def test_decontaminate_matches_brute_force(spark, block_bytes):
    """With the benchmark sent to the tasks, and joined as a table."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(str(i), text(rng.choice([3, 9, 10, 11, 14]))) for i in range(40)]
    own = [(i, text(300)) for i in range(40)]
    got = {r.doc_id: r for r in decontaminate.match(table(spark, own), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes).collect()}
    clean = decontaminate.clean_only(table(spark, own), spark.createDataFrame(items[:3], "item_id string, text string"), block_bytes=block_bytes)
    some = decontaminate.match(table(spark, own), spark.createDataFrame(items[:3], "item_id string, text string")).where("size(spans) = 0")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in some.collect())
    for i, t in own:
        words, hit, names = t.split(), set(), set()
        for name, item in items:
            w = item.split()
            n = min(10, len(w))
            for a in range(len(w) - n + 1):
                for b in range(len(words) - n + 1):
                    if words[b : b + n] == w[a : a + n]:
                        hit |= set(range(b, b + n))
                        names.add(name)
        assert {p for s in got[i].spans for p in range(s.start, s.end)} == hit and list(got[i]["items"]) == sorted(names)


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, 0), (6, 1, None), (None, 1, 1), (3, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    for d, n in ((docs, len(TEXTS)), (empty, 0)):
        net = toxicity.fit_net(d, labels)
        scored = toxicity.logits(d, net)
        model = toxicity.calibrate(scored, labels, net)
        found = toxicity.judge(scored, model).collect()
        assert len(found) == n and all(0 <= r.score <= 1 for r in found)
        assert toxicity.toxicity_filter(d, model).columns == d.columns


def by_hash(spark, ids):
    return [r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", "xxhash64(id) h").orderBy("h", "id").collect()]


def test_byte_shares():
    assert common.byte_shares({"a": 1, "b": 50, "c": 2}, 90) == {"b": 50, "c": 20, "a": 20}
    with pytest.raises(ValueError):
        common.byte_shares({0: 60, 1: 50}, 100)


def test_toxicity_sample_skips_a_large_text(spark):
    """The first text of a label in the order of hashes exceeds the label's bytes: the others are learned from."""
    ids = by_hash(spark, range(40))
    docs = table(spark, [(i, "vile " * 400 if i == ids[0] else ("vile words" if i in ids[:20] else "kind words")) for i in ids])
    labels = spark.createDataFrame([(i, int(i in ids[:20])) for i in ids], "doc_id long, toxic int")
    net = toxicity.fit_net(docs, labels, held_out=None, sample_bytes=1000)
    assert net is not None
    model = toxicity.calibrate(toxicity.logits(docs, net), labels, net, held_out=None)
    assert {r.doc_id for r in toxicity.toxicity_filter(docs, model).collect()} == set(ids[20:])
    none = toxicity.ToxicityModel(toxicity.fit_net(docs, labels.where("toxic = 0"), held_out=None))
    with pytest.raises(ValueError, match="both labels"):
        toxicity.toxicity_filter(docs, none)


def test_scores_match_a_plain_convolution():
    net = toxicity.ConvNet.fresh(3)
    net.bias = [np.full(toxicity.FILTERS, 0.1 * k, np.float32) for k in range(len(toxicity.WIDTHS))]
    texts = ["Some words, and SOME more: words again \u00c9t\u00e9", "one", "", None]
    for text, got in zip(texts, toxicity.Scorer(net).logits([t.encode() if t is not None else None for t in texts])):
        words = "".join(c if c.isalpha() and (c.isascii() or ord(c) > 127) else " " for c in (text or "").lower()).split()
        vectors = [sum(net.table[b] for b in toxicity.buckets_of(w.encode())) for w in words] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
        logit, k = net.shift, 0
        for width, weight, bias in zip(toxicity.WIDTHS, net.filters, net.bias):
            for f in range(toxicity.FILTERS):
                values = [bias[f] + sum(vectors[i + j] @ weight[j * toxicity.DIM : (j + 1) * toxicity.DIM, f] for j in range(width)) for i in range(max(1, len(words)))]
                logit += max(0.0, max(values)) * net.out[k]
                k += 1
        assert got == pytest.approx(logit, abs=1e-4)


def test_scores_do_not_depend_on_pieces(monkeypatch):
    scorer = toxicity.Scorer(toxicity.ConvNet.fresh(1))
    texts = [LONG.encode(), b"", None, b"one two three"]
    whole = scorer.logits(texts)
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert np.allclose(scorer.logits(texts), whole, atol=1e-5)


def components_of(found):
    return {(r.doc_id, r.component_id) for r in found}


def test_near_dedup(spark, docs, empty):
    found = near_dedup.near_duplicates(docs, near_dedup.Plan()).collect()
    assert len(found) == len(TEXTS)
    assert {(4, 4), (5, 4), (6, 6), (1, 1), (2, 2), (None, None)} <= components_of(found)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, None}


def test_near_dedup_of_a_hot_family(spark, monkeypatch):
    """A chain of edits, a large group of near copies and of equal ones: every link is found, in blocks smaller than the group."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    own, words = [], list(base)
    for i in range(60):
        words = list(words)
        words[rng.randrange(120)] = f"n{i}"
        own.append((i, " ".join(words)))
    own += [(1000 + i, " ".join(base)) for i in range(80)]
    for i in range(80):
        w = list(base)
        w[rng.randrange(120)] = f"m{i}"
        own.append((2000 + i, " ".join(w)))
    rng.shuffle(own)
    own += [(3000 + i, " ".join(base[:70] + [f"x{i}.{k}" for k in range(50)])) for i in range(60)]  # a shared passage, and nothing else
    own += [(5, "again an id, " + " ".join(base)), (5, ""), (3001, "")]
    plan = near_dedup.Plan(shingle=2, block=16, large=40, sub_bands=64)
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    found = near_dedup.near_duplicates(table(spark, own), plan).collect()
    assert len(found) == len(own)
    got = {r.doc_id: r.component_id for r in found}
    own = [(i, t) for i, t in own if t and not t.startswith("again")]
    sets = {i: {(a, b) for a, b in zip(t.split(), t.split()[1:])} for i, t in own}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    joined = {i: top(i) for i in sets}
    by_id = {joined[5], joined[1000]}  # rows of one id are one document, and one of them equals the family all but for a few words
    assert got == {i: min(by_id) if c in by_id else c for i, c in joined.items()}


def test_language(spark, docs, empty):
    for d, n in ((docs, len(TEXTS)), (empty, 0)):
        model = language_id.fit(d)
        found = language_id.predict(d, model).collect()
        assert len(found) == n
        assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3))


def test_language_sample_skips_a_large_text(spark):
    """The first text in the order of hashes exceeds the bytes of the sample, and one language is rare: all are learned."""
    ids = by_hash(spark, range(60))
    of = {i: "el" if i == ids[-1] else ("en" if k % 2 else "de") for k, i in enumerate(ids)}
    text = {"en": "the house with the garden", "de": "der hund und die katze", "el": "\u03bb\u03cc\u03b3\u03bf\u03c2 \u03ba\u03b1\u03b9 \u03c6\u03c9\u03c2"}
    docs = spark.createDataFrame([(i, text[of[i]] * (400 if i == ids[0] else 1), of[i]) for i in ids], "doc_id long, text string, lang string")
    model = language_id.fit(docs, held_out=None, sample_rows=60, sample_bytes=3000)
    assert model.langs == ["de", "el", "en"]
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == of
    with pytest.raises(ValueError):
        language_id.fit(docs, held_out=None, sample_bytes=60)


def test_language_matches_a_dictionary(spark):
    """Probabilities from n-grams counted in a dictionary."""
    rng = np.random.default_rng(1)
    model = language_id.LanguageModel(["a", "b", "c"], rng.normal(0, 0.1, (language_id.BUCKETS, 3)), rng.normal(0, 1, 3), 1.7)
    text = "Der Hund, 2 K\u00e4fer"
    letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    counts = {}
    for n in language_id.ORDERS:
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            counts[gram] = counts.get(gram, 0) + 1
    bucket = {g: int(language_id.buckets_of(np.array([ord(c) for c in g], np.uint64))[-1]) for g in counts}  # the last is the longest n-gram
    total = sum(counts.values())
    logits = sum(n / (total + 60) * 100 * model.weights[bucket[g]] for g, n in counts.items()) + model.shift
    p = np.exp(logits / 1.7) / np.exp(logits / 1.7).sum()
    (lang,), (score,) = model.predict([text.encode()])
    assert lang == "abc"[int(p.argmax())] and score == pytest.approx(p.max())


def test_language_pieces(monkeypatch):
    points = language_id.letters_of(LONG[:5000].encode())
    whole = np.bincount(language_id.buckets_of(points), minlength=language_id.BUCKETS)
    monkeypatch.setattr(language_id, "PIECE", 97)
    assert (np.bincount(np.concatenate(list(language_id.pieces(points))), minlength=language_id.BUCKETS) == whole).all()


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b>
three<p>Four<br>five<ul><li>a<li>b<ul><li>c</ul></ul><div hidden>no</div><div style="display:none">no</div><script>no()</script>
<table><tr><td>x<td>longer<tr><td>yy<td>z</table><pre>  keep
   this</pre><ol start=3><li>q</ol>&amp; end"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain <b"), (5, "<div>" * 3000 + "deep"), (1, PAGE)], "page_id long, html string")
    got = [(r.page_id, r.text) for r in html_text.extract(pages).collect()]
    text = dict(got)
    assert len(got) == 6 and text[2] is None and text[3] == "" and "plain" in text[4] and "deep" in text[5]
    lines = text[1].split("\n")
    assert lines[0] == "Head" and lines[1] == "" and "One two three" in lines and "Four" in lines and "five" in lines
    assert "- a" in lines and "  - c" in lines and "3. q" in lines and "   this" in lines and "& end" in text[1]
    assert [x.index("|") for x in lines if "|" in x] == [3, 3] and "no" not in text[1].replace("now", "")


WHOLE = [
    ("a<br>b", "a\nb"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div>b<div>c</div>", "a\nb\nc"), ("  a \n b  ", "a b"), ("<b>a</b><i>b</i> c", "ab c"),
    ("<h1>a</h1>b", "a\n\nb"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol><li>a<ul><li>b</ul><li>c</ol>", "1. a\n  - b\n2. c"),
    ("<ol start=5><li>a<li value=9>b<li>c</ol>", "5. a\n9. b\n10. c"), ("<ol reversed><li>a<li>b<li hidden>x</ol>", "2. a\n1. b"),
    ("<ol reversed start=7><li>a<li value=-1>b<li>c</ol>", "7. a\n-1. b\n-2. c"), ("<dl><dt>a<dd>b</dl>", "a\n  b"), ("a<hr>b", "a\n---\nb"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("<img alt='x y'>z", "x yz"), ("a<script>b</script>c", "ac"), ("a<style>b</style>c", "ac"), ("a<!-- b -->c", "ac"),
    ("<p hidden>a</p>b", "b"), ("<p style='display: none'>a</p>b", "b"), ("a <span aria-hidden=true>b</span> c", "a b c"),
    ("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c<img alt=d></p>e", "b\n\ne"), ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
    ("<p style='visibility:collapse'>a<span>b</span></p>c", "c"), ("<div style='visibility:hidden'><p hidden style='visibility:visible'>a</p></div>b", "b"),
    ("<details><summary>a</summary><p>b</p></details>c", "a\nc"), ("<details open><summary>a</summary>b</details>c", "a\nb\nc"), ("<details>a</details>b", "b"),
    ("<div>" * 250 + "<table><tr><td>aaa<td>b<tr><td>c<td>d</table>", "aaa | b\nc   | d"), ("<div>" * 1900 + "<ol><li>a<li>b</ol>", "1. a\n2. b"), ("<noscript>a</noscript>b", "b"),
    ("<template>a</template>b", "b"), ("<q>a</q>", '"a"'), ("&lt;a&gt; &eacute;&#65;", "<a> \u00e9A"), ("a&nbsp;b", "a\u00a0b"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"), ("<table><td rowspan=2>A<td>B<tr><td>C<td>D</table>", "A | B\n  | C | D"),
    ("<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>", "wide one | z\na | b    | c"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a | b\n  | c\nd"), ("<table><caption>t</caption><tr><td>a</table>", "t\na"),
    ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb |"), ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>", "a   | b\n    | c"),
    ("<textarea> a <b></textarea>", " a <b>"), ("<title>a</title><body>b", "b"), ("<head><meta x><title>t</title></head>a", "a"), ("a<wbr>b", "ab"),
    ("<blockquote>a</blockquote>b", "a\n\nb"), ("</p>a</div>b", "ab"), ("<a href=x>a</a", "a"), ("<input type=hidden value=a><input value=b>", "b"), ("<b><p>a</b>b", "ab"), ("<span>a<div>b</span>c</div>d", "a\nbc\nd"),
    ("<div>" * 2100 + "<script>no</script><p hidden>no<b>no</b></p><style>no</style>a<p>b</p><svg><title>no</title></svg>c" + "</div>" * 2100 + "<ul><li>d</ul>", "a\nbc\n\n- d"),
    ("<div>" * 250 + "<script>no</script><p hidden>no<b>no</b></p><style>no</style>a<p>b</p><svg><title>no</title></svg>c" + "</div>" * 250 + "<ul><li>d</ul>", "a\n\nb\n\nc\n\n- d"),
]


@pytest.mark.parametrize("page, text", WHOLE)
def test_html_whole_pages(page, text):
    assert html_text.render(page) == text


def test_html_formulas_diagrams_and_choices():
    math = "<p>So <math><semantics><mrow><mi>x</mi> <mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>tex</annotation></semantics></math> holds."
    assert html_text.render(math) == "So x= 1 2 holds."
    svg = '<p>a<svg><title>no</title><defs><text>no</text></defs><style>no</style><rect x=1 /><desc/><g><text>one <tspan>A</tspan></text><text><![CDATA[B < C]]></text></g></svg><p>b'
    assert html_text.render(svg) == "a\none A\nB < C\n\nb"
    assert html_text.render("<svg><defs><path><p>left open") == "left open"
    options = "<option>one<option selected>two<optgroup label=g><option>three"
    assert html_text.render(f"<p>of <select>{options}</select> it") == "of two it"
    assert html_text.render("<select><option disabled>no<option label=yes>no</select>") == "yes"
    assert html_text.render(f"<select multiple>{options}</select>") == "one\ntwo\ng\nthree"
    assert html_text.render("<select><option>a<input value=b>c") == "a bc"


def test_chat(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "f", '{"y": 1, "x": "s"}', None), (1, 1, "b", "f", '{"x": 5}', ["a", "zz", "b"]), (1, 2, "c", "g", "[1]", ["d"]), (1, 3, "d", "f", None, ["c"]),
            (1, 4, None, "f", '{"x": "s", "y": 2.5}', None), (2, 0, "a", None, "{}", None), (2, 0, "a", "f", '{"x":"s","y":1}', None), (None, 0, "q", "f", '{"x":"s","y":1}', None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 5, "a", "late"), (1, 4, "a", 'ok "q"'), (1, 6, "x", None), (3, 0, None, "n")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "STRING", True), ("f", "y", "DOUBLE", True)], "name string, param string, type string, required boolean")
    found = chat_format.link_calls(calls, results, schemas).collect()
    assert len(found) == 10
    by = {(r.conv_id, r.call_id, r.status): r for r in found}
    a, b = by[1, "a", "linked"], by[1, "b", "pending"]
    assert json.loads(a.json) == {"arguments": {"x": "s", "y": 1}, "content": 'ok "q"', "id": "a", "name": "f", "status": "linked"}
    assert a.json == json.dumps(json.loads(a.json), sort_keys=True, separators=(",", ":")) and a.n_results == 2 and a.errors == []
    assert b.dangling == 2 and b.errors == ["x: BIGINT for STRING", "y: missing"] and a.level < b.level
    assert by[1, "c", "pending"].level is None and by[1, "c", "pending"].errors == ["arguments: no object"]
    assert (1, "x", "orphan") in by and (1, None, "unidentified") in by and (None, "q", "unidentified") in by
    for conv in (1, 2):
        seq = sorted(r.seq for r in found if r.conv_id == conv)
        assert seq == list(range(len(seq)))
    assert chat_format.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_chat_without_schemas_and_turns(spark):
    calls = spark.createDataFrame([(1, None, "a", "f", "{}", None, 1), (1, 2, "b", "f", '{"a":1,"a":2}', ["a"], 2)], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, row long")
    results = spark.createDataFrame([(1, None, "a", None, "x"), (1, 3, None, "t", "x"), (1, 3, None, "t", "x")], "conv_id long, turn long, call_id string, content string, level string")
    schemas = spark.createDataFrame([], "name string, param string, type string, required boolean, row long")
    found = chat_format.link_calls(calls, results, schemas).collect()
    by = {(r.call_id, r.status): r for r in found}
    assert len(found) == 4 and sorted(r.seq for r in found) == [0, 1, 2, 3] and sum(r.status == "orphan" for r in found) == 2
    assert by["a", "linked"].errors == ["tool: f has no schema"] and by["b", "pending"].errors == ["arguments: no object"]


@pytest.mark.parametrize("folded", [256, 3])
def test_chat_levels_match_a_walk(spark, monkeypatch, folded):
    """Chains against the turns, layers of several dependencies, and cycles, inside rows and by doubling."""
    monkeypatch.setattr(chat_format, "FOLDED", folded)
    rng = random.Random(2)
    needs = {}
    for conv in range(8):
        for k in range(12):
            needs[conv, k] = sorted({rng.randrange(12) for _ in range(rng.choice([0, 1, 1, 2]))} - {k})
    needs |= {(9, k): [k + 1] for k in range(40)} | {(9, 40): []}
    needs |= {(10, k): [k + 1, k + 2] for k in range(6)} | {(10, 6): [], (10, 7): [6]}
    rows = [(c, k, f"t{k}", "f", "{}", [f"t{d}" for d in own]) for (c, k), own in needs.items()]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>").withColumn("row", F.monotonically_increasing_id())
    got = {(r.conv_id, r.turn): r.level for r in chat_format.levels(calls).join(calls, "row").collect()}
    level = {}
    while free := [x for x, own in needs.items() if x not in level and all((x[0], d) in level for d in own)]:
        level |= {x: max((level[x[0], d] for d in needs[x]), default=-1) + 1 for x in free}
    turns = {c for c in {c for c, _ in needs} if all(d < k for (e, k), own in needs.items() if e == c for d in own)}
    assert got == {x: x[1] if x[0] in turns else level.get(x) for x in needs} and len(level) < len(needs)


def test_folds(spark):
    rows = spark.createDataFrame([(5,), (77,), (None,)], "doc_id long").select("doc_id", common.crc_split("doc_id", 4).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(b"5") % 4, zlib.crc32(b"77") % 4, 0]
