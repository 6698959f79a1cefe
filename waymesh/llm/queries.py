"""The thin ``opN_<name>`` queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, decontaminate, exact_dedup, html_text, language_id, near_dedup, quality, sharding, token_output, toxicity, vector_codes
from .common import crc_split, scratch_path, table, written

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_output.write_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), scratch_path(spark, "tokens"), end_id=1
    )
    token_output.build_index(spark, files)
    return token_output.read_all(spark, files).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.statistics_of(table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    return quality.judge(stats, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


def bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_hit", decontaminate.covered(F.col("spans"))).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit_net(docs, labels)
    scored = written(toxicity.logits(docs, net), "toxicity")
    return toxicity.judge(scored, toxicity.calibrate(scored, labels, net)).select(
        "doc_id",
        (crc_split("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        "threshold",
        "toxic",
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Plan(shingle=2))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs)).select(
        "doc_id", (crc_split("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat_format.link_calls(*chat_format.turns_as_calls(table(spark, sf_dir, "conversations")))
    return linked.select(
        "conv_id",
        "call_id",
        "name",
        "status",
        F.coalesce("level", F.lit(-1)).alias("level"),
        "seq",
        F.array_join("errors", "; ").alias("errors"),
        "n_results",
        "dangling",
        F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return coded.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_html_text": op2_html_text,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_sharding": op5_sharding,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_collocations": op11_collocations,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_vector_codes": op13_vector_codes,
}

#: Words as lists; windows joined on their words; every word position inside an occurrence counted once.
OP6_SQL = r"""
with words as (
  select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
bench as (
  select distinct id as item_id, size, w[i:i + size - 1] as words from (
    select id, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from words where side = 'b' and len(w) > 0)),
sizes as (select distinct size from bench),
grams as (
  select id as doc_id, i, size, w[i:i + size - 1] as words from (
    select id, w, size, unnest(range(1, len(w) - size + 2)) as i from words, sizes where side = 'd' and len(w) >= size)),
hits as (select distinct doc_id, i, size, item_id from grams join bench using (size, words)),
positions as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hits) group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from hits group by 1)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join positions on id = positions.doc_id left join items on id = items.doc_id where side = 'd'
"""

#: Chat turns as calls and results, linked by identifier; levels by walks of every length; JSON with sorted keys.
OP10_SQL = """
with recursive turns as (select conv_id, turn, role, text, coalesce(length(text), 0) as n, 'c' || conv_id || '-' as c from conversations),
calls as (
  select conv_id, turn, c || turn as call_id, case role when 'user' then 'ask' when 'system' then 'configure' else role end as name, text,
    (n + turn) % 10 as kind, case conv_id % 4 when 0 then [c || (turn - 2)] when 1 then [c || (turn + 2)]
      when 2 then case when turn % 4 < 2 then [c || (turn + 2), c || (turn - 4), 'nowhere'] else [] end
      else case when turn % 4 < 2 then [c || (turn + 2)] else [c || (turn - 2), c || turn] end end as needs
  from turns where role is distinct from 'assistant'),
told as (
  select conv_id, turn, case n % 8 when 1 then 'x' || c || turn when 2 then null else c || (turn - 1) end as call_id, text as content from turns where role = 'assistant'
  union all select conv_id, turn + 1, c || (turn - 1), 'again: ' || text from turns where role = 'assistant' and n % 8 = 0),
results as (
  select conv_id, call_id, min(turn) as turn, arg_min(content, struct_pack(turn := turn, content := content)) as content, count(*) as n from told where call_id is not null group by 1, 2),
asked as (select a.conv_id, a.call_id, a.turn, b.call_id as dep, b.turn as dep_turn from (select conv_id, call_id, turn, unnest(needs) as need from calls) a
  left join calls b on b.conv_id = a.conv_id and b.call_id = a.need and b.call_id <> a.call_id),
deep as (select conv_id, count(*) as n from calls where conv_id in (select conv_id from asked where dep is not null and dep_turn >= turn) group by 1),
walk as (select conv_id, call_id, 0 as len from calls where conv_id in (select conv_id from deep)
  union select w.conv_id, a.call_id, w.len + 1 from walk w join asked a on a.conv_id = w.conv_id and a.dep = w.call_id join deep d on d.conv_id = w.conv_id where w.len < d.n),
longest as (select conv_id, call_id, case when max(len) < any_value(n) then max(len) end as level from walk join deep using (conv_id) group by 1, 2),
checked as (select *, case when kind in (3, 4) then ['arguments: no object'] when name not in ('ask', 'configure') or name is null then ['tool: ' || coalesce(name, '') || ' has no schema']
  else list_sort(list_filter([case when kind = 1 then 'extra: unknown' end, case when kind = 2 or text is null then 'text: missing' end, case when kind = 0 then 'turn: STRING for BIGINT' end],
    lambda x: x is not null)) end as errors,
  case when kind = 3 then '[' || turn || ']' when kind <> 4 then '{' || concat_ws(',', case when kind = 1 then '"extra":true' end,
    case when kind <> 2 then '"text":' || to_json(text)::varchar end, '"turn":' || case when kind = 0 then '"' || turn || '"' else turn::varchar end) || '}' end as arguments from calls),
rows as (
  select k.conv_id, k.call_id, k.name, case when r.n is null then 'pending' else 'linked' end as status, k.turn, case when d.n is null then k.turn else l.level end as level, errors,
    coalesce(r.n, 0) as n_results, (select count(*) from asked a where a.conv_id = k.conv_id and a.call_id = k.call_id and a.dep is null) as dangling, r.content, k.arguments, 0 as orphan
  from checked k left join results r on r.conv_id = k.conv_id and r.call_id = k.call_id left join deep d on d.conv_id = k.conv_id
    left join longest l on l.conv_id = k.conv_id and l.call_id = k.call_id
  union all
  select r.conv_id, r.call_id, null, 'orphan', r.turn, r.turn, [], r.n, 0, r.content, null, 1 from (select conv_id, call_id, turn, content, n from results
    union all select conv_id, null, turn, content, 1 from told where call_id is null) r where not exists (select 1 from calls k where k.conv_id = r.conv_id and k.call_id = r.call_id))
select conv_id, call_id, name, status, coalesce(level, -1) as level, row_number() over (partition by conv_id order by level nulls last, turn, orphan, call_id nulls first, content) - 1 as seq,
  array_to_string(errors, '; ') as errors, n_results, dangling,
  sha256('{' || concat_ws(',', '"arguments":' || arguments, '"content":' || to_json(content)::varchar, '"id":' || to_json(call_id)::varchar,
    '"name":' || to_json(name)::varchar, '"status":' || to_json(status)::varchar) || '}') as json_sha256
from rows
"""

#: Every phrase of every piece, counted as text; products as 128-bit integers.
OP11_SQL = r"""
with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from texts)),
grams as (select lang, size, w[i:i + size - 1] as g from (
  select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from pieces, (select unnest([1, 2, 3]) as size) where len(w) >= size)),
f as materialized (select lang, size, g, count(*)::hugeint as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
cand as materialized (select lang, size, g, f as a from f where size > 1 and f >= 10),
cuts as (select c.lang, c.g, c.a, k, l.f as l, r.f as r, 1000000 * c.a * c.a // (l.f * r.f) as score
  from (select *, unnest(range(1, size)) as k from cand) c join f l on l.lang = c.lang and l.g = c.g[:k] join f r on r.lang = c.lang and r.g = c.g[k + 1:]),
best as (select lang, g, a, l, r, score from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
inner2 as (select lang, unnest([g[1:2], g[2:3]]) as g, a as above from cand where size = 3),
free as (select b.*, array_to_string(g, ' ') as phrase from best b where not exists (select 1 from inner2 i where i.lang = b.lang and i.g = b.g and 100 * i.above >= 50 * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from free)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""

#: Normalised texts themselves are the groups; the longest original, then the smallest id stays.
OP12_SQL = r"""
with texts as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents)
select doc_id, first_value(doc_id) over longest as keep_id, count(*) over (partition by body) as group_size,
  row_number() over longest = 1 as kept, sha256(body) as text_sha256
from texts window longest as (partition by body order by length(t) desc, doc_id)
"""



def _op13_sql(rounds: int = 4) -> str:
    """Lloyd's rounds written out; components are doubles that hold integers, so inner products are exact."""
    steps = ["""
with kept as materialized (
  select row_number() over (order by vec_id) - 1 as i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (select i, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] as w from kept, range(4) t(p)),
book0 as materialized (select p, i as e, w from parts where i < 256)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} as materialized (
  select i, p, min(struct_pack(d := list_inner_product(x.w, x.w) - 2 * list_inner_product(x.w, c.w) + list_inner_product(c.w, c.w), e := c.e)) as best
  from parts x join book{k} c using (p) group by i, p)""")
        if k < rounds:
            steps.append(f"""sums{k} as (select p, e, k, sum(x)::hugeint as s, count(*) as n from (
  select p, best.e as e, unnest(w) as x, generate_subscripts(w, 1) as k from near{k} join parts using (i, p)) group by all),
book{k + 1} as materialized (select p, e, coalesce(n.w, b.w) as w from book{k} b left join (
  select p, e, list(((s - ((s % n) + n) % n) // n)::double order by k) as w from sums{k} group by p, e) n using (p, e))""")
    return ",\n".join(steps) + f""",
coded as (select i, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from near{rounds} group by i)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (i),
  (select sha256(string_agg(array_to_string(list_transform(w, lambda x: x::bigint), ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
"""


ORACLES: dict[str, str] = {"op6_decontaminate": OP6_SQL, "op10_chat_format": OP10_SQL, "op11_collocations": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_vector_codes": _op13_sql()}
