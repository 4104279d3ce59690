"""The dealt operators as queries over whole tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, langid, lattice, lines, multiindex, packing, simhash, spans, tokencount, urls, whitening, winnow
from .common import held_out, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = langid.labelled_sample(docs.where(~held_out(F.col("doc_id"), 3)))
    return langid.identify(docs.select("doc_id", "text"), samples).select(
        "doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "lang_pred", "score")


def op3_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.drop_repeats(docs).select("doc_id", "text", "n_sentences", "n_removed", "first_docs")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return winnow.digests(winnow.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_similar_lines(docs).select("doc_id", "text", "n_lines", "n_removed", "kept_in")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = whitening.fixed_point(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    return whitening.whiten(points, whitening.fit(points))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {q.__name__: q for q in (
    op1_best_fit_packing, op2_language_id, op3_lattice_scores, op4_multi_index, op5_sentence_spans, op6_chat_format,
    op7_decontamination, op8_simhash, op9_url_filter, op10_fuzzy_lines, op11_whitening,
    op12_fill_in_middle, op13_token_counts)}

_ESCAPED = r"""regexp_replace(regexp_replace(replace(%s, '\', '\\'), '<(\||s>|/s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(INST\]|/INST\])', '[\\\1', 'g')"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

ORACLE: dict[str, str] = {
    "op6_chat_format": f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, coalesce(role = lag(role) over w, false) as same, coalesce(role = lead(role) over w, false) as more from t
      window w as (partition by conv_id order by turn, role, text)),
p as (select *, case when same then '<|part|>' else '<|turn|>' || {_ESCAPED % "role"} || '<|text|>' end || {_ESCAPED % "text"}
      || case when more then '' else '<|end|>' end as piece from m)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(piece)) as bigint) as formatted_chars
from p group by conv_id""",
    "op7_decontamination": f"""
with i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
iw as (select item, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from i where len(w) > 0),
win as (select distinct item, n, array_to_string(w[s:s + n - 1], ' ') as x from iw),
d as (select doc_id, {_WORDS} as w from documents),
dw as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from win) where len(w) >= n),
hit as (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as x from dw),
met as (select doc_id, s, hit.n as n, item from hit join win on hit.x = win.x and hit.n = win.n),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from met) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from met) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)""",
    "op12_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
  sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select doc_id, t, u, cast(len(u) as bigint) as n, [cast(('0x' || x[8 * k + 1:8 * k + 8]) as bigint) for k in range(4)] as h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain'
    when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end)
    as output_sha256, sha256(t) as restored_sha256
from p""",
}
