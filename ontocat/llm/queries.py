"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ontocat.llm import (ann, chat_format, decontaminate, exact_search, line_dedup, mixing, ngram_join, phrases, quality, sharding, token_counts,
                         url_filter, vector_codes)
from ontocat.llm.common import read, sha256_hex, shipped

#: The rules that the url query applies.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: The conversation that every run formats besides the table's.
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    match = F.col("match")
    return found.select("doc_id", match["n_words"].alias("n_words"), decontaminate.n_hit(match).alias("n_hit"),
                        F.size(match["items"]).cast("bigint").alias("n_items"),
                        sha256_hex(F.concat_ws(",", match["items"])).alias("items_sha256"),
                        (F.size(match["items"]) > 0).alias("contaminated"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(quality.fold(F.col("doc_id")) == quality.HELD_OUT, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "placed.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_documents(docs).select("doc_id", "mixed.*")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge_urls(pages, rules).select("page_id", "judged.*")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(read(spark, sf_dir, "documents").select("text")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "deduped.n_lines", "deduped.n_deleted", sha256_hex(F.col("deduped.text")).alias("text_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_format.format_conversations(turns.unionByName(extra))
    back = formatted.mapInArrow(chat_format.read_back_batches, "conv_id bigint, n_turns bigint, said string, loss string, formatted_chars bigint")
    return back.select("conv_id", "n_turns", sha256_hex(F.col("said")).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), sha256_hex(F.col("loss")).alias("loss_sha256"),
                       "formatted_chars")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read(spark, sf_dir, "embeddings"))


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: shipped(f) for f in (op1_decontaminate, op2_quality, op3_sharding, op4_mixing, op5_nearest, op6_url_filter,
                                   op7_token_counts, op8_line_dedup, op9_ngram_join, op10_chat_format, op11_phrases,
                                   op12_vector_codes, op13_exact_search)}
QUERIES["pipeline"] = shipped(corpus_pipeline.run)

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLE = {
    "op1_decontaminate": rf"""
with d as (select doc_id, row_number() over () as r, {_WORDS.format(_LOWER.format('text'))} as w from documents),
b as (select item_id, {_WORDS.format(_LOWER.format('text'))} as w from benchmark where item_id is not null),
win as (select distinct item_id, least(len(w), 10) as k,
               array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as g
        from (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as s from b where len(w) > 0)),
occ as (select r, k, s, array_to_string(w[s:s + k - 1], ' ') as g
        from (select r, w, k, unnest(range(1, len(w) - k + 2)) as s
              from d, (select distinct k from win) where len(w) >= k)),
hit as (select r, item_id, occ.k, s from occ join win on occ.g = win.g and occ.k = win.k),
cov as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + k)) as p from hit) group by r),
its as (select r, count(*) as n_items, string_agg(i, ',' order by i) as items
        from (select distinct r, cast(item_id as varchar) as i from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (r) left join its using (r)""",
    "op6_url_filter": rf"""
with p as (select page_id, {_LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
q as (select *, case
  when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
  when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
  when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
  when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule from p)
select *, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from q""",
    "op9_ngram_join": r"""
with recursive d as (
  select doc_id, row_number() over () as r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
  from documents),
s as (select distinct r, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                     when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select r, count(*) as n from s group by r),
common as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r group by a.r, b.r),
link as (select x, y from common join n nx on nx.r = x join n ny on ny.r = y where 100 * c >= 90 * (nx.n + ny.n - c)),
reach(r, t) as (select r, r from d union select reach.r, link.y from reach join link on link.x = reach.t)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(o.doc_id) as component_id
from d left join n using (r) join reach using (r) join d o on o.r = reach.t group by d.r, d.doc_id, n.n""",
    "op10_chat_format": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(role, '(\\|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\])', '\\\1', 'g') as er,
             regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\])', '\\\1', 'g') as et from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(er) + length(et) + length('<s>[ROLE][/ROLE][INST][/INST]</s>')) as bigint) as formatted_chars
from e group by conv_id""",
    "op11_phrases": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as r,
         regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
  from documents),
spots as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces where len(w) > 0),
grams as (select lang, w, i, unnest(range(1, least(3, len(w) - i + 1) + 1)) as k from spots),
counted as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from grams group by all),
totals as (select lang, cast(sum(f) as bigint) as n from counted where k = 1 group by lang),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counted where k > 1 and f >= 10),
cuts as (select lang, k, phrase, a, c, array_to_string(w[1:c], ' ') as left_part, array_to_string(w[c + 1:k], ' ') as right_part
         from (select *, unnest(range(1, k)) as c from cand)),
scored as (select cuts.*, x.f as l, y.f as r, cast((1000000::hugeint * a * a) // (x.f::hugeint * y.f) as bigint) as score
           from cuts join counted x on x.lang = cuts.lang and x.phrase = left_part join counted y on y.lang = cuts.lang and y.phrase = right_part),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
around as (select lang, phrase, max(a) as a from (
             select lang, array_to_string(w[1:2], ' ') as phrase, a from cand where k = 3
             union all select lang, array_to_string(w[2:3], ' '), a from cand where k = 3) group by all),
kept as (select best.* from best left join around on around.lang = best.lang and around.phrase = best.phrase
         where around.a is null or not (100 * around.a >= 50 * best.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select ranked.lang, cast(rank as integer) as rank, phrase, a, l, r, n, score from ranked join totals on totals.lang = ranked.lang where rank <= 2000""",
    "op13_exact_search": r"""
with v as (select vec_id, len(embedding) as k, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(max(list_inner_product(q.x, c.x)) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and q.k = c.k where q.vec_id % 50 = 0 group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
}


def _lloyd_sql(entries: int = 16, rounds: int = 6) -> str:
    """The codes and codebooks of the vector compression, every round as a pair of table expressions."""
    nearest = ("a{n} as materialized (select r, p, arg_min(e, d * 16 + e) as e, min(d) as d from (select r, p, e, "
               "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) as d from parts join b{n} using (p)) group by r, p)")
    moved = ("b{m} as materialized (select p, e, coalesce(g.c, b{n}.c) as c from b{n} left join (select p, e, list(x order by i) as c from "
             "(select p, e, i, floor(sum(x[i]) / count(*)) as x from a{n} join parts using (r, p), range(1, 9) t(i) where i <= len(x) group by p, e, i) "
             "group by p, e) g using (p, e))")
    steps = [nearest.format(n=0)]
    for n in range(rounds):
        steps += [moved.format(n=n, m=n + 1), nearest.format(n=n + 1)]
    joined = ",\n".join(steps)
    return rf"""
with v as materialized (
  select row_number() over (order by vec_id, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * cast(x as double))) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select r, p, x[p * (len(x) // 8) + 1:(p + 1) * (len(x) // 8)] as x from v, range(8) t(p)),
b0 as materialized (select p, r as e, x as c from parts where r < {entries}),
{joined},
coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by r),
books as (select sha256(string_agg(cast(cast(c[i] as bigint) as varchar), ',' order by p, e, i)) as codebooks_sha256
          from b{rounds}, range(1, 9) t(i) where i <= len(c))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from v join coded using (r), books"""


ORACLE["op12_vector_codes"] = _lloyd_sql()
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
