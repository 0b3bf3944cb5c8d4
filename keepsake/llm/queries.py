"""The registered corpus queries pN_... and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import encode, mixing, neardup, pairs, pii, quality, topn
from keepsake.runtime import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each annotated pair whose answer is unfit for scoring, with its defect."""
    rows = spread(table(spark, d, "qa_annotations").select("ann_no", "question", "answer"))
    return pairs.broken_pairs(rows, "ann_no", "question", "answer", table(spark, d, "common_words")).withColumnRenamed("key", "ann_no")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs (rec_a < rec_b) of one group of image records with nearly the same captions."""
    recs = spread(table(spark, d, "image_batch_results").select("rec_no", "caption", "short_caption")).where(F.col("caption").rlike(r"[^\s\p{Z}]"))
    groups = neardup.near_duplicate_groups(recs, "rec_no", neardup.words("caption", "short_caption"))
    a = groups.select("group", F.col("id").alias("rec_a"))
    b = groups.select("group", F.col("id").alias("rec_b"))
    return a.hint("merge").join(b, "group").where("rec_a < rec_b").select("rec_a", "rec_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten best items of each question, of both origins."""
    hits = table(spark, d, "retrieval_hits").select(F.lit("retrieval_hits").alias("origin"), "qa_id", "item_id", "score")
    runs = table(spark, d, "retrieval_results")
    lists = topn.paired(runs, {"origin": F.lit("retrieval_results"), "qa_id": F.col("id")}, "retrieval_ids", "retrieval_scores")
    best = topn.top_n(hits.unionByName(lists), ["origin", "qa_id"], "item_id", "score", 10)
    return best.select("origin", "qa_id", "pos", "item_id")


#: The setting that holds the secret of the pseudonyms, as hex digits.
KEY_SETTING = "spark.keepsake.pseudonymKey"


def pseudonym_key(spark: SparkSession) -> bytes:
    """The session's secret; where it has none, a random one, whose pseudonyms hold together for one run only."""
    given = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


def _p5(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "retrieval_items").select(F.lit("retrieval_items").alias("origin"), "row_no", "text")
    passages = table(spark, d, "text_passages").select(F.lit("text_passages").alias("origin"), F.col("idx").alias("row_no"), "text")
    model = pii.fit_names(table(spark, d, "contacts"))
    return spread(items.unionByName(passages)).select("origin", "row_no", pii.redacted(F.col("text"), model, pseudonym_key(spark)).alias("r"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct piece of personal information of every item and passage."""
    cells = F.explode(F.array_distinct(F.arrays_zip("r.kinds", "r.vals"))).alias("c")
    return _p5(spark, d).select("origin", "row_no", cells).select("origin", "row_no", F.col("c.kinds").alias("kind"), F.col("c.vals").alias("val"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text of items and passages with typed placeholders."""
    return _p5(spark, d).select("origin", "row_no", "r.text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's token ids by byte_bpe_50k."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", encode.token_ids(spark, F.col("text")).alias("ids"))


def _p7(spark: SparkSession, d: str, **bounds) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", encode.token_count(spark, F.col("text")).alias("n_tokens"))
    return mixing.mix_sources(docs, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"), **bounds)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The uses of every document in each mix of mix_targets, with the shares reached: the largest mixes that meet the targets."""
    return _p7(spark, d)


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    """As p7_mix, each mix as large as its sources are: the exponent is bisected until the repeats suffice."""
    return _p7(spark, d, total="natural")


def p7_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The budgets and exponents of mixes as large as their sources, in code points, with an entropy of at least 1."""
    out = mixing.mix_budgets(table(spark, d, "documents"), "source", "n_chars", table(spark, d, "mix_targets"), total="natural", least_entropy=1.0)
    return out.select("mix_name", "source", "size", F.round("exponent", 6).alias("exponent"), "met", "budget")


def _p8(spark: SparkSession, d: str, only: tuple[str, ...] | None = None) -> DataFrame:
    docs, words = spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "common_words")
    rules = quality.learn_kinds(docs, "doc_id", "text", words, table(spark, d, "doc_labels"))
    return quality.with_kind(quality.with_statistics(docs, "text", words, only), rules)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document that is a list, a table or junk."""
    return _p8(spark, d, quality.RULE_FEATURES).where("kind <> 'prose'").select("doc_id", "kind")


BASICS = ("n_chars", "n_words", "n_lines", "mean_word_length", "words_per_line", "symbol_ratio", "punctuated_lines", "common_words", "distinct_words", "longest_word")


def p8_basics(spark: SparkSession, d: str) -> DataFrame:
    """The plainest statistics of every document, rounded."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    out = quality.with_statistics(docs, "text", table(spark, d, "common_words"), BASICS)
    return out.select("doc_id", *[F.round(f"stats.{c}", 5).alias(c) for c in BASICS])


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The text statistics and the kind of every document."""
    return _p8(spark, d).select("doc_id", "stats.*", "kind")


P2_SQL = r"""
with recursive r as (
  select rec_no, list_distinct(regexp_extract_all(lower(coalesce(caption, '') || ' ' || coalesce(short_caption, '')), '[a-z0-9]+')) as w
  from image_batch_results where regexp_matches(caption, '[^\s\p{Z}]')),
x as (select rec_no, len(w) as n, unnest(w) as word from r),
e as (
  select a.rec_no as u, b.rec_no as v from x a join x b on a.word = b.word and a.rec_no <> b.rec_no
  group by a.rec_no, b.rec_no, a.n, b.n having 10 * count(*) >= 8 * (a.n + b.n - count(*))),
c(u, v) as (select u, v from e union select c.u, e.v from c join e on c.v = e.u)
select u as rec_a, v as rec_b from c where u < v
"""

P7_SQL = r"""
with recursive g as (
  select mix_name, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as source, sum(coalesce(target_share, 0)) as share, min(max_repeats) as repeats
  from mix_targets where mix_name is not null and trim(source) <> '' group by 1, 2),
held as (select lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as source, sum(coalesce(n_chars, 0)) as size from documents group by 1),
r as (select g.*, coalesce(size, 0)::bigint as size from g left join held using (source)),
h as (
  select *, size / sum(size) over m as p, share / sum(share) over m as q, sum(size) over m as total
  from r where size > 0 and share > 0 and repeats > 0 window m as (partition by mix_name)),
w as (
  select mix_name, k / 1024.0::double as e, list({'p': p, 'q': q, 'room': size * repeats / total}) as xs
  from h, range(1025) t(k) group by all),
s as (
  select mix_name, e, list_transform(xs, lambda x: x.p * (x.q / x.p) ** e) as raw, xs from w),
f as (
  select mix_name, e, xs,
    list_bool_and(list_transform(list_zip(raw, xs), lambda z: z[1] / list_sum(raw) <= z[2].room * (1 + 1e-12)))
      and -list_sum(list_transform(raw, lambda v: v / list_sum(raw) * ln(v / list_sum(raw)))) >= 1.0 as ok from s),
start as (
  select mix_name, any_value(xs) as xs, max(e) filter (ok) as low, least(1.0, max(e) filter (ok) + 1 / 1024.0::double) as high from f group by mix_name),
b as (
  select mix_name, xs, low, high, 0 as n from start
  union all
  select mix_name, xs, case when ok then mid else low end, case when ok then high else mid end, n + 1 from (
    select *, list_bool_and(list_transform(list_zip(raw, xs), lambda z: z[1] / list_sum(raw) <= z[2].room * (1 + 1e-12)))
      and -list_sum(list_transform(raw, lambda v: v / list_sum(raw) * ln(v / list_sum(raw)))) >= 1.0 as ok from (
      select *, list_transform(xs, lambda x: x.p * (x.q / x.p) ** mid) as raw from (select *, (low + high) / 2 as mid from b where n < 60)))),
x as (select mix_name, low as exponent from b where n = 60),
v as (select h.*, exponent, p * (q / p) ** exponent as raw from h join x using (mix_name)),
y as (select mix_name, source, least(size * repeats, floor(total * raw / sum(raw) over (partition by mix_name) + 0.5)) as budget from v)
select r.mix_name, r.source, r.size, round(x.exponent, 6) as exponent, true as met, coalesce(y.budget, 0)::bigint as budget
from r join x using (mix_name) left join y using (mix_name, source)
"""

P8_SQL = r"""
with t as (select doc_id, text, text is not null and regexp_matches(text, '[^\s\x0b\p{Z}\x{200B}\x{FEFF}]') as has from documents),
w as (select *, case when has then regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*') end as w,
  case when has then list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x{2028}]'), lambda s: regexp_matches(s, '[^\s\x0b]')) end as l from t),
c as (select list(distinct lower(word)) as common from common_words where word is not null),
x as (select *, list_filter(w, lambda v: list_contains(common, v)) as f, length(regexp_replace(text, '[\s\x0b]+', '', 'g')) as tight from w, c)
select doc_id, case when has then length(text)::double end as n_chars, len(w)::double as n_words, len(l)::double as n_lines,
  round(case when len(w) > 0 then length(array_to_string(w, '')) / len(w) when has then 0.0 end, 5) as mean_word_length, round(case when len(l) > 0 then len(w) / len(l) when has then 0.0 end, 5) as words_per_line,
  round(case when not has then null when tight > 0 then length(regexp_replace(text, '[\p{L}\p{N}\s\x0b]+', '', 'g')) / tight else 0.0 end, 5) as symbol_ratio,
  round(case when len(l) > 0 then len(list_filter(l, lambda s: regexp_matches(s, '[.!?…。！？][''")”»\s\x0b]*$'))) / len(l) when has then 0.0 end, 5) as punctuated_lines,
  round(case when len(w) > 0 then len(f) / len(w) when has then 0.0 end, 5) as common_words, round(case when len(w) > 0 then len(list_distinct(w)) / len(w) when has then 0.0 end, 5) as distinct_words,
  case when has then coalesce(list_max(list_transform(w, lambda v: length(v))), 0)::double end as longest_word from x
"""

P4_SQL = """
with x as (
  select 'retrieval_hits' as origin, qa_id, item_id, score from retrieval_hits
  union all
  select 'retrieval_results', id, unnest(retrieval_ids[:least(len(retrieval_ids), len(retrieval_scores))]),
    unnest(retrieval_scores[:least(len(retrieval_ids), len(retrieval_scores))]) from retrieval_results),
b as (
  select origin, qa_id, item_id, max(score) as score from x
  where score is not null and not isnan(score) and item_id is not null group by all)
select origin, qa_id, row_number() over (partition by origin, qa_id order by score desc, item_id) as pos, item_id
from b qualify pos <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_tempered": p7_tempered, "p7_budgets": p7_budgets, "p8_found": p8_found, "p8_basics": p8_basics, "p8_statistics": p8_statistics}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p4_found": P4_SQL, "p7_budgets": P7_SQL, "p8_basics": P8_SQL}
