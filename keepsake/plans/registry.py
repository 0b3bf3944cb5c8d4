"""The registered core queries: one callable and, where SQL can say it, one SQL text each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.functions import answers as A
from keepsake.functions import formats
from keepsake.operators import corpus, lexical, lookups, memory, metrics, ranking, scoring, summaries, timestamps, usage, vectors
from keepsake.runtime import spread, table
from keepsake.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def big(c: Column) -> Column:
    return c.cast("bigint")


# ------------------------------------------------------------------ timestamps


@register()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The UTC instant of every timestamp of passages and notes that denotes one."""
    places = table(spark, d, "place_zones").where("location is not null").groupBy("location")
    places = places.agg(F.first("zone_name").alias("zone"), F.first("date_order").alias("day_order"))
    passages = table(spark, d, "text_passages").select(F.lit("text_passages").alias("origin"), F.col("idx").alias("row_no"), F.col("timestamp").alias("raw"), "location")
    passages = passages.join(places, "location", "left").drop("location")
    none = F.lit(None).cast("string")
    notes = table(spark, d, "memory_notes").select(F.lit("memory_notes").alias("origin"), F.col("note_no").alias("row_no"), F.col("timestamp").alias("raw"), none.alias("zone"), none.alias("day_order"))
    rows = passages.unionByName(notes)
    return timestamps.normalise(rows, "raw", F.col("zone"), F.col("day_order"), source=F.col("origin"), years=(2019, 2025)).where("utc_us is not null").select("origin", "row_no", "utc_us")


# -------------------------------------------------------------- vector retrieval

_VEC = """
with e as (select vec_id, label, [x::double for x in embedding] as v from embeddings),
n as (select vec_id, label, [x / sqrt(list_sum([y * y for y in v])) for x in v] as v from e),
s as (select q.vec_id as q_id, q.label as q_label, i.vec_id, i.label, list_dot_product(q.v, i.v) as score
      from n q join n i on q.vec_id % 20 = 0 and i.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by q_id order by score desc, vec_id) as rank from s)
"""


def _ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(q_id, vec_id, score, rank) of every 20th vector against all others."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    return vectors.top_k(q, e, "q_id", "vec_id", "embedding", k, skip_self=True)


@register(_VEC + "select q_id, vec_id, round(score, 6) as score, rank from r where rank <= 10")
def vec_topk10(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 10).select("q_id", "vec_id", F.round("score", 6).alias("score"), big(F.col("rank")).alias("rank"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Recall of exact cosine retrieval: the share of the k nearest with the query's label, and hits at 1."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hit = _ranked(spark, d, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("q_id"), F.col("label").alias("q_label")), "q_id")
    same = (F.col("label") == F.col("q_label")).cast("int")
    per = hit.groupBy("q_id").agg(*[F.sum(F.when(F.col("rank") <= k, same).otherwise(0)).alias(f"h{k}") for k in (1, 5, 10)])
    cells = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), (F.col(f"h{k}") / k).alias("p")) for k in (1, 5, 10)])
    return per.select(F.explode(cells).alias("c")).groupBy("c.k").agg(F.round(F.avg("c.p"), 6).alias("precision"), F.count(F.lit(1)).alias("queries"))


@register(
    _VEC + """, h as (select q_id, k, count(*) filter (where rank <= k and label = q_label) / k as p
      from r cross join (select unnest([1, 5, 10])::bigint as k) where rank <= 10 group by q_id, k)
    select k, round(avg(p), 6) as precision, count(*) as queries from h group by k"""
)
def vec_precision(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@register(
    _VEC + """, a as (select q_id, vec_id, rank, case when rank <= 5 then (vec_id * 7919) % 101 end as ns from r where rank <= 10)
    select q_id, vec_id, row_number() over (partition by q_id order by ns is null, ns desc, rank) as place from a"""
)
def rerank_tail(spark: SparkSession, d: str) -> DataFrame:
    """The first five by a stand-in model's score, the rest behind in their old order."""
    score = lambda f: ((f["vec_id"] * 7919) % 101).to_numpy(dtype=np.float64)
    out = vectors.rerank(_ranked(spark, d, 10), "q_id", "vec_id", "rank", score, 5, ["vec_id"])
    return out.select("q_id", "vec_id", big(F.col("rerank_rank")).alias("place"))


# ------------------------------------------------------------------ retrieval metrics

_RUNS = """with x as (select run_no, coalesce(gt_evidence_ids, []) as g, coalesce(retrieval_ids, []) as r from retrieval_results),
ks as (select unnest([1, 5, 10])::bigint as k)
"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieval_results")


def _macro(df: DataFrame) -> DataFrame:
    return df.select(big(F.col("k")).alias("k"), F.round("recall", 6).alias("recall"), "questions")


@register(_RUNS + """select k, round(avg(case when len(g) = 0 then 0.0 else len(list_filter(r[:k], lambda y: list_contains(g, y))) / len(g) end), 6) as recall,
    count(*) as questions from x, ks group by k""")
def recall_list_macro(spark: SparkSession, d: str) -> DataFrame:
    return _macro(metrics.macro_recall(_runs(spark, d), "gt_evidence_ids", "retrieval_ids", (1, 5, 10)))


_DEDUP = """, u as (select run_no, g, list_transform(list_filter(list_zip(r, range(1, len(r) + 1)), lambda t: list_position(r, t[1]) = t[2]), lambda t: t[1]) as r from x)
"""


@register(_RUNS + _DEDUP + """select k, round(avg(case when len(g) = 0 then 0.0 else len(list_filter(r[:k], lambda y: list_contains(g, y))) / len(g) end), 6) as recall,
    count(*) as questions from u, ks group by k""")
def recall_deduplicated_macro(spark: SparkSession, d: str) -> DataFrame:
    return _macro(metrics.macro_recall(_runs(spark, d), "gt_evidence_ids", "retrieval_ids", (1, 5, 10), metrics.recall_deduplicated))


@register(_RUNS + """select k, round(avg(len(list_intersect(list_distinct(g), list_distinct(r[:k]))) / len(list_distinct(g))), 6) as recall, count(*) as questions
    from x, ks where len(g) > 0 group by k""")
def recall_set_macro(spark: SparkSession, d: str) -> DataFrame:
    return _macro(metrics.macro_recall(_runs(spark, d), "gt_evidence_ids", "retrieval_ids", (1, 5, 10), metrics.recall_set))


@register(_RUNS + """, y as (select *, len(list_distinct(g)) as n from x)
select round(avg(len(list_intersect(list_distinct(g), list_distinct(r[:1]))) / n), 6) as recall_at_1, round(avg(len(list_intersect(list_distinct(g), list_distinct(r[:5]))) / n), 6) as recall_at_5,
  round(avg(len(list_intersect(list_distinct(g), list_distinct(r[:10]))) / n), 6) as recall_at_10, round(avg(len(list_intersect(list_distinct(g), list_distinct(r[:n]))) / n), 6) as recall_at_gt,
  round(avg(case when len(r) > 0 and list_contains(g, r[1]) then 1.0 else 0.0 end), 6) as hit_at_1, count(*) as with_gt, (select count(*) from y where n = 0) as empty_gt,
  round(avg(n), 6) as gt_avg, min(n)::bigint as gt_min, max(n)::bigint as gt_max from y where n > 0""")
def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.retrieval_report(_runs(spark, d), "gt_evidence_ids", "retrieval_ids")
    whole = ("with_gt", "empty_gt", "gt_min", "gt_max")
    return r.select(*[big(F.col(c)).alias(c) if c in whole else F.round(c, 6).alias(c) for c in r.columns])


@register(_RUNS + """, s as (select id, arg_min(answer, ann_no) as a, arg_max(answer, ann_no) as z from qa_annotations where answer is not null group by id),
v as (select id, case when a = z then 1.0 else 0.0 end as acc from s),
j as (select q.run_no, coalesce(q.gt_evidence_ids, []) as g, coalesce(q.retrieval_ids, []) as r, v.acc from retrieval_results q left join v using (id)),
w as (select *, len(list_distinct(g)) as n, len(list_intersect(list_distinct(g), list_distinct(r[:5]))) as h5, len(list_intersect(list_distinct(g), list_distinct(r[:10]))) as h10 from j)
select round(avg(case when acc > 0 and h5 = n then 1.0 else 0.0 end) filter (where n > 0 and acc is not null), 6) as strict_at_5,
  round(avg(acc * h5 / n) filter (where n > 0 and acc is not null), 6) as partial_at_5,
  round(avg(case when acc > 0 and h10 = n then 1.0 else 0.0 end) filter (where n > 0 and acc is not null), 6) as strict_at_10,
  round(avg(acc * h10 / n) filter (where n > 0 and acc is not null), 6) as partial_at_10,
  count(*) filter (where n > 0 and acc is not null) as with_gt, count(*) filter (where n = 0) as empty_gt, count(*) filter (where n > 0 and acc is null) as missing_answer from w""")
def joint_report(spark: SparkSession, d: str) -> DataFrame:
    """Joint answer and retrieval scores; an answer counts as right if the last delivery repeats the first."""
    a = table(spark, d, "qa_annotations").where("answer is not null").groupBy("id").agg(F.min_by("answer", "ann_no").alias("a"), F.max_by("answer", "ann_no").alias("z"))
    r = metrics.joint_report(_runs(spark, d), a.select("id", (F.col("a") == F.col("z")).cast("double").alias("accuracy")), "id", "gt_evidence_ids", "retrieval_ids")
    return r.select(*[F.round(c, 6).alias(c) if "_at_" in c else F.col(c) for c in r.columns])


@register("select max(coalesce(len(retrieval_ids), 0))::bigint as depth from retrieval_results")
def retrieval_depth(spark: SparkSession, d: str) -> DataFrame:
    return metrics.depth(_runs(spark, d), "retrieval_ids")


# ---------------------------------------------------------------------- evidence pools


@register("""with x as (select run_no, coalesce(gt_evidence_ids, []) as g, coalesce(retrieval_ids, [])[:5] as t from retrieval_results),
m as (select *, list_filter(g, lambda y: not list_contains(t, y)) as missing,
  list_zip(t, range(1, len(t) + 1)) as z from x),
o as (select *, list_filter(z, lambda p: not list_contains(g, p[1])) as other from m),
k as (select *, greatest(0, len(other) - len(missing)) as room from o),
c as (select run_no, g, missing, list_transform(list_filter(z, lambda p: list_contains(g, p[1]) or
   len(list_filter(other, lambda q: q[2] < p[2])) < room), lambda p: p[1]) as kept from k)
select run_no, list_sort(case when len(g) > 5 then g else list_concat(kept, missing)[:5] end) as pool from c""")
def pool_membership(spark: SparkSession, d: str) -> DataFrame:
    p = ranking.pool(F.col("gt_evidence_ids"), F.col("retrieval_ids"), 5)
    return _runs(spark, d).select("run_no", F.array_sort(p).alias("pool"))


@register("""with x as (select ann_no, coalesce(evidence_ids, []) as g, coalesce(niah_evidence_ids, []) as p from qa_annotations)
select ann_no, list_sort(list_distinct(list_filter(g, lambda y: not list_contains(p, y)))) as missing, len(g) <= 25 and len(p) <> 25 as wrong_size,
  len(p) <> len(list_distinct(p)) as duplicates from x""")
def pool_issues(spark: SparkSession, d: str) -> DataFrame:
    i = ranking.pool_issues(F.col("evidence_ids"), F.col("niah_evidence_ids"), 25).alias("i")
    return table(spark, d, "qa_annotations").select("ann_no", i).select("ann_no", "i.*")


@register("select ann_no, coalesce(niah_evidence_ids, evidence_ids, []) as ids from qa_annotations")
def pool_substitution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_annotations").select("ann_no", ranking.substituted(F.col("niah_evidence_ids"), F.col("evidence_ids")).alias("ids"))


# ----------------------------------------------------------------------- ranked lists


@register("""with b as (select qa_id, item_id, min(hit_no) as first, coalesce(arg_min(coalesce(score, 0.0), hit_no), 0.0) as score from retrieval_hits where item_id is not null group by all)
select qa_id, item_id, case when isnan(score) then null else round(score, 6) end as score, row_number() over (partition by qa_id order by first, item_id) as place from b""")
def items_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.items_of_chunks(table(spark, d, "retrieval_hits"), "qa_id", "item_id", "hit_no", "score")
    return out.select("qa_id", "item_id", F.when(~F.isnan("score"), F.round("score", 6)).alias("score"), big(F.col("rank")).alias("place"))


@register("""with s as (select *, case when isnan(score) then null else score end as s from retrieval_hits),
r as (select qa_id, hit_no, row_number() over (partition by qa_id order by s desc, hit_no) as place from s where s is not null)
select * from r where place <= 7""")
def bounded_queue(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "retrieval_hits").where("score is not null and not isnan(score)")
    return ranking.bounded_queue(pages, "qa_id", "score", "hit_no", 7).select("qa_id", "hit_no", big(F.col("place")).alias("place"))


@register("""with h as (select qa_id, shard, hit_no, score from retrieval_hits where score is not null and not isnan(score)),
s as (select qa_id, shard, max(score) as score from h group by all having max(score) >= 0.1),
b as (select qa_id, shard from s qualify row_number() over (partition by qa_id order by score desc, shard) <= 2),
p as (select qa_id, h.hit_no, row_number() over (partition by qa_id order by h.score desc, h.hit_no) as place from h join b using (qa_id, shard) where h.score >= 0.1)
select * from p where place <= 5""")
def two_level_search(spark: SparkSession, d: str) -> DataFrame:
    """Sessions are shards: the two best of a question, then their five best pages."""
    h = table(spark, d, "retrieval_hits").where("score is not null and not isnan(score)").select("qa_id", "shard", "hit_no", "score", F.col("hit_no").alias("arrival"))
    s = h.groupBy("qa_id", "shard").agg(F.max("score").alias("score"))
    return ranking.two_level_search(s, h, "qa_id", "shard", 0.1, 0.1, 2, 5).select("qa_id", "hit_no", big(F.col("place")).alias("place"))


@register("""with v as (select qa_id, item_id, row_number() over (partition by qa_id, shard % 3 order by hit_no) as r from retrieval_hits where item_id is not null),
b as (select qa_id, item_id, min(r) as r from v group by all)
select qa_id, item_id, row_number() over (partition by qa_id order by r, item_id) as place from b""")
def fuse_views(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "retrieval_hits").where("item_id is not null")
    r = F.row_number().over(Window.partitionBy("qa_id", F.col("shard") % 3).orderBy("hit_no"))
    h = h.select("qa_id", "item_id", (F.col("shard") % 3).alias("view"), r.alias("place"))
    out = ranking.fuse_views([h.where(F.col("view") == i) for i in range(3)], "qa_id", "item_id", "place")
    return out.select("qa_id", "item_id", big(F.col("place")).alias("place"))


# --------------------------------------------------------------------- lookups and joins


@register("select id, arg_max(answer, ann_no) filter (where answer is not null) as answer_given, max(ann_no) as last from qa_annotations group by id")
def answer_last_given(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_annotations")
    given = lookups.last_by_key(rows.where("answer is not null").select("id", "ann_no", "answer"), ["id"], ["ann_no"])
    return rows.groupBy("id").agg(F.max("ann_no").alias("last")).join(given.select("id", F.col("answer").alias("answer_given")), "id", "left")


@register("select ann_no, id, question, qtype from qa_annotations qualify row_number() over (partition by id order by ann_no) = 1")
def question_first(spark: SparkSession, d: str) -> DataFrame:
    return lookups.first_by_key(table(spark, d, "qa_annotations").select("ann_no", "id", "question", "qtype"), ["id"], ["ann_no"])


@register("""with p as (select id, answer from qa_annotations qualify row_number() over (partition by id order by ann_no desc) = 1)
select r.run_no, r.id, coalesce(p.answer, '') as prediction from retrieval_results r left join p using (id)""")
def prediction_lookup(spark: SparkSession, d: str) -> DataFrame:
    qas = table(spark, d, "retrieval_results").select("run_no", "id")
    return scoring.with_predictions(qas, table(spark, d, "qa_annotations"), "id", "answer", "ann_no").select("run_no", "id", "prediction")


@register("select row_no, item_id from retrieval_items i where not exists (select 1 from text_passages p where p.evidence_id = i.item_id)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "text_passages").where("evidence_id is not null").select(F.col("evidence_id").alias("item_id"))
    return lookups.pending(table(spark, d, "retrieval_items").select("row_no", "item_id"), done, "item_id")


@register("""with b as (select id, 0 as prio, run_no as ord, rerank_ids from retrieval_results where rerank_ids is not null
  union all select id, 1, ann_no, evidence_ids from qa_annotations)
select id, prio::bigint as prio, coalesce(len(ids), -1)::bigint as n from (select id, prio, rerank_ids as ids from b qualify row_number() over (partition by id order by prio desc, ord desc) = 1)""")
def resume_map(spark: SparkSession, d: str) -> DataFrame:
    """The questions of runs and of annotations, the latter winning."""
    final = table(spark, d, "retrieval_results").where("rerank_ids is not null").select("id", F.col("run_no").alias("ord"), F.col("rerank_ids").alias("ids"), F.lit(0).cast("bigint").alias("prio"))
    check = table(spark, d, "qa_annotations").select("id", F.col("ann_no").alias("ord"), F.col("evidence_ids").alias("ids"), F.lit(1).cast("bigint").alias("prio"))
    out = lookups.resume_map(final, check, "id", "ord")
    return out.select("id", "prio", big(F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(-1))).alias("n"))


@register("""with n as (select id from memory_notes where id is not null group by id),
l as (select id as src, unnest(links) as dst from memory_notes)
select distinct src, dst from l where dst in (select id from n)""")
def note_links(spark: SparkSession, d: str) -> DataFrame:
    return lookups.resolve_links(table(spark, d, "memory_notes"), "id", "links")


_HITS = """with n as (select id, min(note_no) as note_no from memory_notes where id is not null group by id),
t as (select id, unnest(list_distinct(tags)) as tag from memory_notes where id is not null),
h as (select tag, id, row_number() over (partition by tag order by note_no) as place from (select distinct tag, id from t) join n using (id) qualify place <= 5),
e as (select distinct src, dst from (select id as src, unnest(links) as dst from memory_notes) where dst in (select id from n)),
x as (select distinct h.tag, e.dst as id from h join e on h.id = e.src),
y as (select tag, id from x anti join h using (tag, id)),
m as (select tag, max(place) as last from h group by tag)
"""


@register(_HITS + """select tag, id, place, false as linked from h union all
select y.tag, y.id, m.last + row_number() over (partition by y.tag order by y.id), true from y join m using (tag)""")
def expand_links(spark: SparkSession, d: str) -> DataFrame:
    """For each tag its five first notes, and after them the notes one link away."""
    notes = table(spark, d, "memory_notes").where("id is not null")
    no = notes.groupBy("id").agg(F.min("note_no").alias("note_no"))
    tags = notes.select("id", F.explode("tags").alias("tag")).where("tag is not null").distinct().join(no, "id")
    hits = tags.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy("note_no"))).where("place <= 5").select("tag", "id", "place")
    out = lookups.expand_links(hits, lookups.resolve_links(notes, "id", "links"), "tag", "id", "place")
    return out.select("tag", "id", big(F.col("place")).alias("place"), "linked")


@register("""select p.idx, case when k.item_id is not null then [p.evidence_id] when p.idx % 2 = 0 then ['side' || p.idx, 'b'] else [] end as item_ids, case when k.item_id is not null then 'source' when p.idx % 2 = 0 then 'side' else 'none' end as tier
from text_passages p left join (select distinct item_id from retrieval_items where row_no % 3 <> 0) k on p.evidence_id = k.item_id""")
def attribute_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages to two thirds of the items by their own ids, every second other one by a side table."""
    p = table(spark, d, "text_passages")
    e = p.select(F.col("idx").alias("entry_id"), F.array("evidence_id").alias("source_ids"))
    side = p.where("idx % 2 = 0").select(F.col("idx").alias("entry_id"), F.array(F.concat(F.lit("side"), F.col("idx").cast("string")), F.lit("b")).alias("item_ids"))
    return lookups.attribute(e, table(spark, d, "retrieval_items").where("row_no % 3 <> 0"), side).withColumnRenamed("entry_id", "idx")


@register(r"""with e as (select note_no, id, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) as w from memory_notes where content is not null),
q as (select id as item_id, question from qa_annotations qualify row_number() over (partition by id order by ann_no) = 1),
u as (select item_id, regexp_extract_all(lower(question), '[\p{L}\p{N}_]+') as a from q),
i as (select item_id, list_filter(list_filter(a, lambda v, n: list_position(a, v) = n), lambda v: length(v) >= 6)[:8] as w from u),
s as (select e.note_no, i.item_id, count(*) as score from (select note_no, unnest(w) as x from e) e join (select item_id, unnest(w) as x from i) i using (x) group by all having count(*) >= 2),
n as (select note_no, item_id, 100 as score from (select note_no, unnest(w) as x from e) e join q on lower(q.item_id) = x),
b as (select *, row_number() over (partition by note_no order by score desc, item_id) as r from (from s union all from n))
select note_no as entry_id, item_id, score::bigint as score from b where r = 1""")
def attribute_by_words(spark: SparkSession, d: str) -> DataFrame:
    """Notes to the questions whose long words they contain."""
    e = table(spark, d, "memory_notes").where("content is not null").select(F.col("note_no").alias("entry_id"), F.col("content").alias("text"))
    q = lookups.first_by_key(table(spark, d, "qa_annotations").select("id", "ann_no", "question"), ["id"], ["ann_no"])
    return lookups.attribute_by_words(e, q.select(F.col("id").alias("item_id"), F.col("question").alias("text")))


@register("""select evidence_id, count(*) as keys from (select key, arg_min(evidence_id, idx) as evidence_id from (
  select idx, evidence_id, unnest(list_distinct(list_filter([text, split_part(text, chr(10), 1), trim(title), upper(left(modality, 1)) || lower(substr(modality, 2)) || ': ' || trim(title)], lambda k: k <> ''))) as key
  from text_passages where evidence_id is not null) group by key) group by evidence_id""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = lookups.text_keys(table(spark, d, "text_passages"))
    return keys.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("keys"))


# ------------------------------------------------------------------- corpus and rendering

_IMG = """'ID: ' || regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '\\.[^.]+$', '') || chr(10) || 'Type: image' || chr(10) || 'Timestamp: ' || coalesce(timestamp, '') || chr(10) || 'Location: ' || coalesce(location_name, '')
 || chr(10) || 'Short Caption: ' || coalesce(short_caption, '') || chr(10) || 'Caption: ' || coalesce(caption, '') || chr(10) || 'OCR: ' || coalesce(ocr_text, '') || chr(10) || 'Tags: ' || coalesce(array_to_string(tags, ', '), '')"""


def _images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "image_batch_results").withColumn("ord", F.col("rec_no"))


def _mails(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "text_passages").where("modality = 'email'")
    return p.select(F.col("idx").alias("ord"), F.col("evidence_id").alias("id"), "timestamp", F.col("title").alias("short_summary"), F.col("text").alias("detail"), "location")


@register(f"""select 1::bigint as src, rec_no as ord, regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '\\.[^.]+$', '') as item_id, 'image' as modality, {_IMG} as text, coalesce(location_name, '') as place
from image_batch_results where image_path <> ''
union all select 0, idx, evidence_id, 'email', 'ID: ' || evidence_id || chr(10) || 'Timestamp: ' || coalesce(timestamp, '') || chr(10) || 'Summary: ' || coalesce(title, '') || chr(10) || 'Detail: ' || coalesce(text, ''), coalesce(location, '')
from text_passages where modality = 'email' and evidence_id <> ''
union all select 2, row_no, regexp_replace(regexp_extract(video_path, '([^/]*)$', 1), '\\.[^.]+$', ''), 'video', 'ID: ' || regexp_replace(regexp_extract(video_path, '([^/]*)$', 1), '\\.[^.]+$', '') || chr(10) || 'Type: video' || chr(10) || 'Timestamp: ' || coalesce(metadata['timestamp'], '') || chr(10)
  || 'Location: ' || coalesce(metadata['location'], '') || chr(10) || 'Short Caption: ' || chr(10) || 'Caption: ' || coalesce(text, '') || chr(10) || 'OCR: ' || chr(10) || 'Tags: ', coalesce(metadata['location'], '') from retrieval_items where video_path <> ''""")
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """Mails, images and videos in one table of items."""
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    videos = table(spark, d, "retrieval_items").select(F.col("row_no").alias("ord"), "video_path", m("timestamp").alias("timestamp"), m("location").alias("location_name"), F.col("text").alias("caption"))
    items = corpus.build_items(_mails(spark, d), _images(spark, d), videos)
    return items.select(big(F.col("src")).alias("src"), "ord", "item_id", "modality", "text", F.try_element_at("metadata", F.lit("location")).alias("place"))


@register("""select rec_no, 'ID: ' || regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '\\.[^.]+$', '') || chr(10) || 'Timestamp: ' || coalesce(timestamp, '') || chr(10) || 'Location: ' || coalesce(location_name, '') as text from image_batch_results where image_path <> ''""")
def render_minimal(spark: SparkSession, d: str) -> DataFrame:
    items = corpus.build_items(None, _images(spark, d), None, corpus.MediaText.minimal(), corpus.MailText.minimal())
    return items.select(F.col("ord").alias("rec_no"), "text")


def _row(df: DataFrame) -> dict:
    return {c: F.col(c) for c in df.columns} | ({"location": F.lit(None).cast("string")} if "location" not in df.columns else {})


@register("""select rec_no, 'ID: ' || rec_no || chr(10) || 'Type: image' || chr(10) || 'Timestamp: ' || coalesce(timestamp, 'None') || chr(10) || 'Location: ' || coalesce(location_name, 'None') || chr(10) || 'Caption: ' || coalesce(caption, 'None') || chr(10) as text from image_batch_results""")
def render_evidence(spark: SparkSession, d: str) -> DataFrame:
    df = _images(spark, d)
    text = corpus.batch_evidence(F.col("rec_no").cast("string"), F.lit("image"), _row(df), ("type", "timestamp", "location", "caption"))
    return df.select("rec_no", text.alias("text"))


@register("""select rec_no, concat_ws(chr(10), concat_ws(' | ', rec_no::varchar, coalesce(nullif(timestamp, ''), 'Unknown'), coalesce(nullif(location_name, ''), 'Unknown')), nullif(short_caption, ''),
  'Caption: ' || nullif(caption, ''), case when len(tags) > 0 then 'Tags: ' || array_to_string(tags, ', ') end, 'OCR: ' || nullif(ocr_text, '')) as text from image_batch_results""")
def render_passage(spark: SparkSession, d: str) -> DataFrame:
    df = _images(spark, d)
    return df.select("rec_no", corpus.media_passage(F.col("rec_no").cast("string"), _row(df), 3).alias("text"))


@register("select idx, row_number() over (order by evidence_id nulls first, idx) - 1 as place from text_passages")
def passage_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_passages").select("idx", "evidence_id")
    return corpus.dense_index(rows, [F.col("evidence_id").asc_nulls_first(), F.col("idx")], "place").select("idx", "place")


@register("""select case when lower(p) like 'email%' then 'email' when regexp_matches(lower(p), '\\.(mp4|mov|avi|mkv|webm|m4v)$') then 'video' when regexp_matches(lower(p), '\\.(jpg|jpeg|png|heic|heif|webp|bmp|gif|tiff)$') then 'image' else 'unknown' end as kind,
count(*) as files from (select image_path as p from image_batch_results union all select image_path from retrieval_items union all select video_path from retrieval_items union all select item_id from retrieval_items) where p is not null group by all""")
def evidence_kinds(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "retrieval_items")
    p = table(spark, d, "image_batch_results").select(F.col("image_path").alias("p"))
    for c in ("image_path", "video_path", "item_id"):
        p = p.unionByName(i.select(F.col(c).alias("p")))
    return p.where("p is not null").groupBy(corpus.evidence_kind(F.col("p")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@register("""select ann_no, coalesce(bool_or(lower(e) like 'email%'), false) as mail, coalesce(bool_or(regexp_matches(e, '^[0-9]{8}_[0-9]{6}')), false) as media
from (select ann_no, unnest(case when len(evidence_ids) > 0 then evidence_ids else [null] end) as e from qa_annotations) group by ann_no""")
def evidence_bitmap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_annotations").select("ann_no", corpus.evidence_bitmap(F.col("evidence_ids")).alias("b")).select("ann_no", "b.*")


@register("""select ann_no, list_transform(list_filter(list_zip(e, range(1, len(e) + 1)), lambda t: list_position(e, t[1]) = t[2]), lambda t: t[1]) as ids
from (select ann_no, list_filter(coalesce(evidence_ids, []), lambda x: x is not null and x <> '') as e from qa_annotations)""")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_annotations").select("ann_no", corpus.evidence_ids(F.col("evidence_ids")).alias("ids"))


_TEXTS = """with i as (select item_id as id, arg_min(text, row_no) as text from retrieval_items where text is not null group by item_id),
p as (select evidence_id as id, arg_min(text, idx) as text from text_passages where text is not null group by evidence_id),
e as (select ann_no, list_filter(coalesce(evidence_ids, []), lambda x: x is not null and x <> '') as e from qa_annotations),
u as (select ann_no, unnest(e) as id, unnest(range(1, len(e) + 1)) as pos, e from e),
t as (select ann_no, pos, coalesce(i.text, p.text) as text from u left join i using (id) left join p using (id) where list_position(e, u.id) = pos and coalesce(i.text, p.text) is not null),
g as (select ann_no, list(text order by pos) as texts from t group by ann_no)
"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    items = lookups.first_by_key(table(spark, d, "retrieval_items").where("text is not null").select(F.col("item_id").alias("id"), "row_no", "text"), ["id"], ["row_no"])
    passages = lookups.first_by_key(table(spark, d, "text_passages").where("text is not null").select(F.col("evidence_id").alias("id"), "idx", "text"), ["id"], ["idx"])
    return corpus.evidence_texts(table(spark, d, "qa_annotations"), "ann_no", "evidence_ids", [items.select("id", "text"), passages.select("id", "text")])


@register(_TEXTS + "select ann_no, coalesce(array_to_string([('Evidence ' || i || ':' || chr(10) || texts[i]) for i in range(1, len(texts) + 1)], chr(10)), '') as block from qa_annotations left join g using (ann_no)")
def numbered_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("ann_no", corpus.numbered(F.col("texts")).alias("block"))


@register("""select row_no, case when coalesce(text, '') = '' then '' when modality = 'email' then '[' || item_id || '] Mail from ' || coalesce(case when trim(metadata['sender']) <> '' then metadata['sender'] end, 'Unknown') || ' at ' || coalesce(case when trim(metadata['timestamp']) <> '' then metadata['timestamp'] end, 'Unknown') || ' in ' || coalesce(case when trim(metadata['location']) <> '' then metadata['location'] end, 'Unknown') || ', subject: ' || coalesce(case when trim(metadata['subject']) <> '' then metadata['subject'] end, 'No subject') || chr(10) || text
 when modality = 'image' then '[' || item_id || '] Photo in ' || coalesce(case when trim(metadata['location']) <> '' then metadata['location'] end, 'Unknown') || ' at ' || coalesce(case when trim(metadata['timestamp']) <> '' then metadata['timestamp'] end, 'Unknown') || chr(10) || text
 when modality = 'video' then '[' || item_id || '] Video in ' || coalesce(case when trim(metadata['location']) <> '' then metadata['location'] end, 'Unknown') || ' at ' || coalesce(case when trim(metadata['timestamp']) <> '' then metadata['timestamp'] end, 'Unknown') || chr(10) || text
 else '[' || item_id || ']' || chr(10) || text end as user_text from retrieval_items""")
def dialogue_text(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "retrieval_items")
    return i.select("row_no", corpus.dialogue(F.col("item_id"), F.col("modality"), F.col("text"), F.col("metadata"))["user"].alias("user_text"))


@register("""select modality, count(*) as items, count(*) filter (where trim(coalesce(metadata['timestamp'], '')) = '') as no_timestamp, count(*) filter (where trim(coalesce(metadata['location'], '')) = '') as no_location,
count(*) filter (where trim(coalesce(metadata['sender'], '')) = '') as no_sender, count(*) filter (where trim(coalesce(metadata['subject'], '')) = '') as no_subject from retrieval_items group by modality""")
def missing_metadata(spark: SparkSession, d: str) -> DataFrame:
    return corpus.missing_metadata(table(spark, d, "retrieval_items"))


@register("select note_no, 'content:' || coalesce(content, '') || ' context:' || coalesce(context, '') || ' keywords:' || coalesce(array_to_string(keywords, ', '), '') || ' tags:' || coalesce(array_to_string(tags, ', '), '') as doc from memory_notes")
def note_document(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "memory_notes")
    return n.select("note_no", corpus.note_document(F.col("content"), F.col("context"), F.col("keywords"), F.col("tags")).alias("doc"))


# -------------------------------------------------------------- sets, answers and scores

_GP = "with x as (select ann_no, list_distinct(coalesce(evidence_ids, [])) as g, list_distinct(coalesce(niah_evidence_ids, [])) as p from qa_annotations)\n"


@register(_GP + """select ann_no, round(case when len(g) = 0 and len(p) = 0 then 1.0 when len(g) = 0 then 0.0 else len(list_intersect(g, p)) / (len(g) + len(p) - len(list_intersect(g, p))) end, 6) as score from x""")
def jaccard_ids(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, d, "qa_annotations").select("ann_no", F.round(A.jaccard(F.coalesce("evidence_ids", none), F.coalesce("niah_evidence_ids", none)), 6).alias("score"))


@register("""with x as (select run_no, coalesce(retrieval_ids, []) as a, coalesce(rerank_ids, []) as b from retrieval_results)
select run_no, list_sort(a) = list_sort(b) as same_bag, len(list_filter(a, lambda y: not list_contains(b, y))) = 0 as subset, len(list_distinct(list_filter(a, lambda y: not list_contains(b, y)))) as missing from x""")
def bag_and_subset(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    a, b = F.coalesce("retrieval_ids", none), F.coalesce("rerank_ids", none)
    gone = F.size(F.array_except(a, b))
    return _runs(spark, d).select("run_no", A.same_bag(a, b).alias("same_bag"), (gone == 0).alias("subset"), big(gone).alias("missing"))


@register(r"""select ann_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(answer), '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' '), '\b(\d+)(st|nd|rd|th)\b', '\1', 'g'), '\([^)]+\)', '', 'g'), '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '(\d),(\d)', '\1\2', 'g'), '', '', 'g'), chr(9) || chr(10) || chr(13) || ' "''`.,;:!?()[]{}') as t from qa_annotations where answer is not null""")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_annotations").where("answer is not null").select("ann_no", A.normalise_text(F.col("answer")).alias("t"))


@register("select ann_no, regexp_extract_all(lower(question), '[a-z0-9]+') as words from qa_annotations where question is not null")
def tokenise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_annotations").where("question is not null").select("ann_no", A.tokens(F.col("question")).alias("words"))


@register(r"""select row_no, list_distinct(list_sort(list_concat(regexp_extract_all(text, '\b(\d{8}_\d{6})\b', 1), [lower(x) for x in regexp_extract_all(text, '(?i)\b(email\d+)\b', 1)]))).list_sort() as ids from retrieval_items where text is not null""")
def list_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieval_items").where("text is not null").select("row_no", F.array_sort(A.list_ids(F.col("text"))).alias("ids"))


@register(r"""select ann_no, list_sort(list_distinct([upper(x) for x in regexp_extract_all(answer, '(?i)\b[A-Z0-9]{4,}\b') if regexp_matches(upper(x), '[A-Z]') and regexp_matches(x, '[0-9]') and not regexp_matches(upper(x), '^\d{1,2}(ST|ND|RD|TH)$')])) as codes from qa_annotations where answer is not null""")
def answer_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_annotations").where("answer is not null").select("ann_no", F.array_sort(A.codes(F.col("answer"))).alias("codes"))


@register(r"""select ann_no, list_sort(list_distinct([case when regexp_matches(lower(x), '^(usd|dollar)') then 'USD' when regexp_matches(lower(x), '^(gbp|pound)') then 'GBP' when regexp_matches(lower(x), '^eur') then 'EUR' when x = '£' then 'GBP' when x = '$' then 'USD' when x = '€' then 'EUR' else upper(x) end
 for x in list_concat(regexp_extract_all(answer, '(?i)\b(?:USD|GBP|EUR|AUD|JOD)\b'), regexp_extract_all(answer, '(?i)\b(?:dollars?|usd|pounds?|gbp|euros?|eur)\b'), regexp_extract_all(answer, '[£$€]'))])) as codes from qa_annotations where answer is not null""")
def answer_currencies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_annotations").where("answer is not null").select("ann_no", A.currencies(F.col("answer")).alias("codes"))


@register("""with w as (select ann_no, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) as q, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) as a from qa_annotations where question is not null and answer is not null)
select ann_no, len(list_filter(a, lambda x: not list_contains(q, x) and not list_contains(['the','a','an','of','in','at','on','for','to','and','or','by','from','with','into','is','was','were','be','been','being'], x))) = 0 as subset from w""")
def token_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_annotations").where("question is not null and answer is not null")
    return rows.select("ann_no", A.token_subset(F.col("answer"), F.col("question")).alias("subset"))


# -------------------------------------------------------------------- lexical retrieval

_TF = """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents where text is not null),
c as (select doc_id, term, count(*) as tf from t group by all)
"""


@register(_TF + "select doc_id, count(*) as terms, sum(tf)::bigint as words from c group by doc_id")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_counts(table(spark, d, "documents"), "doc_id", "text").groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"))


@register(_TF + "select term, count(*) as df from c group by term")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(lexical.term_counts(table(spark, d, "documents"), "doc_id", "text"))


_BM = _TF + """, l as (select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as len from documents where text is not null),
g as (select count(*) as n, avg(len) as avgdl from l), f as (select term, count(*) as df from c group by term),
q as (select ann_no, term, count(*) as qtf from (select ann_no, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from qa_annotations where ann_no % 20 = 0) group by all),
s as (select ann_no, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) as score from q join c using (term) join f using (term) join l using (doc_id), g group by all)
"""


@register(_BM + """select ann_no, doc_id, round(score, 6) as score, row_number() over (partition by ann_no order by round(score, 6) desc, doc_id) as rank from s qualify rank <= 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every 20th question against all documents."""
    q = table(spark, d, "qa_annotations").where("ann_no % 20 = 0").select("ann_no", "question")
    out = lexical.bm25_top(q, "ann_no", "question", spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 10)
    return out.select("ann_no", "doc_id", "score", big(F.col("rank")).alias("rank"))


_HYB = _BM.replace("documents", "vdocs").replace("ann_no % 20 = 0", "ann_no % 20 = 0 and question is not null").replace("with t as", """with vdocs as (select d.doc_id, d.text, [x::double for x in e.embedding] as v from documents d join embeddings e on d.doc_id = e.vec_id where d.text is not null),
p as (select ann_no, [x::double for x in embedding] as v from qa_annotations join embeddings on ann_no % 2000 = vec_id where ann_no % 20 = 0 and question is not null),
t as""", 1)
_MIX = """, m as (select p.ann_no, d.doc_id, coalesce(score, 0.0) as l, list_cosine_similarity(p.v, d.v) as sem from p cross join vdocs d left join s on s.ann_no = p.ann_no and s.doc_id = d.doc_id),
w as (select *, min(l) over (partition by ann_no) as lo, max(l) over (partition by ann_no) as hi from m),
h as (select ann_no, doc_id, round({}, 6) as score from w)
select ann_no, doc_id, score, row_number() over (partition by ann_no order by score desc, doc_id) as rank from h qualify rank <= 5"""


def _hybrid(spark: SparkSession, d: str, alpha: float, scaled: bool) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    q = table(spark, d, "qa_annotations").where("ann_no % 20 = 0 and question is not null").select("ann_no", "question", (F.col("ann_no") % 2000).alias("vec_id")).join(e, "vec_id")
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).join(e, F.col("doc_id") == F.col("vec_id"))
    out = lexical.hybrid_top(q, "ann_no", "question", "v", docs, "doc_id", "text", "v", 5, alpha, scaled)
    return out.select("ann_no", "doc_id", "score", big(F.col("rank")).alias("rank"))


@register(_HYB + _MIX.format("0.5 * case when hi > lo then (l - lo) / (hi - lo + 1e-6) else 0.0 end + 0.5 * sem"))
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Half scaled BM25, half cosine: every 20th question with a vector against all documents that have one."""
    return _hybrid(spark, d, 0.5, True)


@register(_HYB + _MIX.format("0.4 * l + 0.6 * sem"))
def weighted_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Six tenths cosine and four tenths BM25 as it is."""
    return _hybrid(spark, d, 0.4, False)


# ------------------------------------------------------------- chunks, windows, orders


@register("""with n as (select doc_id, text, length(text) as n, greatest(0, ceil((length(text) - 100) / 700.0)::int - 1) as last from documents where length(text) > 0),
c as (select doc_id, i, substr(text, i * 700 + 1, 800) as chunk from n, unnest(range(0, last + 1)) as u(i))
select doc_id, i as chunk_no, length(chunk) as size, md5(chunk) as digest from c where length(chunk) >= 50 or i = 0""")
def chunk_800_100(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(ranking.chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", big(F.col("c.i")).alias("chunk_no"), big(F.length("c.chunk")).alias("size"), F.md5("c.chunk").alias("digest"))


_WIN = """, x as (select *, case when n >= 40 then (n - 40) // 38 + 1 else 0 end as full_w from r),
y as (select *, full_w + case when n > full_w * 38 then 1 else 0 end as w from x)
"""


@register("""with r as (select doc_id, owner_id, row_number() over (partition by owner_id order by created_at, doc_id) as place, count(*) over (partition by owner_id) as n from documents where owner_id is not null and created_at is not null)
""" + _WIN + """select owner_id, doc_id, place, i as win from y, unnest(range(greatest(0, ceil((place - 40) / 38.0)::bigint), least(w - 1, (place - 1) // 38) + 1)) as u(i)""")
def dialogue_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("owner_id is not null and created_at is not null").select("doc_id", "owner_id", "created_at")
    out = memory.dialogue_windows(rows, "owner_id", ["created_at", "doc_id"])
    return out.select("owner_id", "doc_id", big(F.col("place")).alias("place"), big(F.col("window")).alias("win"))


@register("""with r as (select note_no, row_number() over (order by note_no) as place, count(*) over () as n from memory_notes)
""" + _WIN + """select note_no, place, i as win from y, unnest(range(greatest(0, ceil((place - 40) / 38.0)::bigint), least(w - 1, (place - 1) // 38) + 1)) as u(i)""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = memory.numbered_windows(table(spark, d, "memory_notes").select("note_no"), ["note_no"])
    return out.select("note_no", "place", big(F.col("window")).alias("win"))


@register("select event_id, row_number() over (order by ts nulls last, event_id) as place from events")
def chrono_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts")
    return corpus.dense_index(e, [F.col("ts").asc_nulls_last(), F.col("event_id")], "place", start=1).select("event_id", "place")


# ------------------------------------------------------------------------- summaries


@register("""select count(*) as total, count(*) filter (where trim(coalesce(location_name, '')) <> '') as with_place, count(*) filter (where trim(coalesce(ocr_text, '')) <> '') as with_text,
min(try_cast(regexp_replace(trim(timestamp), '^(\\d{4}):(\\d{2}):(\\d{2})', '\\1-\\2-\\3') as timestamp)) as earliest, max(try_cast(regexp_replace(trim(timestamp), '^(\\d{4}):(\\d{2}):(\\d{2})', '\\1-\\2-\\3') as timestamp)) as latest from image_batch_results""")
def media_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.media_summary(_images(spark, d)).select("total", "with_place", "with_text", "earliest", "latest")


@register("""with t as (select rec_no, unnest(tags) as tag, unnest(range(1, len(tags) + 1)) as pos from image_batch_results)
select tag, count(*) as uses from t where tag is not null group by tag order by uses desc, min((rec_no, pos)) limit 10""")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return summaries.top_tags(_images(spark, d), "tags", "rec_no")


@register("""select day, count(*) as records from (select case when coalesce(timestamp, '') = '' then 'unknown' else strftime(try_cast(substr(regexp_replace(trim(timestamp), '^(\\d{4}):(\\d{2}):(\\d{2})', '\\1-\\2-\\3'), 1, 19) as timestamp), '%Y-%m-%d') end as day
from image_batch_results) where day is not null group by day""")
def group_by_day(spark: SparkSession, d: str) -> DataFrame:
    return summaries.by_day(_images(spark, d), "timestamp", "rec_no")


# ----------------------------------------------------------------------------- usage


@register("select event_type, count(*) as events, sum((props->>'$.k')::bigint)::bigint as total, count((props->>'$.k')::bigint) as present from events group by event_type")
def props_totals(spark: SparkSession, d: str) -> DataFrame:
    k = usage.int_at(F.try_parse_json("props"), "k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(k).alias("total"), F.count(k).alias("present"))


@register("""with r as (select user_id, event_id, (props->>'$.k')::bigint as t, case when event_type = 'purchase' then null else event_type end as g from events),
gr as (select user_id, g, max((coalesce(t, 0), event_id)) as m from r where g is not null group by all),
l as (select user_id, event_id, t, max(t) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as b from r where g is null),
sh as (select user_id, count(t) >= 2 and count(*) filter (where t < b) = 0 and sum(t) > max(t) * 1.2 as running, max(t) as mx from l group by user_id),
d as (select distinct l.user_id, l.t from l join sh using (user_id) where not running),
c as (select user_id, r.t from gr join r using (user_id) where r.event_id = m[2] union all select user_id, mx from sh where running union all select user_id, t from d)
select user_id, sum(t)::bigint as total_tokens, count(*) as records_selected from c group by user_id""")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs, event types as call groups, events of one type ungrouped; the number in props is the token count."""
    e = table(spark, d, "events")
    group = F.when(F.col("event_type") != "purchase", F.col("event_type"))
    n = lambda: F.lit(None).cast("bigint")
    rec = e.select("user_id", "event_id", group.alias("group_id"), n().alias("input_tokens"), n().alias("output_tokens"), usage.int_at(F.try_parse_json("props"), "k").alias("total_tokens"), F.lit(None).cast("double").alias("cost_usd"))
    return usage.total_usage(rec, ["user_id"], ["event_id"]).select("user_id", "total_tokens", "records_selected")


# ------------------------------------------------------------- streams and star schema


@register("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as events, round(sum(value), 2) as total from events group by all")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.window_counts(table(spark, d, "events")).select("start", "event_type", "events", F.round("total", 2).alias("total"))


@register("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh, event_id from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) as n from o)
select user_id, min(ts) as start, max(ts) + interval 30 minute as end, count(*) as events from s group by user_id, n""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(table(spark, d, "events"))


@register("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice), 2) as price, round(avg(l_discount), 4) as discount, count(*) as lines, count(distinct l_partkey) as parts
from lineitem group by rollup (l_returnflag, l_linestatus)""")
def lines_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return g.agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 4).alias("discount"), F.count(F.lit(1)).alias("lines"), F.countDistinct("l_partkey").alias("parts"))


@register("""select r_name, n_name, count(distinct o_orderkey) as orders, round(sum(l_extendedprice), 2) as price from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@register("""select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate) as since from orders""")
def order_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    since = big(F.datediff("o_orderdate", F.lag("o_orderdate").over(w)))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", big(F.row_number().over(w)).alias("nth"), since.alias("since"))


@register("select tag, count(*) as notes from (select note_no, unnest(list_distinct([lower(trim(t)) for t in tags if length(trim(t)) > 1])) as tag from memory_notes) group by tag")
def tag_set(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "memory_notes").where("tags is not null").select(F.explode(formats.tag_set(F.array_join("tags", ","))).alias("tag"))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("notes"))


# Further families of queries register themselves.
from keepsake.plans import answer_queries, file_queries, record_queries, text_queries, trace_queries  # noqa: E402,F401
