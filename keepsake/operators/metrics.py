"""Retrieval metrics: recall in its list, deduplicated and set forms, precision at the truth, hits, joint scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10, 25, 50, 100, 200)


def _ids(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def hits_within(gt: Column, ranked: Column, k: int) -> Column:
    """How many of the first ``k`` ranked ids are true ones, repeats counted."""
    g = _ids(gt)
    return F.size(F.filter(F.slice(_ids(ranked), 1, k), lambda x: F.array_contains(g, x)))


def recall_list(gt: Column, ranked: Column, k: int) -> Column:
    """Hits within k over the number of true ids; repeats count each time; 0 without true ids."""
    n = F.size(_ids(gt))
    return F.when(n > 0, hits_within(gt, ranked, k) / n).otherwise(0.0)


def recall_deduplicated(gt: Column, ranked: Column, k: int) -> Column:
    return recall_list(gt, F.array_distinct(_ids(ranked)), k)


def recall_set(gt: Column, ranked: Column, k: int) -> Column:
    """Distinct true ids within k over the distinct true ids; null without true ids."""
    g = F.array_distinct(_ids(gt))
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, F.slice(_ids(ranked), 1, k))) / F.size(g))


def r_precision(gt: Column, ranked: Column) -> Column:
    """Recall at as many ids as there are distinct true ones; null without true ids."""
    g, r = F.array_distinct(_ids(gt)), _ids(ranked)
    top = F.slice(r, F.lit(1), F.greatest(F.lit(0), F.least(F.size(g), F.size(r))))
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, top)) / F.size(g))


def hit_at_1(gt: Column, ranked: Column) -> Column:
    return F.when(F.size(_ids(gt)) > 0, F.coalesce(F.array_contains(_ids(gt), F.get(_ids(ranked), 0)), F.lit(False)).cast("double"))


def macro_recall(df: DataFrame, gt: str, ranked: str, ks: tuple[int, ...] = KS, form=recall_list) -> DataFrame:
    """(k, recall, questions): the mean over all rows (of the set form, over rows with true ids)."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), form(F.col(gt), F.col(ranked), k).alias("r")) for k in ks])
    return df.select(F.explode(cells).alias("c")).groupBy("c.k").agg(F.avg("c.r").alias("recall"), F.count("c.r").alias("questions"))


def retrieval_report(df: DataFrame, gt: str, ranked: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: set recall at each k, precision at the truth, hit at 1 and the sizes of the truth; rows without truth are only counted."""
    g, r = F.col(gt), F.col(ranked)
    n = F.when(F.size(F.array_distinct(_ids(g))) > 0, F.size(F.array_distinct(_ids(g))))
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return df.agg(
        *[zero(recall_set(g, r, k)).alias(f"recall_at_{k}") for k in ks], zero(r_precision(g, r)).alias("recall_at_gt"), zero(hit_at_1(g, r)).alias("hit_at_1"),
        F.count(n).alias("with_gt"), F.count_if(n.isNull()).alias("empty_gt"), F.avg(n).alias("gt_avg"), F.min(n).alias("gt_min"), F.max(n).alias("gt_max"),
    )


def joint_report(details: DataFrame, scores: DataFrame, key: str, gt: str, ranked: str, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row: answers that are right with all evidence (strict) or weighted by recall (partial) at each k.

    ``scores``: key, accuracy, unique by key. Any accuracy above 0 is right.
    Rows without truth, then rows without score, are counted and left out.
    """
    d = details.select(F.col(key).cast("string").alias("_k"), F.col(gt).alias("_g"), F.col(ranked).alias("_r"))
    s = scores.select(F.col(key).cast("string").alias("_s"), F.coalesce(F.col("accuracy") > 0, F.lit(False)).alias("_right"), F.lit(True).alias("_has"))
    j = d.join(s, F.col("_k") == F.col("_s"), "left")
    some = F.size(_ids(F.col("_g"))) > 0
    use = some & F.col("_has").isNotNull()
    mean = lambda c: F.coalesce(F.avg(F.when(use, c)), F.lit(0.0))
    right = F.col("_right").cast("double")
    cols = []
    for k in ks:
        rec = recall_set(F.col("_g"), F.col("_r"), k)
        cols += [mean(F.when(rec == 1.0, right).otherwise(0.0)).alias(f"strict_at_{k}"), mean(right * rec).alias(f"partial_at_{k}")]
    return j.agg(*cols, F.count_if(use).alias("with_gt"), F.count_if(~some).alias("empty_gt"), F.count_if(some & F.col("_has").isNull()).alias("missing_answer"))


def depth(df: DataFrame, ranked: str) -> DataFrame:
    """(depth): the length of the longest ranking; 0 where there is none."""
    return df.agg(F.coalesce(F.max(F.size(_ids(F.col(ranked)))), F.lit(0)).cast("bigint").alias("depth"))


def recall_detail(df: DataFrame, key: str, gt: str, ranked: str, scores: str, ks: tuple[int, ...] = KS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per row: key, true ids (once each), ranked ids with their scores, and the recall at each k."""
    true = _ids(F.array_distinct(F.filter(F.col(gt), lambda x: x.isNotNull() & (x != ""))))
    return df.select(*keep, F.col(key).alias("id"), true.alias("gt_evidence_ids"), _ids(F.col(ranked)).alias("retrieval_ids"), F.col(scores).alias("retrieval_scores")).select(
        "*", *[recall_list(F.col("gt_evidence_ids"), F.col("retrieval_ids"), k).alias(f"recall_at_{k}") for k in ks]
    )


def coverage(df: DataFrame, tier: str) -> DataFrame:
    """(tier, entries, ratio) of an attribution."""
    from pyspark.sql import Window

    g = df.groupBy(tier).agg(F.count(F.lit(1)).alias("entries"))
    return g.withColumn("ratio", F.col("entries") / F.sum("entries").over(Window.partitionBy()))
