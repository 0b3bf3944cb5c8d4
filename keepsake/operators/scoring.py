"""Scoring of answers: exact match by an ordered cascade, list overlap, routing by question type, summaries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import answers as A
from keepsake.operators.lookups import last_by_key

TYPES = ("number", "list_recall", "open_end")


def exact_match(df: DataFrame, gt: str, pred: str, question: str | None = None) -> DataFrame:
    """``df`` with ``correct`` and ``normalised_prediction``, by the first rule of the cascade that decides.

    Null texts count as empty. Stages are separate projections so that each
    token array is made once per row; all is built-in expressions. Columns of
    these two names are replaced.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("correct", "normalised_prediction")]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    day = A.reference_date(text(question)) if question else F.lit(None).cast("date")
    s = df.select(*keep, text(gt).alias("_g0"), text(pred).alias("_p0"), day.alias("_day"))
    prep = lambda c: A.without_article(A.shared_prep(A.resolve_relative(F.col(c), F.col("_day"))))
    s = s.select("*", A.abstains(F.col("_g0")).alias("_ga"), A.abstains(F.col("_p0")).alias("_pa"), prep("_g0").alias("_g"), prep("_p0").alias("_p"))
    g, p = F.col("_g"), F.col("_p")
    s = s.select(
        "*", A.normalise_text(g).alias("_gn"), A.normalise_text(p).alias("_pn"), A.codes(g).alias("_gc"),
        A.date_tokens(g).alias("_gd"), A.date_tokens(p).alias("_pd"), A.time_tokens(g).alias("_gt"), A.time_tokens(p).alias("_pt"),
        A.without_dates_times(g).alias("_gr"), A.without_dates_times(p).alias("_pr"), A.list_items(g).alias("_gi"),
        A.content(g).alias("_gk"), A.content(p).alias("_pk"), A.tokens(p).alias("_pw"), A.amounts(g).alias("_gall"), A.amounts(p).alias("_pall"),
        F.regexp_replace(F.upper(p), r"\b(?:CODE|ID|REFERENCE|REF|NUMBER|NUM|LABEL):\s*", "").alias("_pu"),
    )
    gr, pr = F.col("_gr"), F.col("_pr")
    s = s.select(
        "*", A.without_context(A.normalise_text(gr)).alias("_gx"), A.without_context(A.normalise_text(pr)).alias("_px"),
        A.currencies(gr).alias("_gcur"), A.currencies(pr).alias("_pcur"), A.amounts(gr).alias("_gam"), A.amounts(pr).alias("_pam"),
        A.numbers(gr).alias("_gnum"), A.numbers(pr).alias("_pnum"),
    )
    some = lambda c: F.size(c) > 0
    c = F.col
    rest = lambda nums, other: F.when(some(c("_gam")), F.filter(c(nums), lambda n: ~F.array_contains(c(other), n))).otherwise(c(nums))
    s = s.select("*", rest("_gnum", "_gam").alias("_gno"), rest("_pnum", "_pam").alias("_pno"), A.content(c("_gx")).alias("_gxk"), A.tokens(c("_px")).alias("_pxw"))
    dated = some(c("_gd")) | some(c("_gt"))
    yes_no = c("_gn").startswith("yes") | c("_gn").startswith("no")
    verdict = (
        F.when(c("_ga") | c("_pa"), c("_ga") & c("_pa"))
        .when(F.exists("_gc", lambda w: ~c("_pu").contains(w)), False)
        .when(some(c("_gd")) & ~A.dates_match(c("_gd"), c("_pd")), False)
        .when(some(c("_gt")) & some(c("_pt")) & ~A.same_bag(c("_gt"), c("_pt")), False)
        .when(dated & ((c("_gx") == "") | A.covers(c("_pxw"), c("_gxk"))), True)
        .when(some(c("_gcur")) & some(c("_pcur")) & (c("_gcur") != c("_pcur")), False)
        .when(some(c("_gam")) & ~A.same_bag(c("_gam"), c("_pam")), False)
        .when(some(c("_gno")) & ~A.same_bag(c("_gno"), c("_pno")), False)
        .when(F.size("_gi") >= 2, F.forall("_gi", lambda i: c("_pn").contains(i)))
        .when(yes_no & c("_pn").isin("yes", "no"), c("_gn").startswith(c("_pn")))
        .when(A.names_place(c("_pw"), c("_gk")), True)
        .when((F.length("_gn") >= 3) & c("_pn").contains(c("_gn")), True)
        .when((F.length("_pn") >= 3) & c("_gn").contains(c("_pn")), True)
        .when(A.covers(c("_pw"), c("_gk")), True)
        .when(A.units_agree(tuple(map(c, ("_gd", "_gt", "_gall", "_gk"))), tuple(map(c, ("_pd", "_pt", "_pall", "_pk")))), True)
        .otherwise(c("_gn") == c("_pn"))
    )
    return s.select(*keep, verdict.alias("correct"), c("_pn").alias("normalised_prediction"))


def with_predictions(qas: DataFrame, predictions: DataFrame, key: str = "id", answer: str = "answer", order: str = "ord") -> DataFrame:
    """``qas`` with ``prediction``: the last answer of the same key, or empty."""
    p = last_by_key(predictions.select(key, answer, order), [key], [order]).select(F.col(key).cast("string").alias("_k"), F.col(answer).alias("_a"))
    return qas.join(p, qas[key].cast("string") == F.col("_k"), "left").withColumn("prediction", F.coalesce("_a", F.lit(""))).drop("_k", "_a")


Judge = Callable[[pd.DataFrame], pd.Series]


def score_answers(df: DataFrame, gt: str, pred: str, question: str, qtype: str, judge: Judge | None = None) -> DataFrame:
    """``df`` with ``type``, ``metric`` and ``accuracy``: number by exact match, list by overlap, open by ``judge``.

    ``judge`` gets batches (question, ground_truth, prediction) and returns
    scores; without one, open answers score by exact match.
    """
    typed = exact_match(df.withColumn("type", A.question_type(F.coalesce(F.col(gt), F.lit("")), F.col(qtype))), gt, pred, question)
    overlap = A.list_jaccard(F.coalesce(F.col(gt), F.lit("")), F.coalesce(F.col(pred), F.lit("")))
    exact = F.col("correct").cast("double")
    if judge is None:
        opened = exact
    else:

        @F.pandas_udf("double")
        def ask(q: pd.Series, g: pd.Series, p: pd.Series) -> pd.Series:
            return judge(pd.DataFrame({"question": q, "ground_truth": g, "prediction": p})).astype("float64")

        opened = F.when(F.col("type") == "open_end", ask(F.col(question), F.col(gt), F.col(pred)))
    score = F.when(F.col("type") == "number", exact).when(F.col("type") == "list_recall", overlap).otherwise(opened)
    metric = F.when(F.col("type") == "number", "em").when(F.col("type") == "list_recall", "jaccard").otherwise("llm")
    return typed.withColumn("accuracy", score).withColumn("metric", metric).drop("correct")


def summarise_scores(df: DataFrame, qtype: str = "type", score: str = "accuracy") -> DataFrame:
    """(qtype, count, correct, accuracy) for each of the three types and in all; types without rows have zeros.

    Unknown and null types count as open; scores are coerced into [0, 1].
    """
    t = F.lower(F.col(qtype))
    rows = df.select(F.when(t.isin(*TYPES), t).otherwise("open_end").alias("qtype"), A.unit_score(F.col(score)).alias("s"))
    got = rows.rollup("qtype").agg(F.count(F.lit(1)).alias("count"), F.sum("s").alias("correct")).withColumn("qtype", F.coalesce("qtype", F.lit("all")))
    every = df.sparkSession.createDataFrame([(q,) for q in (*TYPES, "all")], "qtype string")
    out = every.join(got, "qtype", "left").na.fill({"count": 0, "correct": 0.0})
    return out.withColumn("accuracy", F.when(F.col("count") > 0, F.col("correct") / F.col("count")).otherwise(0.0))


def judged(df: DataFrame, judge: Judge, key: str, cache: DataFrame | None = None) -> DataFrame:
    """Scores (key, accuracy, failed) of rows (key, question, ground_truth, prediction); cached successes are not asked again.

    A judge that raises on a batch scores its rows 0 and marks them failed, so
    that a later run asks again.
    """
    todo, done = df, None
    if cache is not None:
        done = cache.where(~F.coalesce(F.col("failed"), F.lit(False))).select(key, "accuracy", F.lit(False).alias("failed"))
        todo = df.join(done.select(key), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                yield pd.DataFrame({key: f[key], "accuracy": judge(f).astype("float64"), "failed": False})
            except Exception:
                yield pd.DataFrame({key: f[key], "accuracy": 0.0, "failed": True})

    kind = df.schema[key].dataType.simpleString()
    new = todo.select(key, "question", "ground_truth", "prediction").mapInPandas(run, f"{key} {kind}, accuracy double, failed boolean")
    return new if done is None else done.join(df.select(key), key, "left_semi").unionByName(new)


class Refused(Exception):
    """A judge will not answer this row, however often it is asked."""


OneJudge = Callable[[dict], float]


def judged_with_retries(
    df: DataFrame, judge: Callable[[], OneJudge], key: str, cache: DataFrame | None = None, fallback: Callable[[], OneJudge] | None = None,
    tries: int = 3, wait: float = 1.0, fallback_after: int = 2, throttled_tries: int = 10,
) -> DataFrame:
    """Scores (key, accuracy, failed, retries, fallback) of rows asked one by one, with patience.

    ``judge`` and ``fallback`` make a judge once per task. A failure is tried
    again after wait x 2^(n-1) seconds, up to ``tries`` times, or
    ``throttled_tries`` once an error names status 429. After ``fallback_after``
    failures, or at once if the judge refuses, the fallback is asked instead. A
    refusal without fallback ends the row. Rows that end without score have 0 and
    failed, and are asked again in a later run; successes in ``cache`` (key,
    accuracy, failed) are not. Scores outside [0, 1] are cut to it.
    """
    todo = df
    if cache is not None:
        good = cache.where(~F.coalesce(F.col("failed"), F.lit(False))).select(key, "accuracy").dropDuplicates([key])
        todo = df.join(good.select(key), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = judge(), None
        for f in frames:
            rows = []
            for r in f.astype(object).where(f.notna(), None).to_dict("records"):
                ask, n, most, spare, score = first, 0, tries, False, None
                while score is None and n < most:
                    try:
                        score = min(1.0, max(0.0, float(ask(r))))
                    except Exception as e:
                        n += 1
                        refused = isinstance(e, Refused)
                        most = max(most, throttled_tries) if "429" in str(e) else most
                        if fallback and not spare and (refused or n >= fallback_after):
                            second = second or fallback()
                            ask, spare = second, True
                        elif refused:
                            break
                        elif n < most and wait:
                            time.sleep(wait * 2 ** (n - 1))
                rows.append((r[key], score or 0.0, score is None, n, spare))
            yield pd.DataFrame(rows, columns=[key, "accuracy", "failed", "retries", "fallback"])

    kind = df.schema[key].dataType.simpleString()
    new = todo.select(key, "question", "ground_truth", "prediction").mapInPandas(run, f"{key} {kind}, accuracy double, failed boolean, retries int, fallback boolean")
    if cache is None:
        return new
    return good.join(df.select(key), key, "left_semi").select(key, "accuracy", F.lit(False).alias("failed"), F.lit(0).alias("retries"), F.lit(False).alias("fallback")).unionByName(new)
