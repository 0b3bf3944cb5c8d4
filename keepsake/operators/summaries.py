"""Summaries of processed records, runs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.formats import day_key


def media_summary(records: DataFrame) -> DataFrame:
    """One row of counts over media records: all, failed, with place, text, entities, the first and last time, the duration.

    Columns that the table lacks count as null. A record with an error failed.
    """
    has = lambda c: c in records.columns
    filled = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) != "") if has(c) else F.lit(0).cast("bigint")
    listed = lambda c: F.count_if(F.size(F.col(c)) > 0) if has(c) else F.lit(0).cast("bigint")
    bad = F.count_if(F.coalesce(F.col("error"), F.lit("")) != "") if has("error") else F.lit(0).cast("bigint")
    ok = F.coalesce(F.col("error"), F.lit("")) == "" if has("error") else F.lit(True)
    time = F.regexp_replace(F.trim("timestamp"), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3").try_cast("timestamp")
    duration = F.sum(F.when(ok, F.col("duration"))) if has("duration") else F.lit(None).cast("double")
    out = records.agg(
        F.count(F.lit(1)).alias("total"), bad.alias("failed"), filled("location_name").alias("with_place"), filled("ocr_text").alias("with_text"), listed("entities").alias("with_entities"),
        F.min(time).alias("earliest"), F.max(time).alias("latest"), duration.alias("duration"),
    )
    return out.withColumn("success_rate", F.when(F.col("total") > 0, (F.col("total") - F.col("failed")) / F.col("total")).otherwise(0.0))


def top_tags(records: DataFrame, tags: str, order: str, n: int = 10) -> DataFrame:
    """(tag, uses) of the n most used tags; of equal ones that which comes first by ``order`` and place."""
    rows = records.select(F.col(order).alias("o"), F.posexplode(tags).alias("pos", "tag")).where("tag is not null")
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("o", "pos")).alias("first")).orderBy(F.desc("uses"), "first").limit(n).select("tag", "uses")


def by_day(records: DataFrame, time: str, key: str) -> DataFrame:
    """(day, records): how many per day, unknown where the time is missing; unreadable times are dropped."""
    return records.select(day_key(F.col(time)).alias("day"), key).where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("records"))


def mail_summary(mails: DataFrame) -> DataFrame:
    """One row: mails in all, read and failed, the first and last time and the whole days between (status, timestamp)."""
    ok = F.col("status") == "success"
    t = F.when(ok, F.col("timestamp").try_cast("timestamp"))
    out = mails.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.min(t).alias("earliest"), F.max(t).alias("latest"))
    days = F.floor((F.unix_micros("latest") - F.unix_micros("earliest")) / 86_400_000_000)
    return out.withColumn("errors", F.col("total") - F.col("success")).withColumn("span_days", days)


def categories(mails: DataFrame) -> DataFrame:
    """(category, mails): the parts of the comma lists of classified mails, each counted as often as it is named."""
    parts = F.transform(F.split("classification", ","), lambda s: F.trim(s))
    return mails.where("status = 'success' and classification is not null").select(F.explode(parts).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("mails"))


def run_report(records: DataFrame) -> DataFrame:
    """Accuracies by question type of many runs, side by side: model, mode, k, judge, then percent with one decimal, blank where absent.

    ``records``: model, mode, k, judge, qtype, accuracy.
    """
    wide = records.groupBy("model", "mode", "k", "judge").pivot("qtype", ["number", "list_recall", "open_end", "all"]).agg(F.max("accuracy"))
    show = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.1f", F.col(c) * 100)).otherwise("")
    return wide.select("model", "mode", "k", "judge", *[show(c).alias(c) for c in ("number", "list_recall", "open_end", "all")]).orderBy("model", "mode", "judge", "k")


def markdown(report: DataFrame) -> DataFrame:
    """(line, text): a report as the lines of a markdown table, in the report's order of its first columns."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]), F.lit(" |"))
    n = F.row_number().over(Window.orderBy(*report.columns[:4])) + 2
    head = report.sparkSession.createDataFrame(
        [(1, "| " + " | ".join(report.columns) + " |"), (2, "|" + "---|" * len(report.columns))], "line int, text string"
    )
    return head.unionByName(report.select(n.alias("line"), row.alias("text")))


def html(report: DataFrame, title: str) -> DataFrame:
    """(line, text): a report as the lines of an HTML page, cells escaped, in the order of its first columns."""
    def safe(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in report.columns], F.lit("</tr>"))
    n = F.row_number().over(Window.orderBy(*report.columns[:4])) + 1
    name = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = f"<html><head><title>{name}</title></head><body><table><tr>" + "".join(f"<th>{c}</th>" for c in report.columns) + "</tr>"
    ends = report.sparkSession.createDataFrame([(1, head), (2147483647, "</table></body></html>")], "line int, text string")
    return ends.unionByName(report.select(n.alias("line"), row.alias("text")))
