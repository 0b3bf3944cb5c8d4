"""Messages for an answering model: evidence, media within a budget of frames, token counts of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators.corpus import blank, numbered


def text_messages(question: Column, chunks: Column, system: str, template: str = "{evidence}\n\nQuestion: {question}") -> Column:
    """array<struct(role, content)>: a system message and the template filled with numbered evidence and the question."""
    user = F.replace(F.replace(F.lit(template), F.lit("{evidence}"), numbered(chunks)), F.lit("{question}"), blank(question))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def frame_budget(evidence: DataFrame, key: str, order: str, kind: str, per_video: int, most: int) -> DataFrame:
    """``evidence`` with ``frames``: how many frames of each video go into the message, 0 for all else.

    A video gets at most ``per_video`` and its share of ``most``, at least one,
    while the sum over the videos before it leaves room. Evidence of one
    question is bounded by what a message holds, so a window over it is small.
    """
    w = Window.partitionBy(key)
    video = (F.col(kind) == "video").cast("int")
    share = F.greatest(F.lit(1), F.least(F.lit(per_video), F.floor(most / F.greatest(F.lit(1), F.sum(video).over(w))).cast("int")))
    each = evidence.withColumn("_f", video * share)
    before = F.coalesce(F.sum("_f").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("frames", F.greatest(F.lit(0), F.least(F.col("_f"), F.lit(most) - before)).cast("int")).drop("_f")


def media_part(label: Column, content: Column, mime: Column) -> Column:
    """struct(label, url): a labelled data URL of raw bytes."""
    return F.struct(label.alias("label"), F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content)).alias("url"))


def answer_after_marker(reply: Column, marker: str = "Answer:") -> Column:
    """What follows the first marker up to the next, trimmed; the whole reply where there is none."""
    part = F.when(reply.contains(marker), F.get(F.split(reply, marker), 1)).otherwise(reply)
    return F.regexp_replace(part, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def normalised_answer(expected_id: Column, question: Column, told_question: Column, answer: Column) -> Column:
    """struct(id, question, answer, missing): the expected id, the known question before the told one, and the required fields that are blank."""
    q = F.coalesce(F.when(question != "", question), told_question, F.lit(""))
    fields = {"id": blank(expected_id), "question": q, "answer": blank(answer)}
    missing = F.filter(F.array(*[F.when(c == "", F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())
    return F.struct(*[c.alias(n) for n, c in fields.items()], missing.alias("missing"))


def or_default(value: Column, fallback: str, legacy: tuple[str, ...] = ()) -> Column:
    """``value`` unless it is null, blank or a legacy value."""
    v = F.trim(value)
    return F.when((v != "") & ~v.isin(*legacy, ""), v).otherwise(F.lit(fallback))


def token_stats(runs: DataFrame) -> DataFrame:
    """One row: answers, and sums and means of prompt, completion and total tokens; a missing total is the sum of the others."""
    total = F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    cols = {"prompt": F.col("prompt_tokens"), "completion": F.col("completion_tokens"), "total": total}
    sums = [x for n, c in cols.items() for x in (F.sum(c).alias(f"{n}_sum"), F.avg(c).alias(f"{n}_avg"))]
    return runs.agg(F.count(F.lit(1)).alias("answers"), *sums)
