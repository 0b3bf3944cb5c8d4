"""Sinks: JSON documents and lines, upserts, progress, the vector index, memory variants."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators.corpus import stem
from keepsake.operators.lookups import last_by_key
from keepsake.operators.summaries import html
from keepsake.runtime import hadoop_path
from keepsake.sources.readers import exists

# Names of the memory variants.
MODES = {"sgm": "sgm", "schema": "sgm", "schema_guided": "sgm", "raw": "raw", "media": "raw", "descriptive": "descriptive", "caption": "descriptive", "dm": "descriptive"}


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One compact JSON object per line, null fields kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A small table as one pretty JSON array file; for summaries, whose size is bounded by their grouping."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    text = json.dumps(rows, ensure_ascii=False, indent=2, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def upsert(df: DataFrame, path: str, key: str = "id") -> None:
    """Append rows as one batch; ``read_upserted`` keeps the last of each key, so nothing is rewritten.

    Batches count in the order of the clocks of their writers; two of one moment
    still differ by a random name, so that one of them wins whole.
    """
    out = df.withColumn("_batch", F.lit(time.time_ns())).withColumn("_writer", F.lit(uuid.uuid4().hex)).withColumn("_n", F.monotonically_increasing_id())
    out.write.mode("append").parquet(path)


def read_upserted(spark, path: str, key: str = "id") -> DataFrame:
    return last_by_key(spark.read.parquet(path), [key], ["_batch", "_writer", "_n"]).drop("_batch", "_writer", "_n")


def append_progress(df: DataFrame, path: str) -> None:
    """Progress rows (item_id, status, error) behind those already logged."""
    write_lines(df.select("item_id", "status", F.col("error") if "error" in df.columns else F.lit(None).cast("string").alias("error")), path, append=True)


def rewrite_progress(ids: DataFrame, path: str) -> None:
    """A progress log of exactly these ids, sorted.

    The new log is written whole beside the old one, which then makes place for
    it by two renames; whoever dies between them leaves the old log under its
    name with ``.old``, and nothing is lost.
    """
    spark = ids.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    write_lines(ids.select("item_id", F.lit("success").alias("status")).distinct().orderBy("item_id"), fresh)
    fs, new = hadoop_path(spark, fresh)
    at, old = hadoop_path(spark, path)[1], hadoop_path(spark, f"{path}.old")[1]
    if fs.exists(at):
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise OSError(f"cannot replace {path}")
    if not fs.rename(new, at):
        raise OSError(f"cannot write {path}")
    fs.delete(old, True)


def write_file(spark, path: str, content: str | bytes) -> None:
    """One small file, replacing what was there."""
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()


def cache_key(config: dict) -> str:
    """A digest of a configuration that does not depend on the order of its keys."""
    return hashlib.md5(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def save_index(df: DataFrame, path: str, key: str) -> None:
    """Items and vectors under a cache key, replacing what was there."""
    df.write.mode("overwrite").parquet(f"{path}/cache_key={key}")


def clean_indexes(spark, path: str, keep: list[str]) -> list[str]:
    """Deletes what lies below ``path`` and is no whole index of a cache key of ``keep``; the names of what went."""
    fs, root = hadoop_path(spark, path)
    gone = []
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        at = entry.getPath()
        name = at.getName()
        whole = fs.exists(hadoop_path(spark, f"{path}/{name}/_SUCCESS")[1])
        if not (whole and name.removeprefix("cache_key=") in keep):
            fs.delete(at, True)
            gone.append(str(name))
    return sorted(gone)


def build_index(items: DataFrame, path: str, config: dict, encode, force: bool = False) -> DataFrame:
    """The stored index of a configuration, encoded and saved first where it is missing or ``force``."""
    from keepsake.sources.readers import vector_index

    spark, key = items.sparkSession, cache_key(config)
    have = None if force else vector_index(spark, path, key)
    if have is None:
        save_index(encode(items), path, key)
        have = vector_index(spark, path, key)
    return have


def memory_mode(name: str) -> str:
    mode = MODES.get(name.strip().lower().replace("-", "_"))
    if mode is None:
        raise ValueError(f"unknown memory mode {name!r}; known: {', '.join(sorted(set(MODES.values())))}")
    return mode


def memory_variant(images: DataFrame, videos: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Images and videos as the variant shows them: whole records, ids with a relative path, or ids with captions."""

    def view(df: DataFrame, path: str, folder: str) -> DataFrame:
        name = F.regexp_extract(path, r"([^/]+)/*$", 1)
        if mode == "raw":
            return df.select(stem(F.col(path)).alias("id"), F.concat(F.lit(f"{folder}/"), name).alias(path))
        if mode == "descriptive":
            return df.select(stem(F.col(path)).alias("id"), "caption")
        return df

    return view(images, "image_path", "images"), view(videos, "video_path", "videos")


def write_variant(images: DataFrame, videos: DataFrame, mails: DataFrame, mode: str, out: str) -> DataFrame:
    """Writes a memory variant and returns its manifest (mode, images, videos, mails)."""
    mode = memory_mode(mode)
    i, v = memory_variant(images, videos, mode)
    for name, df in (("images", i), ("videos", v), ("emails", mails)):
        write_lines(df, f"{out}/{name}")
    manifest = images.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("images")).join(videos.agg(F.count(F.lit(1)).alias("videos"))).join(mails.agg(F.count(F.lit(1)).alias("mails")))
    write_document(manifest, f"{out}/manifest")
    return manifest


def merge_missing(source: DataFrame, target: str, key: str) -> None:
    """Rows of ``source`` whose key the table at ``target`` lacks are appended; nothing there is overwritten."""
    spark = source.sparkSession
    new = source
    if exists(spark, target):
        new = source.join(spark.read.parquet(target).select(key).distinct(), key, "left_anti")
    new.write.mode("append").parquet(target)


def write_report(report: DataFrame, path: str, title: str) -> None:
    """A report as a page of HTML, a table row for each of its rows; for reports, whose size is bounded by their grouping."""
    html(report, title).orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(path)
