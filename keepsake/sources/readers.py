"""Sources: JSON documents and lines, files of a folder, runs and reports, progress and caches, an index of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepsake.functions.jsontext import first_json_object
from keepsake.operators.corpus import stem
from keepsake.operators.lookups import last_by_key
from keepsake.runtime import hadoop_path

# The record shapes of the archive.
QA = "id string, question string, answer string, evidence_ids array<string>, niah_evidence_ids array<string>, qtype string"
MAIL = "id string, timestamp string, short_summary string, detail string, subject string, sender string, location string"
MEDIA = "image_path string, video_path string, timestamp string, location_name string, short_caption string, caption string, ocr_text string, tags array<string>"
PROGRESS = "item_id string, status string, error string"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def path_root(spark: SparkSession, path: str) -> str:
    """``path`` as listings of its file system write it."""
    fs, p = hadoop_path(spark, path)
    return str(fs.makeQualified(p).toString())


def json_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One row per element of a JSON array file (or one for an object); malformed files raise."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def qa_list(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a file that is an array or holds one under ``qas``; anything else raises."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    text = F.when(kind.startswith("ARRAY"), F.to_json("v")).otherwise(F.to_json(F.try_variant_get("v", "$.qas", "variant")))
    rows = F.from_json(text, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in QA.split(', '))}>>")
    checked = F.when(rows.isNull(), F.raise_error(F.lit("unsupported question schema: neither a list nor an object with qas"))).otherwise(rows)
    return whole.select(F.posexplode(checked).alias("ord", "q")).select(F.col("ord").cast("bigint").alias("ord"), "q.*")


def json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """One row per line; blank lines are dropped. Malformed lines raise, or are dropped if not ``strict``, as is a missing file."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def trace_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, seq, event, v): JSON lines of traces as text and variant, numbered within their file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("seq", "event"))
    lines = lines.where(F.trim("event") != "").withColumn("seq", F.col("seq").cast("bigint"))
    return lines.withColumn("v", F.parse_json("event") if strict else F.try_parse_json("event"))


def json_with_recovery(spark: SparkSession, path: str) -> DataFrame:
    """(path, v): each file as a variant; of one that is no JSON, the first balanced object in it, else null."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.coalesce(F.try_parse_json("value"), F.try_parse_json(first_json_object(F.col("value")))).alias("v"))


def existing_results(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Results by key, the last of each; a missing file gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    kinds = ", ".join(f.strip().replace(" ", ":", 1) for f in schema.split(","))
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{kinds}>>")).alias("ord", "r")).select("ord", "r.*").where(F.col(key).isNotNull())
    return last_by_key(rows, [key], ["ord"]).drop("ord")


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...], content: bool = True) -> DataFrame:
    """(path, modificationTime, length, content): files below a folder by suffix in any case; sort by path or time as needed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    keep = df.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return keep if content else keep.drop("content")


def mail_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, text) of html and eml files; the binary msg format raises when its text is asked for."""
    df = files(spark, folder, (".html", ".htm", ".eml", ".msg"))
    kind = F.when(F.lower("path").endswith(".eml"), "eml").when(F.lower("path").endswith(".msg"), "msg").otherwise("html")
    text = F.when(kind == "msg", F.raise_error(F.lit("msg files are not supported"))).otherwise(F.decode("content", "UTF-8"))
    return df.select("path", "modificationTime", kind.alias("kind"), text.alias("text"))


def question_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def path_part(path: Column, from_end: int) -> Column:
    """The ``from_end``-th last part of a path, 1 being the file name."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def collect_runs(spark: SparkSession, ids: DataFrame, runs: str, run_tag: str, agent: str, model: str, name: str = "answer.json", fields: str = "id string, question string, answer string") -> DataFrame:
    """(id, status, fields): each question's artifact at runs/tag/agent/model/id/output/name: collected, missing or malformed.

    An artifact is malformed if it is no JSON object with all fields present.
    """
    pattern = f"{runs}/{run_tag}/{agent}/{model}/*/output/{name}"
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    fs, p = hadoop_path(spark, pattern)
    found = fs.globStatus(p)
    if found is None or not len(found):
        got = spark.createDataFrame([], f"_id string, r struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>, _has boolean")
    else:
        raw = spark.read.text(pattern, wholetext=True).select(path_part(F.col("_metadata.file_path"), 3).alias("_id"), "value")
        got = raw.select("_id", F.from_json("value", fields).alias("r"), F.lit(True).alias("_has"))
    j = ids.join(got, ids["id"] == got["_id"], "left")
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"r.{n}").isNotNull()
    status = F.when(F.col("_has").isNull(), "missing").when(F.coalesce(whole, F.lit(False)), "collected").otherwise("malformed")
    return j.select(ids["id"], status.alias("status"), *[F.col(f"r.{n}").alias(f"found_{n}") for n in names])


def report_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, model, mode, k, judge, qtype, accuracy) of all atm_*_summary.json below ``root``, dimensions from the path.

    The path ends in model/mode/niah<k>/judge/file; others are left out.
    """
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "atm_*_summary.json").text(root, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    k = F.regexp_extract(path_part(F.col("path"), 3), r"^niah(\d+)$", 1)
    dims = df.select("path", path_part(F.col("path"), 5).alias("model"), path_part(F.col("path"), 4).alias("mode"), k.try_cast("int").alias("k"), path_part(F.col("path"), 2).alias("judge"), "v").where("k is not null")
    by = F.from_json(F.to_json(F.try_variant_get("v", "$.by_qtype", "variant")), "map<string,string>")
    every = F.map_concat(F.coalesce(F.transform_values(by, lambda _k, s: F.from_json(s, "accuracy double")["accuracy"]), F.create_map().cast("map<string,double>")), F.create_map(F.lit("all"), F.try_variant_get("v", "$.accuracy", "double")))
    return dims.select("path", "model", "mode", "k", "judge", F.explode(every).alias("qtype", "accuracy")).where("accuracy is not null")


def vector_index(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The items and vectors stored under a cache key, or None."""
    at = f"{path}/cache_key={key}"
    return spark.read.parquet(at) if exists(spark, f"{at}/_SUCCESS") else None


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Ids of items that a progress log marks done."""
    return json_lines(spark, path, PROGRESS, strict=False).where("status = 'success'").select("item_id").distinct()


def stored_ids(meta: DataFrame) -> DataFrame:
    """Item ids of a store's metadata rows (id, key, string_value): those with both an item id and data, neither empty."""
    a = meta.where("key = 'item_id' and string_value <> ''").select("id", F.col("string_value").alias("item_id"))
    b = meta.where("key = 'data' and string_value <> ''").select("id")
    return a.join(b, "id", "left_semi").select("item_id").distinct()


def media_files_of(items: DataFrame, path: str, listing: DataFrame, order: list[str]) -> DataFrame:
    """``items`` with ``resolved``: the listed file at their path, else the one of their stem whose suffix comes first in ``order``."""
    ranked = F.array_position(F.array(*[F.lit(s) for s in order]), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    by_stem = listing.select(stem(F.col("path")).alias("_s"), F.col("path").alias("_p"), ranked.alias("_r")).where("_r > 0").groupBy("_s").agg(F.min(F.struct("_r", "_p")).alias("_m"))
    same = listing.select(F.col("path").alias("_exact")).distinct()
    j = items.join(same, items[path] == F.col("_exact"), "left").join(by_stem, stem(items[path]) == F.col("_s"), "left")
    return j.select(*[items[c] for c in items.columns], F.coalesce("_exact", F.col("_m._p")).alias("resolved"))
