"""From files to records: photos, videos and mails through headers, caches of places and an injected model, in resumable runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import formats, jsontext
from keepsake.operators.lookups import pending
from keepsake.operators.memory import Maker, make_rows
from keepsake.runtime import cut, spread
from keepsake.sources import media, readers, sinks

#: What a model tells of a picture or of the frames of a video.
SEEN = "city string, ocr_text string, caption string, short_caption string, tags string, entities string, safety string"
#: What a model tells of a mail.
READ = "short_summary string, detail string, classification string"


def _described(df: DataFrame, path: str, look: Maker, schema: str) -> DataFrame:
    """``df`` with what ``look`` makes of its rows, status and error; a row that fails spoils no other.

    Rows are dealt out to all cores, as what ``look`` costs does not show in their size.
    """
    made = make_rows(spread(df), look, schema, path)
    return df.join(made.withColumnRenamed(path, "_p"), F.col(path) == F.col("_p")).drop("_p")


def _finished(df: DataFrame, model: str) -> DataFrame:
    tags = formats.tag_list(F.col("tags"))
    entities = formats.first_entities(formats.entity_lines(F.coalesce("entities", F.lit(""))))
    return df.withColumn("tags", F.coalesce(tags, F.array().cast("array<string>"))).withColumn("entities", entities).withColumn("ocr_text", F.nullif(formats.clean_text(F.col("ocr_text")), F.lit(""))).withColumn("model_used", F.lit(model))


def photo_records(files: DataFrame, look: Maker, places: DataFrame | None = None, model: str = "") -> DataFrame:
    """One record per photo: time, place and camera from its header, the place's name from a cache, the rest from ``look``.

    ``files``: path, content, length, modificationTime; ``places``: key (a path),
    place. ``look`` gets batches (path, content, timestamp, location_name) and
    returns the columns of SEEN. A photo that it fails on has status failed and
    its header still.
    """
    f = files.select(F.col("path").alias("image_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_modified"), "content", media.exif(F.col("content")).alias("_e"))
    f = f.select("image_path", "file_size", "file_modified", "content", "_e.timestamp", "_e.location", "_e.device", "_e.camera_settings")
    f = media.places(f, "image_path", places) if places is not None else f.withColumn("place", F.lit(None).cast("string"))
    f = cut(f.withColumn("location_name", F.when(F.col("location").isNotNull(), F.col("place"))).drop("place"))
    return _finished(_described(f, "image_path", look, SEEN), model).drop("content")


def video_records(files: DataFrame, prober: Callable[[str], str], look: Maker, places: DataFrame | None = None, frames: int = 4, model: str = "") -> DataFrame:
    """One record per video: time, place, length and form from a prober's report, the rest from ``look`` and the frame times.

    ``files``: path, length, modificationTime. ``look`` gets batches (path,
    timestamp, location_name, duration, frame_times) and returns the columns of SEEN.
    """
    from keepsake.operators.ranking import frame_times

    f = media.probe(files.select(F.col("path").alias("video_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_modified")), "video_path", prober)
    f = f.select("video_path", "file_size", "file_modified", media.video_fields(F.col("report")).alias("v")).select("video_path", "file_size", "file_modified", "v.*")
    f = media.places(f, "video_path", places) if places is not None else f.withColumn("place", F.lit(None).cast("string"))
    f = f.withColumn("location_name", F.when(F.col("location").isNotNull(), F.col("place"))).drop("place")
    f = cut(f.withColumn("frame_times", frame_times(F.col("duration"), frames)))
    return _finished(_described(f, "video_path", look, SEEN), model)


def mail_records(mails: DataFrame, read: Maker, keep_text: bool = False) -> DataFrame:
    """One record per mail: sender, recipient, subject and date from its headers, the rest from ``read``.

    ``mails``: path, kind (eml or html), text. ``read`` gets batches (path,
    sender, subject, date, body) and returns the columns of READ. What headers
    tell stays, whatever the model makes of the mail.
    """
    eml = F.col("kind") == "eml"
    t = mails.where("text is not null").select("path", "kind", "text")
    a = t.where(eml).withColumn("h", formats.mail_headers(F.col("text"))).select("path", F.col("h")["from"].alias("_s"), F.col("h")["to"].alias("recipient"), F.col("h")["subject"].alias("subject"), F.col("h")["date"].alias("_d"), formats.mail_body(F.col("text")).alias("body"))
    b = t.where(~eml).withColumn("h", jsontext.headers_of_html(F.col("text"))).select("path", F.col("h")["sender"].alias("_s"), F.col("h")["recipient"].alias("recipient"), F.col("h")["subject"].alias("subject"), F.col("h")["date"].alias("_d"), jsontext.text_of_html(F.col("text")).alias("body"))
    both = a.unionByName(b)
    f = both.select("path", formats.sender_name(F.col("_s")).alias("sender"), formats.mail_address(F.col("_s")).alias("address"), "recipient", "subject", formats.mail_date(F.col("_d")).alias("timestamp"), "body", formats.attachments(F.col("body")).alias("attachments"))
    out = _described(cut(f), "path", read, READ)
    return out if keep_text else out.drop("body")


def run_batch(files: DataFrame, out: str, log: str, make: Callable[[DataFrame], DataFrame], key: str = "path", record_key: str = "path") -> dict[str, int]:
    """Makes records of the files that the log does not have as done, adds them to the table ``out`` and the log; counts (todo, success, failed).

    Failed ones are logged as such and tried again by the next run; later
    records of a file replace earlier ones (``sinks.read_upserted``).
    """
    spark = files.sparkSession
    todo = pending(files, readers.progress(spark, log).withColumnRenamed("item_id", key), key)
    made = cut(make(todo))
    sinks.upsert(made, out, record_key)
    sinks.append_progress(made.select(F.col(record_key).alias("item_id"), "status", "error"), log)
    n = made.agg(F.count(F.lit(1)).alias("todo"), F.count_if(F.col("status") == "success").alias("success")).first()
    return {"todo": n["todo"], "success": n["success"], "failed": n["todo"] - n["success"]}
