"""The item corpus: identifiers, rendered texts, passages and the union of mails, images and videos."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.runtime import cut

# File suffixes by kind.
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".bmp", ".gif", ".tiff")


@dataclass(frozen=True)
class MediaText:
    """Lines of a rendered image or video."""

    id: bool = True
    type: bool = True
    timestamp: bool = True
    location: bool = True
    short_caption: bool = True
    caption: bool = True
    ocr: bool = True
    tags: bool = True

    @staticmethod
    def minimal() -> MediaText:
        return MediaText(type=False, short_caption=False, caption=False, ocr=False, tags=False)


@dataclass(frozen=True)
class MailText:
    """Lines of a rendered mail."""

    id: bool = True
    timestamp: bool = True
    summary: bool = True
    detail: bool = True

    @staticmethod
    def minimal() -> MailText:
        return MailText(summary=False, detail=False)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_nonblank(*cols: Column, default: str = "") -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(default))


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$") & ~name.rlike(r"^\.[^.]*$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def item_of_uri(source: Column, scheme: str) -> Column:
    """The item that a source names: what follows the scheme, else the stem of its path."""
    return F.when(source.startswith(scheme), F.substring(source, len(scheme) + 1, 1 << 30)).otherwise(stem(source))


def evidence_kind(evidence_id: Column) -> Column:
    """email by its beginning, else video or image by suffix, else unknown."""
    low = F.lower(evidence_id)
    ends = lambda suffixes: low.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return F.when(low.startswith("email"), "email").when(ends(VIDEO_SUFFIXES), "video").when(ends(IMAGE_SUFFIXES), "image").otherwise("unknown")


def evidence_ids(ids: Column) -> Column:
    """Ids without null and empty ones and without repeats, in order; null gives an empty array."""
    return F.coalesce(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def media_text(item_id: Column, kind: Column, row: dict[str, Column], show: MediaText = MediaText()) -> Column:
    """Labelled lines of a media record; null fields are empty, tags are joined by comma and blank."""
    lines = [
        (show.id, "ID: ", item_id),
        (show.type, "Type: ", kind),
        (show.timestamp, "Timestamp: ", row["timestamp"]),
        (show.location, "Location: ", row["location_name"]),
        (show.short_caption, "Short Caption: ", row["short_caption"]),
        (show.caption, "Caption: ", row["caption"]),
        (show.ocr, "OCR: ", row["ocr_text"]),
        (show.tags, "Tags: ", F.array_join(row["tags"], ", ")),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(label), blank(c)) for on, label, c in lines if on])


def mail_text(row: dict[str, Column], show: MailText = MailText()) -> Column:
    lines = [(show.id, "ID: ", row["id"]), (show.timestamp, "Timestamp: ", row["timestamp"]), (show.summary, "Summary: ", row["short_summary"]), (show.detail, "Detail: ", row["detail"])]
    return F.concat_ws("\n", *[F.concat(F.lit(label), blank(c)) for on, label, c in lines if on])


def mail_subject(detail: Column) -> Column:
    """The rest of the first line that begins with Subject:, or empty."""
    return F.coalesce(F.trim(F.regexp_extract(detail, r"(?m)^Subject:\s*(.+)$", 1)), F.lit(""))


def batch_evidence(item_id: Column, kind: Column, row: dict[str, Column], fields: tuple[str, ...]) -> Column:
    """Labelled lines of a record as evidence; a null field reads None, other than in ``media_text``."""
    none = lambda c: F.coalesce(c, F.lit("None"))
    lines = [("type", "Type: ", kind), ("timestamp", "Timestamp: ", row["timestamp"]), ("location", "Location: ", row["location_name"]), ("short_caption", "Short Caption: ", row["short_caption"]), ("caption", "Caption: ", row["caption"]), ("ocr", "OCR: ", row["ocr_text"]), ("tags", "Tags: ", F.array_join(row["tags"], ", "))]
    out = [F.concat(F.lit("ID: "), item_id)] + [F.concat(F.lit(label), none(c)) for f, label, c in lines if f in fields]
    return F.concat(F.concat_ws("\n", *out), F.lit("\n"))


def mail_evidence(row: dict[str, Column]) -> Column:
    none = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat(F.lit("ID: "), row["id"], F.lit("\nTimestamp: "), none(row["timestamp"]), F.lit("\nSummary: "), none(row["short_summary"]), F.lit("\nDetail: "), none(row["detail"]), F.lit("\n"))


def numbered(chunks: Column, label: str = "Evidence") -> Column:
    """Chunks as blocks ``label i:`` in order; null and empty arrays give an empty text."""
    return blank(F.array_join(F.transform(chunks, lambda x, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(":\n"), blank(x))), "\n"))


def mail_passage(row: dict[str, Column], detail: bool = True) -> Column:
    """Header of id, time and place, then summary and detail where they are not empty."""
    head = F.concat_ws(" | ", row["id"], F.coalesce(row["timestamp"], F.lit("Unknown")), first_nonblank(row["location"], default="Unknown"))
    return F.concat_ws("\n", head, F.when(row["short_summary"] != "", row["short_summary"]), F.when(row["detail"] != "", row["detail"]) if detail else F.lit(None))


def media_passage(item_id: Column, row: dict[str, Column], level: int, ocr: bool = True) -> Column:
    """Header and short caption; from level 1 the caption, from 2 the tags, from 3 (images) the text read."""
    head = F.concat_ws(" | ", item_id, first_nonblank(row["timestamp"], default="Unknown"), first_nonblank(row["location"], row["location_name"], default="Unknown"))
    full = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    lines = [head, F.when(row["short_caption"] != "", row["short_caption"])]
    if level >= 1:
        lines.append(full("Caption: ", row["caption"]))
    if level >= 2:
        lines.append(F.when(F.size(row["tags"]) > 0, F.concat(F.lit("Tags: "), F.array_join(row["tags"], ", "))))
    if level >= 3 and ocr:
        lines.append(full("OCR: ", row["ocr_text"]))
    return F.concat_ws("\n", *lines)


def build_items(mails: DataFrame | None, images: DataFrame | None, videos: DataFrame | None, media: MediaText = MediaText(), mail: MailText = MailText()) -> DataFrame:
    """(src, ord, item_id, modality, text, media_path, metadata): mails, then images, then videos, one row per record.

    Records without id or path are left out; repeated ids are kept. Each input
    carries its place in ``ord``. Place is location_name, else location; a mail's
    subject is its field, else its Subject line. Missing columns count as null.
    """

    def col(df: DataFrame, name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    def meta(**c: Column) -> Column:
        return F.create_map(*[x for k, v in c.items() for x in (F.lit(k), blank(v))])

    parts = []
    if mails is not None:
        row = {k: col(mails, k) for k in ("id", "timestamp", "short_summary", "detail", "subject", "sender", "location")}
        about = meta(source=F.lit("email"), timestamp=row["timestamp"], subject=first_nonblank(row["subject"], mail_subject(row["detail"])), sender=row["sender"], location=row["location"])
        parts.append(mails.where(F.col("id").isNotNull() & (F.col("id") != "")).select(F.lit(0).alias("src"), col(mails, "ord", "bigint").alias("ord"), F.col("id").alias("item_id"), F.lit("email").alias("modality"), mail_text(row, mail).alias("text"), F.lit(None).cast("string").alias("media_path"), about.alias("metadata")))
    for n, kind, df in ((1, "image", images), (2, "video", videos)):
        if df is None:
            continue
        path = f"{kind}_path"
        row = {k: col(df, k) for k in ("timestamp", "location_name", "location", "short_caption", "caption", "ocr_text")} | {"tags": col(df, "tags", "array<string>")}
        about = meta(source=F.lit(kind), batch_path=F.col(path), timestamp=row["timestamp"], location=first_nonblank(row["location_name"], row["location"]))
        item = stem(F.col(path))
        parts.append(df.where(F.col(path).isNotNull() & (F.col(path) != "")).select(F.lit(n).alias("src"), col(df, "ord", "bigint").alias("ord"), item.alias("item_id"), F.lit(kind).alias("modality"), media_text(item, F.lit(kind), row, media).alias("text"), F.col(path).alias("media_path"), about.alias("metadata")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sanitised(questions: DataFrame, keep: tuple[str, ...] = ("id", "question")) -> DataFrame:
    """Questions without anything that tells their answers."""
    return questions.select(*keep)


def memory_payloads(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, item_id, modality, text, metadata) of items with text; the metadata name item and modality unless they do so themselves."""
    given = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    own = F.create_map(F.lit("item_id"), F.col("item_id"), F.lit("modality"), F.col("modality"))
    whole = F.map_concat(F.map_filter(own, lambda k, _v: ~F.map_contains_key(given, k)), given)
    return items.where(F.col("text") != "").select(*keep, "item_id", "modality", "text", whole.alias("metadata"))


def conversational_payloads(mails: DataFrame | None, images: DataFrame | None, videos: DataFrame | None) -> DataFrame:
    """(src, ord, item_id, modality, text, metadata) of records with a ``conversational_text``.

    They belong in order of the metadata's timestamp text, then src and ord
    (``dense_index`` numbers them so). Ids are a mail's id or a path's stem.
    """
    def one(df: DataFrame, n: int, kind: str) -> DataFrame:
        has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
        item = blank(F.col("id")) if kind == "email" else F.coalesce(stem(F.col(f"{kind}_path")), F.lit(""))
        about = {"item_id": item, "modality": F.lit(kind), "source": F.lit(kind), "timestamp": blank(has("timestamp"))}
        if kind != "email":
            about["location"] = first_nonblank(has("location_name"), has("location"))
        meta = F.create_map(*[x for k, v in about.items() for x in (F.lit(k), v)])
        return df.where(F.col("conversational_text") != "").select(F.lit(n).alias("src"), "ord", item.alias("item_id"), F.lit(kind).alias("modality"), F.col("conversational_text").alias("text"), meta.alias("metadata"))

    parts = [one(df, n, kind) for n, kind, df in ((0, "email", mails), (1, "image", images), (2, "video", videos)) if df is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def numbered_contexts(contexts: Column) -> Column:
    """Contexts (array of text, item_ids) as blocks under ``Memory i``, with their sources; blank ones are left out but counted."""
    # The labels of the blocks.

    def block(c: Column, i: Column) -> Column:
        ids = F.array_join(c["item_ids"], ", ")
        some = F.size(c["item_ids"]) > 0
        head = F.concat(F.lit("Memory "), (i + 1).cast("string"), F.when(some, F.concat(F.lit(" (Source ID: "), ids, F.lit(")"))).otherwise(""), F.lit(":"))
        return F.when(c["text"] != "", F.concat_ws("\n", head, F.when(some, F.concat(F.lit("Source ID: "), ids)), c["text"]))

    return F.array_join(F.transform(contexts, block), "\n\n")


def neighbour_lines(notes: Column) -> Column:
    """One line for each note of an array of index, timestamp, content, context, keywords and tags; null notes are left out."""
    # The labels of a line.
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    listed = lambda c: F.concat(F.lit("["), blank(F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")), F.lit("]"))
    line = lambda n: F.concat(
        F.lit("memory index:"), none(n["index"]), F.lit("\t talk start time:"), none(n["timestamp"]), F.lit("\t memory content: "), none(n["content"]), F.lit("\t memory context: "), none(n["context"]),
        F.lit("\t memory keywords: "), listed(n["keywords"]), F.lit("\t memory tags: "), listed(n["tags"]),
    )
    return F.array_join(F.transform(F.filter(notes, lambda n: n.isNotNull()), line), "\n")


# The fields of batch evidence and other names for them.
EVIDENCE_FIELDS = ("type", "timestamp", "location", "short_caption", "caption", "ocr", "tags")
FIELD_ALIASES = {"time": "timestamp", "date": "timestamp", "place": "location", "location_name": "location", "short": "short_caption", "ocr_text": "ocr", "text": "ocr", "tag": "tags"}


def evidence_fields(said: str) -> tuple[str, ...]:
    """The fields that a setting names: all or default, none or id_only, or a list by comma or blank; unknown names raise."""
    words = said.strip().lower().replace(",", " ").split()
    if words in (["all"], ["default"]):
        return EVIDENCE_FIELDS
    if words in (["none"], ["id_only"], ["id-only"], []):
        return ()
    fields = tuple(FIELD_ALIASES.get(w.replace("-", "_"), w.replace("-", "_")) for w in words)
    if unknown := sorted(set(fields) - set(EVIDENCE_FIELDS)):
        raise ValueError(f"unknown fields {', '.join(unknown)}; known: {', '.join(EVIDENCE_FIELDS)}")
    return fields


def dense_index(df: DataFrame, order: list[Column | str], name: str = "idx", start: int = 0) -> DataFrame:
    """``df`` numbered without gaps in ``order``, without gathering it in one task.

    Range-partitioned and sorted once into shared storage; a row's number is its
    place in its partition plus the rows of earlier partitions, of which there
    is one count per partition. Order rows fully, else ties fall as they may.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mono", F.monotonically_increasing_id()))
    pid, row = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], start
    for r in placed.groupBy(pid.alias("pid")).count().orderBy("pid").collect():  # one row per partition
        before.append((int(r["pid"]), total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "pid bigint, offset bigint")
    return placed.withColumn("_pid", pid.cast("bigint")).join(F.broadcast(offsets), F.col("_pid") == F.col("pid")).withColumn(name, F.col("offset") + row).drop("_mono", "_pid", "pid", "offset")


def grouped_index(df: DataFrame, group: list[str], order: list[Column | str], name: str = "idx", start: int = 1) -> DataFrame:
    """``df`` numbered without gaps in ``order`` within each group, without gathering a group in one task.

    Rows are range-partitioned by group and order, so a large group lies in
    several partitions; rows are numbered within a partition's part of a group,
    and what lies in earlier partitions is added. Only the first group of a
    partition can have such rows, so the counts that are collected are at most
    two for each partition. Order rows fully, else ties fall as they may.
    """
    mono, pid, n = (free_name(df, x) for x in ("_mono", "_pid", "_n"))
    keys = [F.col(c) for c in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(mono, F.monotonically_increasing_id())
    placed = cut(placed.withColumn(pid, F.shiftright(mono, 33).cast("bigint")))
    own = [f"g{i}" for i in range(len(group))]
    parts = cut(placed.groupBy(*[F.col(c).alias(g) for c, g in zip(group, own)], F.col(pid).alias("p")).agg(F.count(F.lit(1)).alias("rows")))
    many = parts.groupBy(*[F.col(g).alias(f"m{g}") for g in own]).agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    split = parts.join(many, [parts[g].eqNullSafe(F.col(f"m{g}")) for g in own], "left_semi").orderBy("p").collect()  # at most two for each partition
    before, seen = [], {}
    for r in split:
        g = tuple(r[x] for x in own)
        if g in seen:
            before.append((*g, r["p"], seen[g]))
        seen[g] = seen.get(g, 0) + r["rows"]
    kinds = "".join(f"`off {g}` {df.schema[c].dataType.simpleString()}, " for g, c in zip(own, group))
    offsets = df.sparkSession.createDataFrame(before, f"{kinds}`off p` bigint, `off rows` bigint")
    local = F.row_number().over(Window.partitionBy(pid, *group).orderBy(mono)) + (start - 1)
    same = [placed[c].eqNullSafe(F.col(f"off {g}")) for g, c in zip(own, group)]
    out = placed.withColumn(n, local).join(F.broadcast(offsets), [F.col(pid) == F.col("off p"), *same], "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(n) + F.coalesce("off rows", F.lit(0))).cast("bigint").alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it no column of ``df``."""
    while name in df.columns:
        name = "_" + name
    return name


def evidence_bitmap(ids: Column) -> Column:
    """struct(mail, media): whether ids of mails, and of media by their time, are among an array; null and empty ones have none."""
    some = lambda f: F.coalesce(F.exists(ids, lambda x: F.coalesce(f(x), F.lit(False))), F.lit(False))
    return F.struct(some(lambda x: F.lower(x).startswith("email")).alias("mail"), some(lambda x: x.rlike("^[0-9]{8}_[0-9]{6}")).alias("media"))


def dialogue(item_id: Column, modality: Column, text: Column, metadata: Column) -> Column:
    """struct(user, agent): an item as one exchange; missing values read Unknown, a missing subject No subject."""

    def m(key: str, default: str = "Unknown") -> Column:
        v = F.try_element_at(metadata, F.lit(key))
        return F.coalesce(F.when(F.trim(v) != "", v), F.lit(default))

    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    user = (
        F.when(modality == "email", say("[", item_id, "] Mail from ", m("sender"), " at ", m("timestamp"), " in ", m("location"), ", subject: ", m("subject", "No subject"), "\n", text))
        .when(modality == "image", say("[", item_id, "] Photo in ", m("location"), " at ", m("timestamp"), "\n", text))
        .when(modality == "video", say("[", item_id, "] Video in ", m("location"), " at ", m("timestamp"), "\n", text))
        .otherwise(say("[", item_id, "]\n", text))
    )
    agent = F.when(modality.isin("email", "image", "video"), say("I will remember this ", modality, ".")).otherwise("I will remember this.")
    empty = text.isNull() | (text == "")
    return F.struct(F.when(empty, "").otherwise(user).alias("user"), F.when(empty, "").otherwise(agent).alias("agent"))


def note_document(content: Column, context: Column, keywords: Column, tags: Column) -> Column:
    return F.concat(F.lit("content:"), blank(content), F.lit(" context:"), blank(context), F.lit(" keywords:"), blank(F.array_join(keywords, ", ")), F.lit(" tags:"), blank(F.array_join(tags, ", ")))


def missing_metadata(items: DataFrame, fields: tuple[str, ...] = ("timestamp", "location", "sender", "subject")) -> DataFrame:
    """Per modality, the items in all and those without each metadata field (absent, null or blank)."""
    gone = lambda k: F.trim(F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))) == ""
    return items.groupBy("modality").agg(F.count(F.lit(1)).alias("items"), *[F.count_if(gone(k)).alias(f"no_{k}") for k in fields])


def evidence_texts(asked: DataFrame, key: str, ids: str, sources: list[DataFrame]) -> DataFrame:
    """(key, texts): the texts of each row's ids in order, from the first of ``sources`` (id, text) that has the id.

    Misses are left out; null and empty id arrays give an empty array. Sources
    must be unique by id (see ``lookups.first_by_key``).
    """
    rows = asked.select(F.col(key).alias("_k"), F.posexplode(evidence_ids(F.col(ids))).alias("_pos", "_id"))
    texts = []
    for n, s in enumerate(sources):
        rows = rows.join(s.select(F.col("id").alias("_id"), F.col("text").alias(f"_t{n}")), "_id", "left")
        texts.append(F.col(f"_t{n}"))
    found = rows.withColumn("_text", F.coalesce(*texts)).where("_text is not null")
    found = found.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_pos", "_text"))).alias("_c")).select("_k", F.transform("_c", lambda s: s["_text"]).alias("texts"))
    return asked.select(key).join(found, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))
