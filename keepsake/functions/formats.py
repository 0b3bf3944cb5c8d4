"""Small scalar formats as column expressions: places, durations, senders, mail dates and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.answers import squeeze


def gps_pair(c: Column) -> Column:
    """[latitude, longitude] from a text like +52.2-000.1/; null where there is none or it is out of bounds."""
    p = r"([+-]?\d+\.?\d*)\s*([+-]\d+\.?\d*)"
    lat, lon = F.regexp_extract(c, p, 1).try_cast("double"), F.regexp_extract(c, p, 2).try_cast("double")
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.array(lat, lon))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    v = d + m / 60.0 + s / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def duration_compact(seconds: Column) -> Column:
    """1h05m, 3m07s or 9s of whole seconds; negative ones count as 0."""
    s = F.greatest(F.lit(0), F.floor(seconds).cast("bigint"))
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), _two(m), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), _two(s % 60), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def duration_words(seconds: Column) -> Column:
    """9.5s, 3m 7s or 1h 5m."""
    whole = lambda c: F.floor(c).cast("bigint").cast("string")
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m "), whole(seconds % 60), F.lit("s")))
        .otherwise(F.concat(whole(seconds / 3600), F.lit("h "), whole((seconds % 3600) / 60), F.lit("m")))
    )


def eta(seconds: Column) -> Column:
    """Remaining time in the largest fitting unit with one decimal; unknown where it is not positive."""
    one = lambda c, u: F.concat(F.format_string("%.1f", c), F.lit(u))
    return (
        F.when(seconds <= 0, "unknown").when(seconds < 60, F.concat(F.format_string("%.0f", seconds), F.lit("s"))).when(seconds < 3600, one(seconds / 60, "m"))
        .when(seconds < 86400, one(seconds / 3600, "h")).otherwise(one(seconds / 86400, "d"))
    )


def mail_address(c: Column) -> Column:
    """What stands in angle brackets, else the first word with an at sign, else the text; null gives an empty text."""
    bracket = F.regexp_extract(c, "<([^>]+)>", 1)
    word = F.regexp_extract(c, r"([^\s()]+@[^\s()]+)", 1)
    return F.coalesce(F.when(bracket != "", F.trim(bracket)).when(word != "", F.trim(word)).otherwise(F.trim(c)), F.lit(""))


def sender_name(c: Column) -> Column:
    """The name before or in brackets, else the local part in title case, else the text; null gives an empty text."""
    head = F.trim(F.split(c, "<")[0])
    paren = F.trim(F.regexp_extract(c, r"\(([^)]+)\)", 1))
    local = F.initcap(F.regexp_replace(F.split(c, "@")[0], "[._]", " "))
    return F.coalesce(
        F.when(c.contains("<") & c.contains(">") & (head != ""), F.btrim(head, F.lit("\"'"))).when(paren != "", paren).when(c.contains("@"), local).otherwise(F.trim(c)), F.lit("")
    )


def mail_date(c: Column) -> Column:
    """A timestamp without zone from the usual mail formats; an offset is cut off, a weekday ignored; null where none fits."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3}, ", "")
    cut = F.regexp_replace(t, r"\s*[+-]\d{4}.*$", "")
    formats = ("M/d/yyyy, h:mm a", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for x in (t, cut) for f in formats])


def mail_headers(c: Column) -> Column:
    """map of lower-case header names to values, continuation lines joined, up to the first blank line; the last of a name counts."""
    head = F.regexp_replace(F.split(F.regexp_replace(c, "\r\n", "\n"), r"\n[ \t]*\n", 2)[0], r"\n[ \t]+", " ")
    lines = F.filter(F.split(head, "\n"), lambda s: s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(F.lower(F.trim(F.split(s, ":", 2)[0])).alias("k"), F.trim(F.split(s, ":", 2)[1]).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def mail_body(c: Column) -> Column:
    """What follows the first blank line, in single blanks; empty if there is none."""
    return squeeze(F.coalesce(F.get(F.split(F.regexp_replace(c, "\r\n", "\n"), r"\n[ \t]*\n", 2), 1), F.lit("")))


def attachments(c: Column) -> Column:
    """array<string> of what follows the words attachment, attached and file in a text, if longer than three characters."""
    got = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"(?i)attachment[s]?[:\s]*([^\n]+)", r"(?i)attached[:\s]*([^\n]+)", r"(?i)file[s]?[:\s]*([^\n]+)")])
    return F.filter(F.transform(got, lambda s: F.trim(s)), lambda s: F.length(s) > 3)


def tag_list(c: Column, most: int = 12) -> Column:
    """The first tags of a comma list, trimmed, in lower case, empty ones left out."""
    return F.slice(F.filter(F.transform(F.split(c, ","), lambda s: F.lower(F.trim(s))), lambda s: s != ""), 1, most)


def tag_set(c: Column) -> Column:
    """Sorted distinct tags of more than one character of a comma list."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda s: F.lower(squeeze(s))), lambda s: F.length(s) > 1)))


def entity_lines(c: Column) -> Column:
    """array<struct(entity, type)> of the lines name: type."""
    lines = F.filter(F.split(c, "\n"), lambda s: s.rlike(r"[^:\s][^:]*:\s*\S"))
    return F.transform(lines, lambda s: F.struct(F.trim(F.regexp_replace(F.split(s, ":", 2)[0], r"^[\s*-]+", "")).alias("entity"), F.trim(F.split(s, ":", 2)[1]).alias("type")))


def first_entities(c: Column) -> Column:
    """Entities without a name dropped, the first of each lower-case name and type kept."""
    named = F.filter(c, lambda e: F.trim(F.coalesce(e["entity"], F.lit(""))) != "")
    same = lambda a, b: (F.lower(a["entity"]) == F.lower(b["entity"])) & a["type"].eqNullSafe(b["type"])
    return F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda b: same(e, b)))


def bracket_id(c: Column) -> Column:
    """The content of the first square brackets; null where empty or absent."""
    v = F.trim(F.regexp_extract(c, r"\[(.*?)\]", 1))
    return F.when(v != "", v)


def source_ids(c: Column) -> Column:
    """The ids of all [SOURCE_ID: a, b] lists in order without repeats, else of the first square brackets."""
    lists = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\[SOURCE_ID:\s*([^\]]+)\]"), F.lit(1)), lambda s: F.split(s, "[,;]")))
    ids = F.array_distinct(F.filter(F.transform(lists, lambda s: F.trim(s)), lambda s: s != ""))
    one = bracket_id(c)
    return F.when(F.size(ids) > 0, ids).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def id_line(c: Column) -> Column:
    v = F.trim(F.regexp_extract(c, r"(?m)^ID:(.*)$", 1))
    return F.when(v != "", v)


def bare_evidence_id(c: Column) -> Column:
    return F.regexp_replace(c, "^(Image_|Video_|Email_)", "")


def clean_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "\\x00", ""))


def day_key(c: Column) -> Column:
    """yyyy-MM-dd of a timestamp text, unknown for null and empty ones; null where it can't be read."""
    t = F.regexp_replace(F.trim(c), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(F.date_format(F.substring(t, 1, 19).try_cast("timestamp"), "yyyy-MM-dd"))


def percent(c: Column) -> Column:
    return F.format_string("%.1f", c * 100)


def time_text(time: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(time, pattern)
