"""Timestamps of many formats, precisions and zones, normalised to UTC microseconds."""

from __future__ import annotations

import hashlib
import inspect
import re
import sys
import time
import unicodedata
import uuid
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from keepsake.runtime import cut, hadoop_path, shared_dir

_EPOCH = datetime(1970, 1, 1)

# Month names (first three letters suffice where unambiguous) in en, de, fr, es, it, nl, pt.
MONTHS = {
    1: "january januar janvier enero gennaio januari janeiro jan janv ene jänner",
    2: "february februar février febrero febbraio februari fevereiro feb févr fevr feber",
    3: "march märz mars marzo maart março mar mär mrz maerz",
    4: "april avril abril aprile apr avr abr",
    5: "may mai mayo maggio mei maio",
    6: "june juni juin junio giugno junho jun",
    7: "july juli juillet julio luglio julho jul juil",
    8: "august août agosto augustus aug aou ago",
    9: "september septembre septiembre settembre setembro sep sept set",
    10: "october oktober octobre octubre ottobre outubro oct okt out ott",
    11: "november novembre noviembre novembro nov",
    12: "december dezember décembre diciembre dicembre dezembro dec dez déc dic",
}

# Hours east of UTC of common zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5, "NPT": 5.75, "JST": 9, "KST": 9, "HKT": 8, "SGT": 8, "AWST": 8, "ACST": 9.5,
    "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13, "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


_MONTH = {_fold(w): m for m, names in MONTHS.items() for w in names.split()}
_ZONE = r"(?P<off>[+-]\d{1,2}:?\d{2}(?::?\d{2})?|[+-]\d{2}|Z)?\s*(?P<name>\[[^\]]*\]|\([^)]*\)|[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+|[A-Za-z]{1,5})?"
_TIME = r"(?P<h>\d{1,2})(?::|h|\.)(?P<mi>\d{2})(?:(?::|m|\.)(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*s?(?:\s*(?P<ap>[AaPp])\.?[Mm](?![A-Za-z])\.?)?(?:\s*(?:Uhr|uhr|hrs|o'clock))?"
_LINK = r"(?:\s*[T,]\s*|\s+(?:à|a las|at|um|alle|om)\s+|\s*,?\s+)"
_WORD = r"[^\W\d_]+"

# The shapes of a calendar date, tried in this order.
DATES = [
    r"(?P<y>\d{4})(?P<sep>[-/:.])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
    r"(?P<y>\d{4})年(?P<mo>\d{1,2})月(?P<d>\d{1,2})日",
    r"(?P<a>\d{1,2})(?P<sep>[-/:.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})",
    rf"(?:{_WORD}\.?,?\s+)?(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er|º)?[\s-]+(?:de\s+|of\s+)?(?P<mon>{_WORD})\.?,?[\s-]+(?:de\s+|del\s+)?(?P<y>\d{{4}})",
    rf"(?:{_WORD}\.?,?\s+)?(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})",
]
_FULL = [re.compile(rf"{d}(?:{_LINK}{_TIME})?\s*{_ZONE}") for d in DATES]
_CTIME = re.compile(rf"{_WORD}\.?,?\s+(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}})\s+{_TIME}\s*{_ZONE}\s+(?P<y>\d{{4}})")
_COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})(?:[T_ -]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,]?(?P<f>\d+))?)?)?\s*{_ZONE}")
_NUMBER = re.compile(r"[+-]?\d+(?:[.,]\d+)?")
_UNITS = (1_000_000, 1_000, 1)  # microseconds in a second and a millisecond; nanoseconds are divided


def _calendar(y: int, mo: int, d: int, h: int, mi: int, s: int, us: int) -> datetime | None:
    """The local time, or None where it names no valid day or time; 24:00 and a leap second roll over."""
    extra = timedelta()
    if h == 24 and mi == 0 and s == 0:
        h, extra = 0, timedelta(days=1)
    if s == 60:
        s, extra = 59, timedelta(seconds=1)
    try:
        return datetime(y, mo, d, h, mi, s, us) + extra
    except (ValueError, OverflowError):
        return None


def _micros(t: datetime) -> int:
    return (t - _EPOCH) // timedelta(microseconds=1)


def _local(t: datetime, zone: str) -> int | None:
    """UTC of a local time: the first of two, and moved forward by the gap where there is none."""
    try:
        z = ZoneInfo(zone)
    except Exception:
        return None
    # With fold=0 a time in a gap takes the offset before it, which moves it forward by the gap.
    return _micros(t - t.replace(tzinfo=z, fold=0).utcoffset())


def _offset(text: str) -> timedelta | None:
    if text == "Z":
        return timedelta()
    digits = text[1:].replace(":", "").ljust(4, "0")
    if len(digits) == 3:
        digits = "0" + digits
    h, m = int(digits[:2]), int(digits[2:4])
    if h > 18 or m > 59:
        return None
    return (timedelta(hours=h, minutes=m)) * (-1 if text[0] == "-" else 1)


#: The years, first and last, to which plain numbers lead; the unit is chosen so that they do.
EPOCH_YEARS = (1990, 2100)


def _number(text: str, years: tuple[int, int]) -> int | None:
    """Seconds, milliseconds, microseconds or nanoseconds since 1970, whichever leads to ``years``."""
    whole, _, part = text.replace(",", ".").partition(".")
    low, high = _micros(datetime(years[0], 1, 1)), _micros(datetime(years[1] + 1, 1, 1))
    for unit in _UNITS:
        us = int(whole) * unit + (int(part.ljust(6, "0")[:6]) * unit // 1_000_000 if part else 0)
        if low <= us < high:
            return us
    us = int(whole) // 1000
    return us if low <= us < high else None


def parse_timestamp(raw: str | None, zone: str | None = None, order: str | None = None, years: tuple[int, int] = EPOCH_YEARS) -> int | None:
    """Microseconds since 1970 UTC that ``raw`` denotes, or None where it denotes no instant.

    Outer blanks are ignored. A valid calendar day is required, a missing time
    or second is zero, digits after the microsecond are dropped. An offset in
    the value holds first, then a zone named in it, then ``zone``, else UTC.
    ``order`` (dmy, mdy or ymd) says which of two leading numbers is the day
    where both could be: dmy and none take day first, the others month first. Plain numbers that are no
    calendar date count from 1970, in the unit that leads to ``years``. Unknown zone names denote nothing.
    """
    if raw is None:
        return None
    text = " ".join(raw.split())
    if not text:
        return None
    m = _COMPACT.fullmatch(text)
    if m and _calendar(int(m["y"]), int(m["mo"]), int(m["d"]), 0, 0, 0, 0) and (not text.isdigit() or len(text) in (8, 12, 14)):
        if text.isdigit() and len(text) == 12 and (us := _number(text, years)) is not None:
            return us
        if text.isdigit() and not 1800 <= int(m["y"]) <= 2199:
            return _number(text, years)
    elif _NUMBER.fullmatch(text):
        return _number(text.lstrip("+"), years) if text[0] != "-" else None
    else:
        m = next((x for p in (*_FULL, _CTIME) if (x := p.fullmatch(text))), None)
    if m is None:
        return None
    g = m.groupdict()
    if g.get("mon"):
        month = _MONTH.get(_fold(g["mon"]))
        if month is None:
            return None
        day = int(g["d"])
    elif g.get("a"):
        a, b = int(g["a"]), int(g["b"])
        month_first = (order in ("mdy", "ymd") and a <= 12) or (a <= 12 < b)
        month, day = (a, b) if month_first else (b, a)
    else:
        month, day = int(g["mo"]), int(g["d"])
    hour = int(g.get("h") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
    frac = int((g.get("f") or "0").ljust(6, "0")[:6])
    local = _calendar(int(g["y"]), month, day, hour, int(g.get("mi") or 0), int(g.get("s") or 0), frac)
    if local is None:
        return None
    if g.get("off"):
        delta = _offset(g["off"])
        return None if delta is None else _micros(local - delta)
    if g.get("name"):
        name = g["name"].strip("[]() ")
        if name.upper() in ABBREVIATIONS:
            return _micros(local - timedelta(hours=ABBREVIATIONS[name.upper()]))
        return _local(local, name) if "/" in name else None
    return _local(local, zone) if zone else _micros(local)


def _parser(years: tuple[int, int]):
    @pandas_udf(LongType())
    def parse(raw: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
        return pd.Series([parse_timestamp(r, z, o, years) for r, z, o in zip(raw, zone, order)], dtype="Int64")

    return parse


_KEY = ("source", "raw", "zone", "day_order")
_PART = "source string, raw string, zone string, day_order string, utc_us bigint"
#: Parts of a dictionary beyond which they are merged, and the days for which merged ones stay for those who still read them.
MOST_PARTS, GRACE_DAYS = 16, 7


def rules_digest(years: tuple[int, int]) -> str:
    """Names the rules that a dictionary was made by; any change of this module changes it."""
    return hashlib.blake2b(f"{years}{inspect.getsource(sys.modules[__name__])}".encode(), digest_size=8).hexdigest()


#: A value is busy if more than one in so many rows has it; at most as many values are, so that they can be broadcast.
BUSY = 2_000


def dictionary(values: DataFrame, path: str | None = None, years: tuple[int, int] = EPOCH_YEARS) -> DataFrame:
    """(source, raw, zone, day_order, utc_us) of each distinct combination in ``values``, parsed once.

    The dictionary is a table in shared storage that only grows, in a folder
    named by the rules: combinations it has are not parsed again, new ones are
    added as one part with a success mark, so an interrupted addition leaves no
    trace. Two runs that add at the same time may both add a value; reading
    collapses that. Above MOST_PARTS parts are merged (``compact``).
    """
    return _looked_up(values, path, years)[0]


def _looked_up(values: DataFrame, path: str | None, years: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The dictionary of all ``values``, and that of the busy ones alone (at most BUSY rows)."""
    spark = values.sparkSession
    path = f"{path or f'{shared_dir(spark)}/timestamp-dictionary'}/{rules_digest(years)}"
    want = cut(values.where("raw is not null").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in _KEY]
    known = _known(spark, path)
    new = want.drop("n") if known is None else want.drop("n").join(known, same(want, known), "left_anti")
    new.withColumn("utc_us", _parser(years)("raw", "zone", "day_order")).write.parquet(f"{path}/part-{uuid.uuid4().hex}")
    if len(_parts(spark, path)) > MOST_PARTS:
        compact(spark, path)
    known = _known(spark, path)
    rows = want.agg(F.sum("n")).first()[0] or 0
    busy = F.broadcast(want.where(F.col("n") > rows / BUSY).select(*_KEY))
    one = lambda some: known.join(some, same(known, some), "left_semi").groupBy(*_KEY).agg(F.max("utc_us").alias("utc_us"))
    return one(want), one(busy)


def _parts(spark, path: str, old: bool = False) -> list[str]:
    """The parts of a dictionary that are whole and, unless ``old`` asks for those, not merged into another."""
    fs, root = hadoop_path(spark, path)
    if not fs.exists(root):
        return []
    found = [str(s.getPath().toString()) for s in fs.listStatus(root)]
    has = lambda p, mark: fs.exists(hadoop_path(spark, f"{p}/{mark}")[1])
    return sorted(p for p in found if has(p, "_SUCCESS") and has(p, "_MERGED") == old)


def _known(spark, path: str) -> DataFrame | None:
    parts = _parts(spark, path)
    return spark.read.schema(_PART).parquet(*parts) if parts else None


def compact(spark, path: str, grace_days: float = GRACE_DAYS) -> None:
    """Merges the parts of the dictionary folder ``path`` into one.

    Merged parts are marked, so nobody reads them any more, and deleted by a
    later call once ``grace_days`` are over.
    """
    for p in _parts(spark, path, old=True):
        fs, mark = hadoop_path(spark, f"{p}/_MERGED")
        if fs.getFileStatus(mark).getModificationTime() / 1000 < time.time() - grace_days * 86_400:
            fs.delete(mark.getParent(), True)
    parts = _parts(spark, path)
    if len(parts) > 1:
        whole = spark.read.schema(_PART).parquet(*parts).groupBy(*_KEY).agg(F.max("utc_us").alias("utc_us"))
        whole.write.parquet(f"{path}/part-{uuid.uuid4().hex}")
        for p in parts:
            fs, mark = hadoop_path(spark, f"{p}/_MERGED")
            fs.create(mark).close()


def normalise(
    df: DataFrame, raw: str, zone: Column, order: Column, out: str = "utc_us", source: Column | None = None, path: str | None = None, years: tuple[int, int] = EPOCH_YEARS
) -> DataFrame:
    """``df`` with the column ``out``: the instant of column ``raw`` or null.

    ``zone`` and ``order`` are the row's default zone and day-month order,
    ``source`` says where it comes from. Distinct combinations are parsed once
    (``dictionary``) and joined back, so repeated values cost nothing. Busy
    values are looked up in a broadcast of these alone; their rows and those
    without a value are then spread over all tasks. Every row stays, null and
    unreadable values with null. A column of the name ``out`` is replaced.
    """
    keep = [c for c in df.columns if c != out]
    source = F.lit(None) if source is None else source
    own = {"source": source.cast("string"), "raw": F.col(raw), "zone": zone.cast("string"), "day_order": order.cast("string")}
    every, busy = _looked_up(df.select(*[c.alias(k) for k, c in own.items()]), path, years)
    named = lambda d, p: d.select(*[F.col(k).alias(f"{p}{k}") for k in _KEY], F.struct("utc_us").alias(f"{p}us"))
    same = lambda p: [F.col(f"__ts_{k}").eqNullSafe(F.col(f"{p}{k}")) for k in _KEY]
    work = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(f"__ts_{k}") for k, c in own.items()]).join(F.broadcast(named(busy, "__busy_")), same("__busy_"), "left")
    place = F.when(F.col("__ts_raw").isNull() | F.col("__busy_us").isNotNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0))
    d = named(every, "__all_").withColumn("__all_place", F.lit(0).cast("bigint"))
    joined = work.withColumn("__ts_place", place).join(d, [*same("__all_"), F.col("__ts_place") == F.col("__all_place")], "left")
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("__busy_us", "__all_us")["utc_us"].alias(out))
