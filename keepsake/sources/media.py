"""What image and video files say about themselves: EXIF of JPEG bytes, the report of a video prober."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.formats import gps_pair

# EXIF tags by number, and the size of each EXIF value type.
IMAGE_TAGS = {0x010F: "make", 0x0110: "model", 0x8769: "exif", 0x8825: "gps"}
EXIF_TAGS = {0x9003: "taken", 0x829D: "f_number", 0x829A: "exposure_time", 0x8827: "iso", 0x920A: "focal_length", 0x9209: "flash", 0xA403: "white_balance"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _segment(data: bytes) -> bytes | None:
    """The TIFF block of a JPEG's EXIF segment."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if data[at + 1] == 0xDA:
            break
        at += 2 + size
    return None


def _directory(tiff: bytes, order: str, at: int, names: dict[int, str]) -> dict[str, object]:
    out: dict[str, object] = {}
    for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
        if tag not in names or kind not in _SIZES:
            continue
        place = at + 10 + 12 * i
        if _SIZES[kind] * n > 4:
            place = struct.unpack_from(order + "I", tiff, place)[0]
        raw = tiff[place : place + _SIZES[kind] * n]
        if kind in (2, 7):
            out[names[tag]] = raw.split(b"\0")[0].decode("utf-8", "ignore").strip()
        elif kind in (5, 10):
            parts = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
            out[names[tag]] = [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2])]
        else:
            out[names[tag]] = list(struct.unpack(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind] }", raw))
    return out


def read_exif(data: bytes | None) -> dict:
    """timestamp text, location [lat, lon], device and camera settings of JPEG bytes; what is missing or broken is null or empty."""
    out: dict = {"timestamp": None, "location": None, "device": "", "camera_settings": {}}
    try:
        tiff = _segment(data or b"")
        if tiff is None:
            return out
        order = "<" if tiff[:2] == b"II" else ">"
        top = _directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0], IMAGE_TAGS)
        out["device"] = f"{top.get('make', '')} {top.get('model', '')}".strip()
        if "exif" in top:
            exif = _directory(tiff, order, top["exif"][0], EXIF_TAGS)
            out["timestamp"] = exif.pop("taken", None)
            out["camera_settings"] = {k: f"{v[0]:g}" if isinstance(v, list) else v for k, v in exif.items() if v not in ([], "")}
        if "gps" in top:
            gps = _directory(tiff, order, top["gps"][0], GPS_TAGS)
            lat, lon = ([(d + m / 60 + s / 3600) * (-1 if gps[r] in ("S", "W") else 1) for d, m, s in [gps[k]]][0] for k, r in (("lat", "lat_ref"), ("lon", "lon_ref")))
            out["location"] = [lat, lon]
    except (struct.error, KeyError, IndexError, ValueError, TypeError):
        pass
    return out


def exif(content: Column) -> Column:
    """struct(timestamp, location, device, camera_settings) of a column of JPEG bytes."""

    @F.pandas_udf("timestamp string, location array<double>, device string, settings array<struct<k:string,v:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [read_exif(x) for x in s]
        return pd.DataFrame(
            {
                "timestamp": [r["timestamp"] for r in rows],
                "location": [r["location"] for r in rows],
                "device": [r["device"] for r in rows],
                "settings": [[{"k": k, "v": v} for k, v in r["camera_settings"].items()] for r in rows],
            }
        )

    r = run(content)
    taken = F.regexp_replace(r["timestamp"], r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3").try_cast("timestamp_ntz")
    return F.struct(taken.alias("timestamp"), r["location"].alias("location"), r["device"].alias("device"), F.map_from_entries(r["settings"]).alias("camera_settings"))


def probe(files: DataFrame, path: str, prober: Callable[[str], str]) -> DataFrame:
    """``files`` with ``report``: the JSON that ``prober`` gives for each path; null where it fails."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for p in s:
            try:
                out.append(prober(p))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype=object)

    return files.withColumn("report", run(F.col(path)))


def video_fields(report: Column) -> Column:
    """struct(timestamp, location, device, duration, width, height, rotation, codec) of a prober's JSON report."""
    v = F.try_parse_json(report)
    tag = lambda *names: F.coalesce(*[F.try_variant_get(v, f"$.format.tags['{n}']", "string") for n in names])
    streams = F.try_variant_get(v, "$.streams", "array<variant>")
    video = F.get(F.filter(streams, lambda s: F.try_variant_get(s, "$.codec_type", "string") == "video"), 0)
    sides = F.try_variant_get(video, "$.side_data_list", "array<variant>")
    matrix = F.get(F.filter(sides, lambda s: F.try_variant_get(s, "$.side_data_type", "string") == "Display Matrix"), 0)
    turn = F.coalesce(F.abs(F.try_variant_get(matrix, "$.rotation", "int")), F.try_variant_get(video, "$.tags.rotate", "int"), F.lit(0))
    make, model = tag("make", "com.apple.quicktime.make"), tag("model", "com.apple.quicktime.model")
    return F.struct(
        tag("creation_time", "date", "CREATION_TIME").try_cast("timestamp").alias("timestamp"),
        F.coalesce(*[gps_pair(F.try_variant_get(v, f"$.format.tags['{n}']", "string")) for n in ("location", "location-eng", "LOCATION")]).alias("location"),
        F.trim(F.concat_ws(" ", make, model)).alias("device"),
        F.coalesce(F.try_variant_get(v, "$.format.duration", "double"), F.lit(0.0)).alias("duration"),
        F.try_variant_get(video, "$.width", "int").alias("width"),
        F.try_variant_get(video, "$.height", "int").alias("height"),
        F.when(video.isNotNull(), turn).alias("rotation"),
        F.try_variant_get(video, "$.codec_name", "string").alias("codec"),
    )


def places(records: DataFrame, key: str, cache: DataFrame) -> DataFrame:
    """``records`` with ``place`` from a cache of geocoded places (key, place); null where the cache has none."""
    c = cache.groupBy(F.col(key).alias("_k")).agg(F.max("place").alias("_place"))
    return records.join(c, records[key] == F.col("_k"), "left").withColumn("place", F.col("_place")).drop("_k", "_place")
