import json
import struct

import pytest
from pyspark.sql import functions as F

from keepsake.operators import prompts
from keepsake.sources import media


def jpeg(order="<"):
    """A JPEG of nothing but an EXIF segment: maker, time, aperture and place."""

    def entries(rows, at):
        head, tail = struct.pack(order + "H", len(rows)), b""
        free = at + 2 + 12 * len(rows) + 4
        for tag, kind, n, raw in rows:
            head += struct.pack(order + "HHI", tag, kind, n)
            if len(raw) <= 4:
                head += raw.ljust(4, b"\0")
            else:
                head += struct.pack(order + "I", free + len(tail))
                tail += raw
        return head + b"\0" * 4 + tail

    ratio = lambda *xs: b"".join(struct.pack(order + "II", a, b) for a, b in xs)
    long = lambda x: struct.pack(order + "I", x)
    exif_at, gps_at = 200, 400
    top = entries([(0x010F, 2, 5, b"Acme\0"), (0x0110, 2, 3, b"X1\0"), (0x8769, 4, 1, long(exif_at)), (0x8825, 4, 1, long(gps_at))], 8)
    exif = entries([(0x9003, 2, 20, b"2021:02:03 04:05:06\0"), (0x829D, 5, 1, ratio((28, 10))), (0x8827, 3, 1, struct.pack(order + "H", 200))], exif_at)
    gps = entries([(1, 2, 2, b"N\0"), (2, 5, 3, ratio((52, 1), (30, 1), (0, 1))), (3, 2, 2, b"W\0"), (4, 5, 3, ratio((1, 1), (15, 1), (36, 1)))], gps_at)
    tiff = ((b"II*\0" if order == "<" else b"MM\0*") + long(8) + top).ljust(exif_at, b"\0")
    tiff = (tiff + exif).ljust(gps_at, b"\0") + gps
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


@pytest.mark.parametrize("order", "<>")
def test_exif(order):
    got = media.read_exif(jpeg(order))
    assert got["timestamp"] == "2021:02:03 04:05:06" and got["device"] == "Acme X1"
    assert got["location"] == pytest.approx([52.5, -1.26]) and got["camera_settings"] == {"f_number": "2.8", "iso": "200"}


@pytest.mark.parametrize("data", [None, b"", b"\xff\xd8", b"png", jpeg()[:60], jpeg()[:300]])
def test_broken_exif(data):
    assert set(media.read_exif(data)) == {"timestamp", "location", "device", "camera_settings"}


def test_exif_column(spark):
    df = spark.createDataFrame([(bytearray(jpeg()),), (None,)], "content binary")
    a, b = [r[0] for r in df.select(media.exif(F.col("content"))).collect()]
    assert str(a["timestamp"]) == "2021-02-03 04:05:06" and a["camera_settings"]["iso"] == "200" and b["device"] == "" and b["timestamp"] is None


def test_video_report(spark):
    report = {"format": {"duration": "12.5", "tags": {"creation_time": "2021-02-03T04:05:06.000000Z", "location": "+52.5-000.1/", "make": "A", "model": "B"}}, "streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 640, "height": 480, "codec_name": "h264", "side_data_list": [{"side_data_type": "Display Matrix", "rotation": -90}]}]}
    df = spark.createDataFrame([("a",), ("b",)], "path string")

    def prober(p):
        if p == "b":
            raise OSError
        return json.dumps(report)

    a, b = [r[0] for r in media.probe(df, "path", prober).select(media.video_fields(F.col("report"))).collect()]
    assert (str(a["timestamp"]), a["location"], a["device"], a["duration"], a["width"], a["rotation"], a["codec"]) == ("2021-02-03 04:05:06", [52.5, -0.1], "A B", 12.5, 640, 90, "h264")
    assert b["timestamp"] is None and b["duration"] == 0.0 and b["rotation"] is None


def test_prompts(spark, rows):
    df = spark.createDataFrame([("q", ["a", "b"])], "q string, c array<string>")
    m = df.select(prompts.text_messages(F.col("q"), F.col("c"), "sys")).first()[0]
    assert [(x["role"], x["content"]) for x in m] == [("system", "sys"), ("user", "Evidence 1:\na\nEvidence 2:\nb\n\nQuestion: q")]
    ev = spark.createDataFrame([("q", i, k) for i, k in enumerate(["video", "image", "video", "video"])] + [("p", 0, "email")], "q string, n int, kind string")
    assert rows(prompts.frame_budget(ev, "q", "n", "kind", 4, 5).select("q", "n", "frames")) == [("p", 0, 0), ("q", 0, 1), ("q", 1, 0), ("q", 2, 1), ("q", 3, 1)]
    assert [r[2] for r in rows(prompts.frame_budget(ev, "q", "n", "kind", 4, 2).select("q", "n", "frames"))] == [0, 1, 0, 1, 0]
    t = spark.createDataFrame([("x Answer: y Answer: z", ""), (" plain ", "old"), (None, None)], "r string, d string")
    assert [r[0] for r in t.select(prompts.answer_after_marker(F.col("r"))).collect()] == ["y", "plain", None]
    assert [r[0] for r in t.select(prompts.or_default(F.col("d"), "new", ("old",))).collect()] == ["new"] * 3
    n = t.select(prompts.normalised_answer(F.lit("1"), F.col("d"), F.lit("told"), F.col("r"))).collect()
    assert [(r[0]["question"], r[0]["missing"]) for r in n] == [("told", []), ("old", []), ("told", ["answer"])]
    s = prompts.token_stats(spark.createDataFrame([(1, 2, None), (3, 4, 9), (None, None, None)], "prompt_tokens int, completion_tokens int, total_tokens int")).first()
    assert (s["answers"], s["prompt_sum"], s["total_sum"], s["total_avg"]) == (3, 4, 12, 6.0)
    part = spark.createDataFrame([(bytearray(b"hi"),)], "b binary").select(prompts.media_part(F.lit("L"), F.col("b"), F.lit("image/png"))).first()[0]
    assert part["url"] == "data:image/png;base64,aGk="
    c = spark.createDataFrame([("a", "Rome"), ("a", "Rome")], "id string, place string")
    assert rows(media.places(spark.createDataFrame([("a",), ("b",)], "id string"), "id", c)) == [("a", "Rome"), ("b", None)]
