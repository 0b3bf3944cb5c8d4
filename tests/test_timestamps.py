from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake.operators import timestamps as T


def at(text, *more):
    us = T.parse_timestamp(text, *more)
    return None if us is None else str(datetime(1970, 1, 1) + timedelta(microseconds=us))


@pytest.mark.parametrize(
    "args,want",
    [
        (("2024-03-31T01:21:13Z",), "2024-03-31 01:21:13"),
        ((" 2024-04-30 11:45:30\n",), "2024-04-30 11:45:30"),
        (("2022-04-15T14:36:45.894938972Z",), "2022-04-15 14:36:45.894938"),
        (("2020-04-08T14:07:45.697371+0000",), "2020-04-08 14:07:45.697371"),
        (("2024-02-19T02:50:00-03:30[America/St_Johns]",), "2024-02-19 06:20:00"),
        (("2020-04-06 16:39:45 America/New_York", "Europe/Berlin"), "2020-04-06 20:39:45"),
        (("2020-08-02 02:24:10 EEST", "Asia/Tokyo"), "2020-08-01 23:24:10"),
        (("2023-05-04 14:04:30 -02:30",), "2023-05-04 16:34:30"),
        (("Sat, 24 Feb 2024 20:22:55 +0100",), "2024-02-24 19:22:55"),
        (("Sat Oct  9 21:23:00 UTC 2021",), "2021-10-09 21:23:00"),
        (("2021:08:26 14:05:35", "Asia/Kathmandu"), "2021-08-26 08:20:35"),
        (("20230201_045335",), "2023-02-01 04:53:35"),
        (("20231201",), "2023-12-01 00:00:00"),
        (("2019/08/05",), "2019-08-05 00:00:00"),
        (("24. Oktober 2023 04:49 Uhr",), "2023-10-24 04:49:00"),
        (("11 avril 2021 à 9h05",), "2021-04-11 09:05:00"),
        (("17 de noviembre de 2021, 08:26",), "2021-11-17 08:26:00"),
        (("February 5, 2023 12:39 AM",), "2023-02-05 00:39:00"),
        (("October 20, 2019 12:44 PM",), "2019-10-20 12:44:00"),
        (("2021年8月21日 10:41",), "2021-08-21 10:41:00"),
        (("8.3.2020 03:08",), "2020-03-08 03:08:00"),
        (("10/04/2021 09:20", "America/Phoenix", "mdy"), "2021-10-04 16:20:00"),
        (("10/04/2021 09:20", None, "dmy"), "2021-04-10 09:20:00"),
        (("10/04/2021 09:20",), "2021-04-10 09:20:00"),
        (("10/24/2021 09:20", None, "dmy"), "2021-10-24 09:20:00"),
        (("24/10/2021 09:20", None, "mdy"), "2021-10-24 09:20:00"),
        (("1603044855",), "2020-10-18 18:14:15"),
        (("1680204455.63",), "2023-03-30 19:27:35.630000"),
        (("1568446335453",), "2019-09-14 07:32:15.453000"),
        (("1650758620948904",), "2022-04-24 00:03:40.948904"),
        # The clock goes back: the first of two; forward: moved by the gap.
        (("2019-11-03 01:30:00", "America/New_York"), "2019-11-03 05:30:00"),
        (("2020-03-29 02:30:00", "Europe/Berlin"), "2020-03-29 01:30:00"),
        (("2023-11-05 00:30:00", "America/St_Johns"), "2023-11-05 03:00:00"),
    ],
)
def test_instants(args, want):
    assert at(*args) == want


@pytest.mark.parametrize("text", [None, "", "  ", "none", "n/a", "around noon", "last Tuesday", "2020", "2019-01", "June 2019", "31 April 2022 09:30", "2023:06:31 12:56:00", "2021-13-01T08:00:00", "0000:00:00 00:00:00", "2020-05-14 27:15:00", "20240230", "123", "2020-01-01 10:00 Nowhere/Town"])
def test_no_instant(text):
    assert at(text) is None


def test_epoch_years():
    assert at("946684800") == "2000-01-01 00:00:00" and at("1767225600000") == "2026-01-01 00:00:00"
    assert T.parse_timestamp("946684800", years=(2019, 2025)) is None and T.parse_timestamp("100000000", years=(1970, 1980)) == 100000000 * 10**6


def test_dictionary_grows_and_joins_back(spark, rows, tmp_path):
    path = str(tmp_path / "dict")
    data = [(1, "2021-01-01", "Asia/Tokyo", None), (2, "2021-01-01", None, None), (3, None, None, None), (4, "junk", None, None), (4, "2021-01-01", None, "mdy")]
    df = spark.createDataFrame(data, "id bigint, raw string, zone string, utc_us string")
    run = lambda d: rows(T.normalise(d, "raw", F.col("zone"), F.lit(None).cast("string"), path=path))
    t, u = T.parse_timestamp("2021-01-01", "Asia/Tokyo"), T.parse_timestamp("2021-01-01")
    want = [(1, "2021-01-01", "Asia/Tokyo", t), (2, "2021-01-01", None, u), (3, None, None, None), (4, "2021-01-01", None, u), (4, "junk", None, None)]
    assert run(df) == want
    folder = f"{path}/{T.rules_digest(T.EPOCH_YEARS)}"
    assert spark.read.parquet(folder + "/part-*").count() == 3
    more = df.unionByName(spark.createDataFrame([(9, "2022-02-02", None, None)], df.schema))
    assert run(more) == sorted([*want, (9, "2022-02-02", None, T.parse_timestamp("2022-02-02"))], key=repr)
    assert spark.read.parquet(folder + "/part-*").count() == 4, "known values are not parsed again"
    assert run(df.where("id > 99")) == []
    T.compact(spark, folder)
    assert len(T._parts(spark, folder)) == 1 and len(T._parts(spark, folder, old=True)) == 3
    T.compact(spark, folder, grace_days=-1)
    assert len(T._parts(spark, folder)) == 1 and not T._parts(spark, folder, old=True)
    assert run(df) == want
    other = rows(T.normalise(spark.createDataFrame([(1, "946684800")], "id int, raw string"), "raw", F.lit(None), F.lit(None), path=path, years=(2019, 2025)))
    assert other == [(1, "946684800", None)], "other rules, another dictionary"


def test_busy_values_and_nulls(spark, rows, tmp_path, monkeypatch):
    """A value of half the rows and one of a few, with values that denote nothing among the busy ones."""
    monkeypatch.setattr(T, "BUSY", 4)
    data = [(i, ["2021-01-01", "junk", None, f"2021-01-{i % 28 + 1:02d}"][min(i % 6, 3)], "x", i) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, _raw string, zone string, utc_us bigint")
    got = rows(T.normalise(df, "_raw", F.lit(None), F.lit(None), path=str(tmp_path / "d")).select("id", "_raw", "utc_us"))
    assert got == sorted(((i, r, T.parse_timestamp(r)) for i, r, _, _ in data), key=repr)


def test_very_long_text():
    assert at("x" * 1_000_000) is None and at(" " * 100_000 + "2021-01-01") == "2021-01-01 00:00:00"
