import math
import random

from pyspark.sql import functions as F

from keepsake.llm import topn

SCHEMA = "g string, i string, s double, pos int"


def brute(data, n):
    best = {}
    for g, i, s, _ in data:
        if s is not None and not math.isnan(s) and i is not None:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -math.inf))
    out = []
    for g, items in best.items():
        ranked = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:n]
        out += [(g, p + 1, i, s + 0.0) for p, (i, s) in enumerate(ranked)]
    return sorted(out, key=repr)


def run(spark, rows, data, n):
    return rows(topn.top_n(spark.createDataFrame(data, SCHEMA), ["g"], "i", "s", n))


def test_against_brute_force(spark, rows):
    rng = random.Random(5)
    scales = (1e-300, 1e-5, 1.0, 1e7, 1e300, -1.0)
    data = [(f"g{rng.randrange(6) ** 2 % 7}", f"i{rng.randrange(90)}", rng.choice(scales) * rng.choice((rng.random(), round(rng.random(), 1), 1.0)), 0) for _ in range(6000)]
    assert run(spark, rows, data, 10) == brute(data, 10)


def test_ties_repeats_nulls_and_extremes(spark, rows):
    inf, nan = math.inf, math.nan
    data = [("a", x, 1.0, 1) for x in ("z", "é", "A", "a", "a", "Z")] + [("a", None, 9.0, 1), ("a", "n", None, 1), ("a", "m", nan, 1)]
    data += [(None, "x", 0.0, 1), (None, "y", -0.0, 1), ("b", "p", inf, 1), ("b", "q", -inf, 1), ("b", "r", 5e-324, 1), ("b", "s", -5e-324, 1), ("c", "n", None, 1)]
    assert run(spark, rows, data, 3) == brute(data, 3)


def test_empty_table(spark, rows):
    assert run(spark, rows, [], 3) == []


def test_bins_never_fall(spark):
    rng = random.Random(1)
    xs = sorted([rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(3000)] + [2.0**k for k in range(-1000, 1000, 7)] + [0.0])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(topn.score_bin(F.col("x"))).collect()]
    assert got == sorted(got)


def test_pairing_of_arrays(spark, rows):
    data = [("q", ["a", "b", "c"], [1.0, 2.0]), ("r", None, [1.0]), ("s", [], []), ("t", ["x", None], [3.0, 4.0])]
    df = spark.createDataFrame(data, "id string, i array<string>, s array<double>")
    assert rows(topn.paired(df, {"qa": F.col("id")}, "i", "s")) == [("q", "a", 1.0), ("q", "b", 2.0), ("t", "x", 3.0), ("t", None, 4.0)]
