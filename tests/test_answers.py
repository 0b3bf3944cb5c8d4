from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keepsake.functions import answers as A
from keepsake.operators import scoring as S


def one(spark, function, *texts):
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(function(*[F.col(f"c{i}") for i in range(len(texts))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "function,text,want",
    [
        (A.normalise_text, "  The 1st  (b) of 1,2,3! ", "the 1 of 12,3"),
        (A.without_brackets, "£12.85 (with discount)", "£12.85"),
        (A.without_breakdowns, "£10 per 60-minute session, totaling £30 for three sessions", "£10 per session"),
        (A.without_breakdowns, "It was £190.50, comprising £110 and more", "It was £190.50"),
        (A.between_to_range, "Between April 20 and April 26", "April 20 to April 26"),
        (A.without_article, "A Star event", "Star event"),
        (A.aggressive, "8 hours...", "8"),
        (A.abstains, "There is no evidence of it", True),
        (A.date_tokens, "2022-03-01, 20220302; March 3rd, 4 Apr 2022, July 4-6, 2021", ["20220301", "20220302", "20210704-20210706", "0303", "20220404"]),
        (A.time_tokens, "noon, 4 pm, 12 am, 5 to 7:30 pm, 09:15", ["17:00-19:30", "12:00", "09:15", "16:00", "00:00"]),
        (A.time_tokens, "2022-03-01", ["03:00-01:00"]),
        (A.numbers, "1000 and 12,345.5 and two", [Decimal("12345.5"), Decimal(2)]),
        (A.amounts, "£1234, 10 dollars, EUR 5", [Decimal(123), Decimal(10)]),
        (A.currencies, "£5 or 3 euros or JOD 1", ["EUR", "GBP", "JOD"]),
        (A.codes, "ab12, 25TH, ABCD, 1234, x1y2", ["AB12", "X1Y2"]),
        (A.list_items, "A, b; c and D/e", ["a", "b", "c", "d", "e"]),
        (A.list_ids, "20220101_101010.jpg 20220101_101010_resized EMAIL7 email7", ["20220101_101010", "email7"]),
        (A.number_words, "twenty TWO Threes", "20 2 Threes"),
        (A.safe_filename, "a b/c-é_1.x", "a_b_c-é_1_x"),
        (A.question_type, "between 5 and 7 pm on Monday", "number"),
        (A.question_type, "20220101_101010, email123456789012", "list_recall"),
        (A.question_type, "a red bike", "open_end"),
        (A.is_title_like, "The Old Mill", True),
        (A.is_title_like, "It is old", False),
        (A.is_location_like, "12 High Street", True),
        (A.is_location_like, "Rome, Lazio, Italy", True),
        (A.is_location_like, "Rome", False),
    ],
)
def test_scalars(spark, function, text, want):
    assert one(spark, function, text) == want


def test_jaccard_goldens(spark):
    for gt, pred, want in (("a, b, c", "a, b, c", 1), ("a, b, c", "a, b", 2 / 3), ("a, b, c", "a, b, d", 0.5), ("a, b, c", "d, e, f", 0), ("", "", 1), ("", "a", 0)):
        assert one(spark, A.list_jaccard, gt, pred) == pytest.approx(want)


def test_greedy_dates(spark):
    df = spark.createDataFrame([(["0301", "20220301"], ["20220301", "0301"]), (["0301", "0301"], ["0301"]), (["0301-0302"], ["20220301-20220302"]), (["0301-0302"], ["0301"]), ([], [])], "g array<string>, p array<string>")
    assert [r[0] for r in df.select(A.dates_match(F.col("g"), F.col("p"))).collect()] == [True, False, True, False, True]


def test_relative_dates(spark):
    df = spark.createDataFrame([("Tomorrow, not TODAY or today (x)",), (None,)], "t string")
    day = F.lit("2022-03-01").cast("date")
    assert [r[0] for r in df.select(A.resolve_relative(F.col("t"), day)).collect()] == ["March 02, not TODAY or March 01 (x)", None]
    assert df.select(A.resolve_relative(F.col("t"), F.lit(None).cast("date"))).first()[0].startswith("Tomorrow")


@pytest.mark.parametrize(
    "gt,pred,question,want",
    [
        ("unknown", "no information", "", True),
        ("unknown", "Paris", "", False),
        ("AB12CD", "ref: ab12cd", "", True),
        ("code AB12CD", "xy", "", False),
        ("March 1", "2022-03-01", "", True),
        ("March 1", "someday", "", False),
        ("4 pm", "at 5 pm", "", False),
        ("tomorrow at 4 PM", "March 02 16:00", "asked on 2022-03-01", True),
        ("£10", "10 pounds", "", True),
        ("£10", "10 dollars", "", False),
        ("7 boats", "8 boats", "", False),
        ("red, blue", "blue and red", "", True),
        ("red, blue, green", "green, blue, red", "", True),
        ("Yes", "yes", "", True),
        ("notes", "no", "", True),
        ("High Street Oxford", "it is on oxford high street", "", True),
        ("The cat", "a cat", "", True),
        ("blue bike", "red bike", "", False),
        ("large wooden garden shed door", "a wooden garden shed door", "", True),
        (None, None, None, True),
    ],
)
def test_exact_match(spark, gt, pred, question, want):
    df = spark.createDataFrame([(gt, pred, question, "x")], "g string, p string, q string, correct string")
    r = S.exact_match(df, "g", "p", "q").first()
    assert r["correct"] is want and r["g"] == gt


def test_routing_and_summary(spark, rows):
    data = [("1", "q", "5 pm", "17:00", None), ("2", "q", "a, b", "a", "list"), ("3", "q", "red", "blue", None), ("4", "q", "x", None, "odd")]
    df = spark.createDataFrame(data, "id string, q string, g string, p string, t string")
    asked = []

    def judge(f):
        asked.append(len(f))
        return f["ground_truth"].str.len() * 0 + 0.25

    out = S.score_answers(df, "g", "p", "q", "t", judge)
    assert rows(out.select("id", "type", "metric", "accuracy")) == [("1", "number", "em", 1.0), ("2", "list_recall", "jaccard", 0.5), ("3", "open_end", "llm", 0.25), ("4", "open_end", "llm", 0.25)]
    assert rows(S.summarise_scores(out)) == [("all", 4, 2.0, 0.5), ("list_recall", 1, 0.5, 0.5), ("number", 1, 1.0, 1.0), ("open_end", 2, 0.5, 0.25)]
    assert rows(S.summarise_scores(out.where("id > '9'"))) == [(k, 0, 0.0, 0.0) for k in ("all", "list_recall", "number", "open_end")]


def test_scores_are_coerced(spark):
    df = spark.createDataFrame([("true",), ("False",), ("0.4",), ("7",), ("-1",), ("x",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(A.unit_score(F.col("s"))).collect()] == [1, 0, 0.4, 1, 0, 0, 0, 0]


def test_judge_is_not_asked_twice_and_failures_are_marked(spark, rows):
    df = spark.createDataFrame([(str(i), "q", "g", "p") for i in range(4)], "id string, question string, ground_truth string, prediction string")

    def judge(f):
        if "2" in set(f["id"]):
            raise RuntimeError
        return f["id"].str.len() / 2.0

    cache = spark.createDataFrame([("0", 0.9, False), ("1", 0.1, True)], "id string, accuracy double, failed boolean")
    out = S.judged(df.repartition(4, "id"), judge, "id", cache)
    got = {r[0]: r[1:] for r in rows(out)}
    assert got["0"] == (0.9, False) and got["2"] == (0.0, True) and len(got) == 4
