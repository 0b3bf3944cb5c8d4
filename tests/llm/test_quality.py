import random

import numpy as np
import pytest

from keepsake.llm import quality

COMMON = "the a of and to in is it was on we that with had for you".split()


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")


def stats(spark, common, text):
    df = spark.createDataFrame([(1, text)], "id bigint, t string")
    r = quality.with_statistics(df, "t", common).first()["stats"]
    return None if r is None else r.asDict()


def test_statistics_of_a_small_text(spark, common):
    s = stats(spark, common, "The cat had 12 toys.\n- one\n\n- two three")
    assert (s["n_words"], s["n_lines"], s["words_per_line"]) == (8, 3, pytest.approx(8 / 3))
    assert s["marked_lines"] == pytest.approx(2 / 3) and s["punctuated_lines"] == pytest.approx(1 / 3)
    assert s["common_words"] == pytest.approx(2 / 8) and s["distinct_words"] == 1.0 and s["number_words"] == pytest.approx(1 / 8)
    assert s["mean_word_length"] == pytest.approx(sum(map(len, "The cat had 12 toys one two three".split())) / 8)
    assert s["digit_ratio"] == pytest.approx(2 / 29)


@pytest.mark.parametrize("text", [None, "", " \n\t", " ​"])
def test_no_statistics(spark, common, text):
    assert stats(spark, common, text) is None


def test_odd_texts(spark, common):
    for text in ("。", "😀" * 50, "x" * 500_000, "<td>" * 10, "�"):
        assert all(np.isfinite(v) for v in stats(spark, common, text).values())
    assert stats(spark, common, "这是一个 句子。")["cjk_ratio"] == pytest.approx(6 / 7)


def test_more_frequent_words_than_a_plan_takes(spark, common, monkeypatch):
    texts = [(1, "The cat and the dog was in it"), (2, "nothing here"), (3, None), (4, "the the the"), (4, " ")]
    df = spark.createDataFrame(texts, "id bigint, t string")
    run = lambda: sorted(map(repr, quality.with_statistics(df, "t", common).select("id", "stats.common_words", "stats.running_words", "stats.n_words").collect()))
    want = run()
    monkeypatch.setattr(quality, "MOST_WORDS", 3)
    assert run() == want


def documents(n, seed):
    rng = random.Random(seed)
    nouns = [f"{a}{b}" for a in ("lam", "ket", "gar", "win", "bas") for b in ("p", "tle", "den", "dow", "ket")]
    noun = lambda: rng.choice(nouns)
    make = {
        "prose": lambda: " ".join(f"We had the {noun()} in the {noun()} and it was {noun()} for you." for _ in range(rng.randrange(1, 9))),
        "list": lambda: "\n".join(f"- {noun()} {noun()}" for _ in range(rng.randrange(4, 15))),
        "table": lambda: "\n".join(f"{noun()};{rng.randrange(99)};{rng.randrange(99)};{noun()}" for _ in range(rng.randrange(4, 15))),
        "junk": lambda: rng.choice([lambda: "~*" * 60, lambda: " ".join(noun() for _ in range(80)), lambda: "Loading, please wait. " * 20])(),
    }
    kinds = ["prose"] * 5 + ["list", "table", "junk"]
    return [(i, k, make[k]()) for i in range(n) for k in [rng.choice(kinds)]]


def test_learned_rules_on_held_out_documents(spark, common):
    rng = random.Random(9)
    train, test = documents(500, 1), documents(400, 2)
    noisy = [(i, rng.choice(["prose", "list", "table", "junk"]) if rng.random() < 0.05 else k) for i, k, _ in train] + [(None, "junk"), (7, None), (99999, "list")]
    docs = spark.createDataFrame([(i, t) for i, _, t in train], "doc_id bigint, text string")
    labels = spark.createDataFrame(noisy, "doc_id bigint, kind string")
    rules = quality.learn_kinds(docs, "doc_id", "text", common, labels)
    assert rules == quality.learn_kinds(docs.repartition(3), "doc_id", "text", common, labels.repartition(2))
    held = spark.createDataFrame([(i, t, "x", "y") for i, _, t in test] + [(-1, None, "x", "y"), (-2, " ", "x", "y")], "doc_id bigint, text string, kind string, stats string")
    got = {r["doc_id"]: r["kind"] for r in quality.with_kind(quality.with_statistics(held, "text", common), rules).collect()}
    assert sum(got[i] == k for i, k, _ in test) / len(test) > 0.97
    assert got[-1] is None and got[-2] is None
    sql = quality.with_statistics(held, "text", common).selectExpr("doc_id", f"case when stats is not null then {quality.to_sql(rules, 'prose')} end as k")
    assert {r["doc_id"]: r["k"] for r in sql.collect()} == got


def test_without_labels_or_documents(spark, common):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, kind string")
    assert quality.learn_kinds(docs, "doc_id", "text", common, none) == []
    assert quality.with_kind(quality.with_statistics(docs, "text", common), []).collect() == []
    assert quality.to_sql([], "prose") == "'prose'"
