import random

import pytest

from keepsake.llm import mixing

DOCS = "doc_id bigint, src string, n bigint, uses string"
TARGETS = "mix_name string, source string, target_share double, max_repeats bigint"


def mix(spark, docs, targets, **kw):
    return mixing.mix_sources(spark.createDataFrame(docs, DOCS), "doc_id", "src", "n", spark.createDataFrame(targets, TARGETS), **kw).collect()


def shares(out, name):
    total = sum(r["uses"] * r["n_tokens"] for r in out if r["mix_name"] == name)
    got = {}
    for r in out:
        if r["mix_name"] == name:
            got[r["source"]] = got.get(r["source"], 0) + r["uses"] * r["n_tokens"] / total
    return got


def test_targets_are_met_within_repeats(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["Big", " big ", "BIG", "mid", "mid", "small"]) if i > 20 else "small", rng.randrange(1, 400), "x") for i in range(3000)]
    targets = [("m", "big", 0.5, 2), ("m", "Mid", 0.3, 3), ("m", "small", 0.2, 4), ("m", "absent", 0.4, 9), ("z", "big", 1.0, 1), ("z", "mid", 0.0, 5)]
    out = mix(spark, docs, targets)
    got = shares(out, "m")
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert got[s] == pytest.approx(want, abs=0.002)
    caps = {("m", "big"): 2, ("m", "mid"): 3, ("m", "small"): 4, ("z", "big"): 1, ("z", "mid"): 0}
    for r in out:
        assert 0 <= r["uses"] <= caps[r["mix_name"], r["source"]]
        if r["mix_name"] == "m":
            assert r["share_reached"] == pytest.approx(got[r["source"]])
    # The mix is as large as the repeats allow: some source is at its cap.
    held = {}
    for d in docs:
        held[d[1].strip().lower()] = held.get(d[1].strip().lower(), 0) + d[2]
    used = {}
    for r in out:
        if r["mix_name"] == "m":
            used[r["source"]] = used.get(r["source"], 0) + r["uses"] * r["n_tokens"]
    assert max(used[s] / (held[s] * caps["m", s]) for s in used) == pytest.approx(1, abs=0.01)
    assert all(r["uses"] == 1 for r in out if r["mix_name"] == "z" and r["source"] == "big")
    for s in ("big", "mid", "small"):  # an even spread: uses of one source differ by one at most
        u = [r["uses"] for r in out if r["mix_name"] == "m" and r["source"] == s]
        assert max(u) - min(u) <= 1


def test_fixed_total_tempers_the_shares(spark):
    docs = [(i, "a" if i < 100 else "b", 10, "") for i in range(1000)]
    out = mix(spark, docs, [("m", "a", 0.5, 2), ("m", "b", 0.5, 2)], total=9000)
    got = shares(out, "m")
    assert got["a"] == pytest.approx(2 / 9, abs=0.01) and got["b"] == pytest.approx(7 / 9, abs=0.01)


def test_temperature_and_entropy():
    p, q = {"a": 0.9, "b": 0.1}, {"a": 0.5, "b": 0.5}
    assert mixing.tempered(p, q, 0.0) == pytest.approx(p) and mixing.tempered(p, q, 1.0) == pytest.approx(q)
    x, met = mixing.solve_exponent(p, q, lambda w: 0.3 - w["b"])
    assert met
    assert mixing.tempered(p, q, x)["b"] == pytest.approx(0.3, abs=1e-6)
    plan = mixing.plan_mix([{"source": "a", "share": 0.9, "repeats": 9, "tokens": 50}, {"source": "b", "share": 0.1, "repeats": 9, "tokens": 50}], least_entropy=0.6)
    w = [r["budget"] / sum(p["budget"] for p in plan) for r in plan]
    assert mixing.entropy(dict(enumerate(w))) >= 0.59


def test_bounds_that_only_a_middle_exponent_meets():
    """Entropy rises and falls with the exponent; the falling side counts, and what cannot be met is said."""
    rows = [{"source": "a", "share": 0.02, "repeats": 90, "tokens": 900}, {"source": "b", "share": 0.98, "repeats": 90, "tokens": 100}]
    got = mixing.plan_mix(rows, least_entropy=0.69)
    weights = [r["budget"] / sum(x["budget"] for x in got) for r in got]
    assert all(r["met"] and 0 < r["exponent"] < 1 for r in got)
    assert mixing.entropy(dict(enumerate(weights))) == pytest.approx(0.69, abs=1e-3) and weights[1] > weights[0]
    assert not any(r["met"] for r in mixing.plan_mix(rows, least_entropy=0.7))
    tight = mixing.plan_mix(rows, least_entropy=0.6931471)  # only within a hundredth of a step of the grid
    assert all(r["met"] for r in tight)
    both = mixing.plan_mix(rows, total="natural", least_entropy=0.5)
    assert all(r["met"] for r in both) and sum(r["budget"] for r in both) == 1000


def test_budgets_and_registered_sql(spark):
    from pathlib import Path

    import duckdb

    from keepsake.llm import queries

    d = "/root/testdata/sf0.01"
    if not Path(d).is_dir():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in ("documents", "mix_targets"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = queries.p7_budgets(spark, d)
    want = con.sql(queries.oracle_sql()["p7_budgets"])
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect())) == sorted(want.project(", ".join(sorted(want.columns))).fetchall())
    assert any(0 < r.exponent < 1 for r in got.collect())


def test_nulls_blanks_and_empty_tables(spark):
    docs = [(1, None, 5, ""), (None, "a", 5, ""), (2, "a", None, ""), (3, "a", 0, ""), (4, "a", 7, ""), (4, "a", 7, ""), (5, " ", 3, "")]
    out = mix(spark, docs, [("m", "a", 1.0, 1), ("m", None, 1.0, 1), (None, "a", 1.0, 1), ("n", "a", None, 1), ("o", "a", 1.0, None)])
    assert sorted((r["mix_name"], r["doc_id"], r["uses"]) for r in out if r["mix_name"] == "m") == [("m", 2, 0), ("m", 3, 0), ("m", 4, 1), ("m", 4, 1)]
    assert all(r["uses"] == 0 and r["share_reached"] == 0 for r in out if r["mix_name"] in "no")
    assert mix(spark, [], [("m", "a", 1.0, 1)]) == [] and mix(spark, docs, []) == []
