"""Places in groups, memory that changes, judges with patience, records and reports: small cases and brute force."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.operators import corpus, lookups, memory, metrics, pipelines, ranking, scoring, summaries, usage, vectors
from keepsake.sources import readers, sinks


def test_places_in_groups_against_a_window(spark, rows):
    """One group holds most rows and lies in several partitions; null is a group too."""
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), i, "x") for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, id bigint, _n string")
    got = corpus.grouped_index(df, ["g"], ["v", "id"], "place", start=1)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("bigint"))
    assert rows(got) == rows(want)
    assert rows(corpus.grouped_index(df.where("id < 0"), ["g"], ["v", "id"], "place")) == []
    two = corpus.grouped_index(df, ["g", "v"], [F.desc("id")], "place", start=0)
    assert rows(two) == rows(df.withColumn("place", (F.row_number().over(Window.partitionBy("g", "v").orderBy(F.desc("id"))) - 1).cast("bigint")))


def test_evolving_memory_against_brute_force(spark):
    """Notes join in order; each links to its nearest and marks them."""
    rng = random.Random(2)
    notes = [{"id": f"n{i:02d}", "v": [float(rng.randrange(-4, 5)) for _ in range(4)]} for i in range(30)]
    decide = lambda note, near: ({"links": [n["id"] for n in near]}, {n["id"]: {"seen": n.get("seen", 0) + 1, "id": "no"} for n in near} | {"unknown": {"seen": 1}})
    df = spark.createDataFrame([(i, n["id"], n["v"]) for i, n in enumerate(notes)], "ord int, id string, v array<double>")
    step = lambda state, row: memory.evolve(state, {"id": row["id"], "v": row["v"]}, lambda n: n["v"], decide, k=3)
    state = memory.ingest_in_order(df, ["ord"], {}, step)

    def unit(v):
        n = np.linalg.norm(v)
        return np.asarray(v) / n if n else np.asarray(v)

    seen: dict = {}
    for i, n in enumerate(notes):
        near = sorted(notes[:i], key=lambda m: (-round(float(unit(n["v"]) @ unit(m["v"])), 12), m["id"]))[:3]
        best = [round(float(unit(n["v"]) @ unit(m["v"])), 9) for m in near]
        got = state[n["id"]]["links"]
        assert [round(float(unit(n["v"]) @ unit(next(m["v"] for m in notes if m["id"] == x))), 9) for x in got] == best
        for x in got:
            seen[x] = seen.get(x, 0) + 1
    assert {k: v["seen"] for k, v in state.items() if "seen" in v} == seen and "unknown" not in state


def test_indexed_memory_equals_a_scan_and_keeps_pace():
    """Repeated, equal, zero and taken-out vectors; then 30,000 notes, for which a scan of all in each step takes many minutes."""
    rng = random.Random(5)
    state, plain = memory.Notes(), {}
    decide = lambda note, near: ({"links": [n["id"] for n in near]}, {n["id"]: {"seen": n.get("seen", 0) + 1, "vector": None} for n in near})
    for _ in range(400):
        note = {"id": rng.randrange(150), "v": [float(rng.randrange(-1, 2)) for _ in range(3)]}
        v = np.asarray(note["v"])
        v = v / np.linalg.norm(v) if v.any() else v
        want = sorted(plain, key=lambda i: (-round(float(plain[i] @ v), 9), i))
        memory.evolve(state, note, lambda n: n["v"], decide, k=4)
        got = state[note["id"]]["links"]
        product = lambda i: round(float(plain[i] @ v), 9)  # noqa: E731, B023
        assert [product(i) for i in got] == [product(i) for i in want[:4]] and len(set(got)) == len(got)
        plain[note["id"]] = v
        if rng.random() < 0.2:
            gone = rng.choice(sorted(plain))
            del plain[gone], state[gone]
    assert set(state) == set(plain) and all(np.allclose(state[i]["vector"], plain[i]) for i in plain)
    state, began = memory.Notes(), time.time()
    for i in range(30_000):
        memory.evolve(state, {"id": i}, lambda n: np.eye(16)[n["id"] % 16], lambda note, near: ({"links": [n["id"] for n in near]}, {}), k=3)
    assert state[29_999]["links"] == [15, 31, 47] and time.time() - began < 30


def test_bad_rows_cost_few_calls(spark, tmp_path):
    """Two bad rows of a thousand: each fails alone after all its tries, and the others are not asked for one by one."""
    log = tmp_path / "calls"

    def maker(f):
        with log.open("a") as out:
            out.write(f"{len(f)} {f['id'].iloc[0]}\n")
        if f["id"].isin([500, 999]).any():
            raise ValueError("unclear")
        return pd.DataFrame({"t": "t" + f["id"].astype(str)}, index=f.index)

    got = memory.make_rows(spark.range(1000).coalesce(1), maker, "t string", "id", tries=2).collect()
    assert sorted((r.id, r.t, r.status, r.error) for r in got) == [(i, None, "failed", "unclear") if i in (500, 999) else (i, f"t{i}", "success", None) for i in range(1000)]
    calls = log.read_text().split("\n")
    assert len(calls) < 120 and calls.count("1 500") == calls.count("1 999") == 2


def test_few_partitions_are_dealt_out(spark):
    """What a model makes of files is made by all cores, however small the table of files is."""
    look = lambda f: pd.DataFrame({c.split()[0]: str(TaskContext.get().partitionId()) for c in pipelines.SEEN.split(", ")}, index=f.index)
    df = spark.range(400).select(F.col("id").cast("string").alias("p")).coalesce(1)
    assert pipelines._described(df, "p", look, pipelines.SEEN).select("city").distinct().count() == 4


def test_snapshots_keep_questions_apart(spark, rows, tmp_path):
    at = str(tmp_path / "snap")
    first = spark.createDataFrame([(1, "a")], "id int, t string")
    assert memory.save_snapshot(first, at, "m") and not memory.save_snapshot(first.withColumn("t", F.lit("b")), at, "m")
    q = spark.createDataFrame([(7,)], "q int")
    for _ in range(2):  # what one answer adds, the next does not see
        out = memory.isolated(spark, at, "m", q, lambda q, m: q.crossJoin(m.unionByName(m.withColumn("t", F.lit("own")))))
        assert rows(out) == [(7, 1, "a"), (7, 1, "own")]
    assert memory.save_snapshot(first.withColumn("t", F.lit("b")), at, "m", force=True)
    assert rows(spark.read.parquet(f"{at}/m")) == [(1, "b")]
    assert memory.history_floors(10, 3, 20, 2.5) == (10, 20, 10.0)


def test_judges_with_patience(spark, rows):
    df = spark.createDataFrame([(i, "q", "t", None) for i in range(5)], "id int, question string, ground_truth string, prediction string").coalesce(1)

    def judge():
        tries = {}

        def one(r):
            n = tries[r["id"]] = tries.get(r["id"], 0) + 1
            if r["id"] == 0:
                raise scoring.Refused("no")
            if r["id"] == 1 and n < 3:
                raise RuntimeError("x")
            if r["id"] == 2:
                raise RuntimeError("429 slow down")
            return 7.0 if r["id"] == 3 else -1.0

        return one

    out = rows(scoring.judged_with_retries(df, judge, "id", tries=3, wait=0.0, throttled_tries=4))
    assert out == [(0, 0.0, True, 1, False), (1, 0.0, False, 2, False), (2, 0.0, True, 4, False), (3, 1.0, False, 0, False), (4, 0.0, False, 0, False)]
    spare = rows(scoring.judged_with_retries(df, judge, "id", fallback=lambda: lambda r: 0.5, tries=3, wait=0.0, fallback_after=2))
    assert [r[1:] for r in spare[:3]] == [(0.5, False, 1, True), (0.5, False, 2, True), (0.5, False, 2, True)]
    again = scoring.judged_with_retries(df, judge, "id", cache=spark.createDataFrame([(3, 0.25, False), (1, 0.0, True)], "id int, accuracy double, failed boolean"), tries=1, wait=0.0)
    assert {r[0]: r[1:3] for r in rows(again)} == {0: (0.0, True), 1: (0.0, True), 2: (0.0, True), 3: (0.25, False), 4: (0.0, False)}
    assert rows(scoring.judged_with_retries(df.where("id > 9"), judge, "id")) == []


def test_entries_to_the_items_of_their_window(spark, rows):
    items = [(1, "i1", 1, "lighthouse keeper timestamp"), (1, "i2", 2, "harbour keeper lighthouse"), (1, "i2", 3, None), (2, "i3", 1, None), (1, None, 4, "x")]
    entries = [(10, 1, "I2 and i1 are told"), (11, 1, "the LIGHTHOUSE KEEPER sleeps"), (12, 1, "nothing"), (13, 2, None), (14, 9, "i1")]
    e = spark.createDataFrame(entries, "entry_id int, win int, text string")
    i = spark.createDataFrame(items, "win int, item_id string, place int, item_text string")
    got = rows(lookups.attribute_windows(e, i, "win"))
    assert got == [(10, ["i1"], "id"), (11, ["i1", "i2"], "words"), (12, ["i1", "i2"], "window"), (13, ["i3"], "window")]


def test_small_choices():
    assert vectors.positive_label({0: "LABEL_0", 1: "LABEL_1"}) == 1 and vectors.positive_label({0: "Relevant", 1: "other"}) == 0
    assert vectors.positive_label({0: "no", 1: "maybe", 2: "yes"}) == 2 and vectors.positive_label({0: "pos", 1: "neg"}) == 0
    h = np.arange(12.0).reshape(2, 3, 2)
    assert vectors.last_token(h, np.array([[1, 1, 0], [1, 1, 1]])).tolist() == [[2, 3], [10, 11]]
    assert vectors.last_token(h, np.array([[0, 1, 1], [1, 1, 1]])).tolist() == [[4, 5], [10, 11]]
    assert corpus.evidence_fields(" ALL ") == corpus.EVIDENCE_FIELDS and corpus.evidence_fields("id-only") == ()
    assert corpus.evidence_fields("time, place ocr") == ("timestamp", "location", "ocr")
    with pytest.raises(ValueError, match="colour"):
        corpus.evidence_fields("type colour")


def test_records_with_nulls_and_empty_tables(spark, rows):
    a = spark.createDataFrame([("1", None, None), ("2", " ", None), ("3", None, "e"), (None, "x", "")], "id string, answer string, error string")
    r = spark.createDataFrame([("1", 5)], "id string, retrieval_record int")
    out = lookups.checkpoint_records(a, r, "id", "answer", "error").select("id", "answer", "status", "error", "retrieval_record")
    assert rows(out) == sorted([("1", None, "failed", "empty answer", 5), ("2", " ", "failed", "empty answer", None), ("3", "", "failed", "e", None), (None, "x", "ok", None, None)], key=repr)
    runs = spark.createDataFrame([("q", ["a", "a", None, ""], ["a", "b"], [0.5]), ("r", None, None, None)], "id string, g array<string>, r array<string>, s array<double>")
    d = rows(metrics.recall_detail(runs, "id", "g", "r", "s", ks=(1,)))
    assert d == [("q", ["a"], ["a", "b"], [0.5], 1.0), ("r", [], [], None, 0.0)]
    assert metrics.depth(runs, "r").first()[0] == 2 and metrics.depth(runs.where("id = ''"), "r").first()[0] == 0
    one = spark.createDataFrame([(["a", "b", "c"], None)], "x array<string>, y array<string>")
    got = one.select(ranking.batched(F.col("x"), 2), ranking.batched(F.col("y"), 2), ranking.first_items(F.col("x"), 2), ranking.first_items(F.col("y"), None)).first()
    assert tuple(got) == ([["a", "b"], ["c"]], [], ["a", "b"], [])
    p = spark.createDataFrame([("i", "image", "t", None), ("j", "email", "", {"a": "b"}), ("k", "email", "u", {"item_id": "own"})], "item_id string, modality string, text string, metadata map<string,string>")
    assert rows(corpus.memory_payloads(p).select("item_id", F.col("metadata")["item_id"])) == [("i", "i"), ("k", "own")]
    assert rows(corpus.sanitised(spark.createDataFrame([("i", "q", "a")], "id string, question string, answer string"))) == [("i", "q")]


def test_shapes_of_search_replies(spark):
    def hits(text):
        r = spark.createDataFrame([(text,)], "t string").select(usage.search_hits(F.try_parse_json("t")).alias("h")).first()[0]
        return r if r is None else [tuple(x) for x in r]

    assert hits('[{"memory": "[z] m", "score": null}, {"text": "t", "item_id": "i", "metadata": {"item_id": "m"}}, 3]') == [("[z] m", "z", 0.0), ("t", "m", 0.0)]
    assert hits('{"results": [], "data": [{"text": "d", "score": 2}]}') == [("d", None, 2.0)]
    assert hits('{"x": 1}') == hits('"s"') == [] and not hits("broken {")


def test_sinks_replace_and_number_safely(spark, rows, tmp_path):
    log, up, page = str(tmp_path / "log"), str(tmp_path / "up"), str(tmp_path / "page")
    ids = spark.createDataFrame([("b",), ("a",), ("a",)], "item_id string")
    for keep in ("item_id <> ''", "item_id = 'a'", "item_id = 'none'"):
        sinks.rewrite_progress(ids.where(keep), log)
        assert rows(readers.progress(spark, log)) == rows(ids.where(keep).distinct())
    assert not any(p.name.startswith("log.") for p in tmp_path.iterdir())
    # Read and write of the same log at once: the new one is whole before the old one goes.
    sinks.rewrite_progress(ids, log)
    sinks.rewrite_progress(readers.progress(spark, log).where("item_id = 'b'"), log)
    assert rows(readers.progress(spark, log)) == [("b",)]
    for v in ("one", "two", "three"):
        sinks.upsert(spark.createDataFrame([("k", v)], "id string, v string"), up)
    assert rows(sinks.read_upserted(spark, up)) == [("k", "three")]
    sinks.write_report(spark.createDataFrame([("a<b", 1.5), (None, None)], "x string, y double"), page, "T")
    text = "".join(r[0] for r in spark.read.text(page).collect())
    assert "<td>a&lt;b</td><td>1.5</td>" in text and text.endswith("</html>") and "<td></td><td></td>" in text
    assert rows(summaries.html(spark.createDataFrame([], "x string"), "T").select("line"))[0] == (1,)
