import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.functions import formats, jsontext
from keepsake.operators import corpus, graph, lexical, lookups, memory, metrics, ranking, summaries, usage, vectors
from keepsake.streaming import events as ev


def one(spark, kinds, row, *cols):
    return tuple(spark.createDataFrame([row], kinds).select(*cols).first())


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1064)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r[0]: r[1] for r in graph.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


def test_recall_goldens(spark):
    c = [F.col("g"), F.col("r")]
    row = (["d5", "d12"], ["d5", "d8", "d12", "d3", "d99"])
    got = one(spark, "g array<string>, r array<string>", row, *[metrics.recall_set(*c, k) for k in (1, 5, 10)], metrics.r_precision(*c), metrics.hit_at_1(*c))
    assert got == (0.5, 1.0, 1.0, 0.5, 1.0)
    dup = (["a", "b"], ["a", "a", "x"])
    assert one(spark, "g array<string>, r array<string>", dup, metrics.recall_list(*c, 5), metrics.recall_deduplicated(*c, 5), metrics.recall_set(*c, 5)) == (1.0, 0.5, 0.5)
    assert one(spark, "g array<string>, r array<string>", (None, ["a"]), metrics.recall_list(*c, 5), metrics.recall_set(*c, 5), metrics.r_precision(*c), metrics.hit_at_1(*c)) == (0.0, None, None, None)


def test_joint_goldens(spark):
    details = spark.createDataFrame([("1", ["A", "B"], list("ABCDE")), ("2", ["A", "B"], list("ACDEF")), ("3", ["A", "B"], list("ABCDE")), ("4", [], ["A"]), ("5", ["A"], ["A"])], "id string, g array<string>, r array<string>")
    scores = spark.createDataFrame([("1", 1.0), ("2", 0.1), ("3", 0.0)], "id string, accuracy double")
    r = metrics.joint_report(details, scores, "id", "g", "r", (5,)).first()
    assert (r["strict_at_5"], r["partial_at_5"], r["with_gt"], r["empty_gt"], r["missing_answer"]) == (pytest.approx(1 / 3), pytest.approx(0.5), 3, 1, 1)


@pytest.mark.parametrize("gt,ranked,k,want", [("xy", "abxcd", 4, "abxy"), ("y", "ab", 5, "ay"), ("xyz", "ab", 2, "xyz"), ("", "abc", 2, "ab"), ("ab", "", 3, "ab"), ("a", "aab", 2, "aa")])
def test_pool_goldens(spark, gt, ranked, k, want):
    got = one(spark, "g array<string>, r array<string>", (list(gt), list(ranked)), ranking.pool(F.col("g"), F.col("r"), k))[0]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n,want", [(0, 0), (39, 1), (40, 2), (41, 2), (78, 3)])
def test_windows(spark, n, want):
    df = spark.range(1).select(ranking.window_count(F.lit(n)).alias("w"), F.lit(n).alias("n"))
    assert df.first()["w"] == want
    if n:
        rows = spark.range(1, n + 1).select(F.explode(ranking.windows_of(F.col("id"), F.lit(n))).alias("w"), "id").groupBy("w").agg(F.min("id"), F.max("id")).orderBy("w").collect()
        assert [tuple(r) for r in rows] == [(w, w * 38 + 1, min(n, w * 38 + 40)) for w in range(want)]


def test_long_stream_windows(spark, rows):
    df = spark.range(100).select("id", (100 - F.col("id")).alias("t"))
    got = rows(memory.numbered_windows(df, ["t"]).groupBy("window").agg(F.count(F.lit(1)), F.min("t"), F.max("t")))
    assert got == [(0, 40, 1, 40), (1, 40, 39, 78), (2, 24, 77, 100)]


def test_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(1650))
    got = one(spark, "t string", (text,), ranking.chunks(F.col("t")))[0]
    assert [(c["i"], c["chunk"]) for c in got] == [(0, text[:800]), (1, text[700:1500]), (2, text[1400:])]
    assert [c["chunk"] for c in one(spark, "t string", ("ab",), ranking.chunks(F.col("t")))[0]] == ["ab"]
    assert one(spark, "t string", ("",), ranking.chunks(F.col("t")))[0] == []


def test_dense_index(spark):
    rng = random.Random(2)
    data = [(rng.randrange(50), i) for i in range(500)]
    got = corpus.dense_index(spark.createDataFrame(data, "a bigint, b bigint").repartition(7), [F.col("a"), F.col("b")]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["idx"])] == sorted(data) and sorted(r["idx"] for r in got) == list(range(500))
    assert corpus.dense_index(spark.createDataFrame([], "a bigint"), [F.col("a")]).collect() == []


@pytest.mark.parametrize("path,want", [("a/b.c.jpg", "b.c"), ("a/.hid", ".hid"), ("x", "x"), ("/a/b/", "b"), ("a.", "a.")])
def test_stem(spark, path, want):
    assert one(spark, "p string", (path,), corpus.stem(F.col("p")))[0] == want


def test_corpus(spark, rows):
    mails = spark.createDataFrame([(0, "e1", "t", None, "Hello\nSubject: Old boat \nx", None), (1, "", "t", "s", "d", "k")], "ord bigint, id string, timestamp string, short_summary string, detail string, subject string")
    images = spark.createDataFrame([(0, "p/i.1.jpg", None, "", "Rome", ["a", "b"]), (1, None, "t", "L", None, None)], "ord bigint, image_path string, timestamp string, location_name string, location string, tags array<string>")
    got = corpus.build_items(mails, images, None).orderBy("src", "ord").collect()
    assert [(r["item_id"], r["modality"], r["metadata"].get("subject"), r["metadata"]["location"]) for r in got] == [("e1", "email", "Old boat", ""), ("i.1", "image", None, "Rome")]
    assert got[0]["text"] == "ID: e1\nTimestamp: t\nSummary: \nDetail: Hello\nSubject: Old boat \nx"
    assert got[1]["text"].splitlines() == ["ID: i.1", "Type: image", "Timestamp: ", "Location: ", "Short Caption: ", "Caption: ", "OCR: ", "Tags: a, b"]
    row = {c: F.col(c) for c in images.columns} | {"short_caption": F.lit("sc"), "caption": F.lit(None), "ocr_text": F.lit("o")}
    assert rows(images.where("ord = 0").select(corpus.media_passage(F.lit("i"), row, 3))) == [("i | Unknown | Rome\nsc\nTags: a, b\nOCR: o",)]


def test_evidence_texts(spark, rows):
    asked = spark.createDataFrame([("q", ["b", "x", "a", "b", None, ""]), ("n", None), ("z", ["x"])], "id string, ids array<string>")
    s1, s2 = (spark.createDataFrame(d, "id string, text string") for d in ([("a", "A1")], [("a", "A2"), ("b", "B2")]))
    assert rows(corpus.evidence_texts(asked, "id", "ids", [s1, s2])) == [("n", []), ("q", ["B2", "A1"]), ("z", [])]
    assert rows(spark.createDataFrame([(["x", None],), (None,)], "c array<string>").select(corpus.numbered(F.col("c")))) == [("",), ("Evidence 1:\nx\nEvidence 2:\n",)]


def test_lookups(spark, rows):
    df = spark.createDataFrame([("a", 1, "x", {"k": "1"}), ("a", 2, None, {"k": "2"}), (None, 1, "n", None), (None, 0, "o", None)], "id string, ord bigint, v string, m map<string,string>")
    assert rows(lookups.last_by_key(df, ["id"], ["ord"])) == sorted([("a", 2, None, {"k": "2"}), (None, 1, "n", None)], key=repr)
    assert rows(lookups.first_by_key(df.drop("m"), ["id"], ["ord"])) == sorted([("a", 1, "x"), (None, 0, "o")], key=repr)
    done = df.where("id = 'a'")
    assert rows(lookups.pending(df.drop("m"), done)) == sorted([(None, 1, "n"), (None, 0, "o")], key=repr)
    assert lookups.same_ids(df, df.limit(4), "id") and not lookups.same_ids(df, done, "id")
    notes = spark.createDataFrame([("n1", 0, ["n2", "9", None]), ("n2", 1, ["n1", "1"]), ("n3", 2, None)], "id string, no bigint, links array<string>")
    edges = lookups.resolve_links(notes, "id", "links", "no")
    assert rows(edges) == [("n1", "n2"), ("n2", "n1"), ("n2", "n2")]
    hits = spark.createDataFrame([("q", "n1", 1)], "q string, i string, r int")
    assert rows(lookups.expand_links(hits, edges, "q", "i", "r")) == [("q", "n1", 1, False), ("q", "n2", 2, True)]
    entries = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["zz"]), (3, None)], "entry_id int, source_ids array<string>")
    side = spark.createDataFrame([(2, ["s"])], "entry_id int, item_ids array<string>")
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "item_id string")
    out = lookups.attribute(entries, known, side)
    assert rows(out) == [(1, ["a", "b"], "source"), (2, ["s"], "side"), (3, [], "none")]
    e = spark.createDataFrame([(1, "the wooden bridge near gardens"), (2, "about m77 only"), (3, "nothing")], "entry_id int, text string")
    i = spark.createDataFrame([("m5", "Wooden bridge in the gardens"), ("m6", "wooden bridge"), ("m77", "short")], "item_id string, text string")
    assert rows(lookups.attribute_by_words(e, i)) == [(1, "m5", 3), (2, "m77", 100)]


def test_items_by_words_without_pairs(spark, rows, monkeypatch):
    """Against counting every pair, in one block and in several; no table of words or pairs is broadcast, whatever its estimate."""
    rng = random.Random(3)
    pool = [f"common{i}" for i in range(12)] + ["tiny", "ß", "Words9"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(f"i{k:03d}", text(rng.randrange(9))) for k in range(150)] + [("I900", "common1 common2 common3"), ("x-1", None)]
    entries = [(k, text(rng.randrange(12))) for k in range(200)] + [(900, "see I900, i005 or x-1"), (901, None), (902, "")]
    long = lambda t: list(dict.fromkeys(w for w in re.findall(r"\w+", (t or "").lower()) if len(w) >= 6))
    want = []
    for k, t in entries:
        seen = set(long(t))
        scored = [(-len(seen & set(long(x)[:8])), i) for i, x in items] + [(-100, i) for i, _ in items if i.lower() in re.findall(r"\w+", (t or "").lower())]
        best = min((s for s in scored if s[0] <= -2), default=None)
        want += [(k, best[1], -best[0])] if best else []
    e, i = spark.createDataFrame(entries, "entry_id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    for most in (200_000, 20):
        monkeypatch.setattr(lookups, "MOST_SETS", most)
        out = lookups.attribute_by_words(e, i)
        assert rows(out) == sorted(want, key=repr)
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(lookups.attribute_by_words(e, i.where("item_id = ''"))) == []


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 5)), 1)
    x[7] = x[8]
    x[9] = 0
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (999, None)]
    items = spark.createDataFrame(data, "i bigint, v array<float>").repartition(5)
    q = items.where("i % 20 = 0").withColumnRenamed("i", "q")
    n = np.float32(x).astype(float)
    n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
    want = {(a, r + 1): (b, s) for a in range(0, 300, 20) for r, (s, b) in enumerate(sorted(((float(n[a] @ n[b]), b) for b in range(300) if b != a), key=lambda t: (-t[0], t[1]))[:7])}
    for limit in (vectors.QUERY_BYTES, 100):
        old, vectors.QUERY_BYTES = vectors.QUERY_BYTES, limit
        got = {(r["q"], r["rank"]): (r["i"], r["score"]) for r in vectors.top_k(q, items, "q", "i", "v", 7, skip_self=True).collect()}
        vectors.QUERY_BYTES = old
        assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert vectors.top_k(q.where("q < 0"), items, "q", "i", "v", 3).collect() == []


def test_rerank(spark, rows):
    df = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("abcde")], "q string, i string, r int")
    out = vectors.rerank(df, "q", "i", "r", lambda f: np.where(f["i"] == "c", 2.0, 1.0), 3, ["i"])
    assert "".join(r["i"] for r in out.orderBy("rerank_rank").collect()) == "cabde"
    assert "".join(r["i"] for r in vectors.rerank(df, "q", "i", "r", None, 3, []).orderBy("rerank_rank").collect()) == "abcde"


def test_embedding(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = [r["embedding"] for r in vectors.embed(df, "t", lambda s: np.array([[len(x), 0.0] for x in s])).collect()]
    assert got == [[1.0, 0.0], [0.0, 0.0]]


def test_bm25_in_blocks(spark, rows):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij kl".split())
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(9)))) for i in range(60)] + [(99, None)], "d bigint, t string").repartition(3)
    qs = spark.createDataFrame([(i, f"{word()} {word()} {word()} zz") for i in range(7)] + [(8, None), (9, "zz")], "q bigint, t string")
    want = rows(lexical.top_scores(lexical.bm25(qs, "q", "t", docs, "d", "t"), "q", "d", 4).select("q", "d", "score", "rank"))
    for most in (lexical.MOST_CELLS, 10):
        old, lexical.MOST_CELLS = lexical.MOST_CELLS, most
        got = rows(lexical.bm25_top(qs, "q", "t", docs, "d", "t", 4))
        lexical.MOST_CELLS = old
        assert got == want
    assert rows(lexical.bm25_top(qs, "q", "t", docs.where("d < 0"), "d", "t", 4)) == []


def test_hybrid_against_all_pairs(spark, rows, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice("ab cd ef gh ij kl".split())
    vec = lambda: [float(rng.randrange(-3, 4)) for _ in range(3)]
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(9))), vec()) for i in range(50)] + [(90, None, vec()), (91, "ab", None)], "d bigint, t string, v array<double>").repartition(3)
    qs = spark.createDataFrame([(i, f"{word()} {word()}", vec()) for i in range(6)] + [(8, "zz", vec()), (9, None, vec())], "q bigint, t string, v array<double>")
    used = docs.where("v is not null and t is not null")
    lex = {(r["q"], r["d"]): r["score"] for r in lexical.bm25(qs, "q", "t", used, "d", "t").collect()}
    cos = {(r["q"], r["d"]): r["c"] for r in qs.where("t is not null").crossJoin(used.select("d", F.col("v").alias("w"))).select("q", "d", vectors.cosine(F.col("v"), F.col("w")).alias("c")).collect()}
    for scaled in (True, False):
        want = []
        for q in sorted({k[0] for k in cos}):
            score = {d: lex.get((q, d), 0.0) for x, d in cos if x == q}
            low, high = min(score.values()), max(score.values())
            part = lambda s: ((s - low) / (high - low + 1e-6) if high > low else 0.0) if scaled else s  # noqa: E731, B023
            best = sorted((-round(0.5 * part(s) + 0.5 * cos[q, d], 6) + 0.0, d) for d, s in score.items())[:4]
            want += [(q, d, -s + 0.0, i + 1) for i, (s, d) in enumerate(best)]
        for most in (4_000_000, 12):
            monkeypatch.setattr(lexical, "MOST_CELLS", most)
            got = lexical.hybrid_top(qs, "q", "t", "v", docs, "d", "t", "v", 4, scaled=scaled)
            assert [r[:3] for r in rows(got.select("q", "rank", "d"))] == sorted((q, n, d) for q, d, _, n in want)
            assert [r[2] for r in rows(got.select("q", "rank", "score"))] == pytest.approx([s for _, _, s, _ in want], abs=2e-6)


def test_usage_goldens(spark):
    def total(records):
        rows = [("r", i, g, t, t, t, None) for i, (g, t) in enumerate(records)]
        df = spark.createDataFrame(rows, "run string, n bigint, group_id string, input_tokens bigint, output_tokens bigint, total_tokens bigint, cost_usd double")
        r = usage.total_usage(df, ["run"], ["n"]).first()
        return r["total_tokens"], r["records_selected"]

    assert total([("g", 10), ("g", 30), ("g", 20)]) == (30, 1)
    assert total([(None, 10), (None, 20), (None, 30)]) == (30, 1)
    assert total([(None, 30), (None, 10), (None, 30)]) == (40, 2)
    assert total([("g", None), ("h", 5)]) == (5, 2)
    assert total([("g", None)]) == (None, 1)
    assert total([(None, 100), (None, 10)]) == (110, 2)


def test_usage_objects_and_fields(spark):
    events = [
        {"id": " x ", "usage": {"input_tokens": 10, "output_tokens": "5", "cache_read_input_tokens": 3}, "cost_usd": True},
        {"message": {"id": "m", "usage": {"input_tokens": 100, "output_tokens": 7, "cached_input_tokens": 40, "total_cost_usd": "0.5"}}},
        {"part": {"tokens": {"total": 30, "input": 10, "output": 6, "reasoning": 4, "cache": {"read": 8, "write": 2}}}},
        {"a": [{"promptTokens": 4.9, "completionTokens": 1}]},
        {"x": 1},
    ]
    df = spark.createDataFrame([("r", i, json.dumps(e)) for i, e in enumerate(events)] + [("r", 9, "{bad"), ("r", 10, None)], "run string, seq int, event string")
    got = {r["seq"]: r for r in usage.usage_records(df, ["run"], "seq", "event").collect()}
    fields = lambda r: (r["group_id"], r["input_tokens"], r["uncached_tokens"], r["cache_read_tokens"], r["output_tokens"], r["total_tokens"], r["cost_usd"])
    assert fields(got[0]) == ("x", 13, 10, 3, 5, 18, None)
    assert fields(got[1]) == ("m", 100, 60, 40, 7, 107, 0.5)
    assert fields(got[2]) == (None, 20, 10, 8, 10, 30, None)
    assert fields(got[3]) == (None, 4, 4, None, 1, 5, None)
    assert set(got) == {0, 1, 2, 3}


def test_final_answers(spark, rows):
    tool = {"message": {"content": [{"type": "text", "text": "hm"}, {"type": "tool_use", "name": "S", "input": {"id": "1", "answer": "A"}}]}}
    runs = {
        "tool": [tool, {"type": "result", "subtype": "success", "result": "B"}],
        "result": [{"role": "assistant", "content": "x"}, {"type": "result", "subtype": "success", "result": "B"}, {"type": "result", "subtype": "error", "result": "C"}],
        "text": [{"message": {"role": "assistant", "content": [{"type": "text", "text": "one"}, "two"]}}, {"type": "text", "part": {"text": " "}}],
        "file": [{"part": {"state": {"input": {"filePath": "/w/output/answer.json", "content": "{}"}}}}, {"type": "text", "part": {"text": "later"}}],
        "none": [{"type": "x"}],
    }
    df = spark.createDataFrame([(k, i, json.dumps(e)) for k, es in runs.items() for i, e in enumerate(es)], "run string, seq int, event string")
    assert rows(usage.final_answers(df, ["run"], "seq", "event")) == [("file", "{}", "file"), ("result", "B", "result"), ("text", "one\ntwo", "text"), ("tool", '{"answer":"A","id":"1"}', "structured")]


def test_json_in_text():
    assert jsontext.first_object('x {"a": "}", "b": {"c": 1}} {') == '{"a": "}", "b": {"c": 1}}'
    assert jsontext.first_object("{ open") is None and jsontext.first_object(None) is None
    assert jsontext.balanced('[1, "]", [2]] x', 0) == '[1, "]", [2]]'
    assert jsontext.first_object('{"a": "}"}', aware=False) == '{"a": "}'
    assert jsontext.memory_entries('```json\n[{"a": 1}]\n```') == ['{"a": 1}']
    assert jsontext.memory_entries('{"entries": [1, 2]}') == ["1", "2"]
    assert jsontext.memory_entries('oops {"lossless_restatement": "x"} , {"other": 1}') == ['{"lossless_restatement": "x"}']
    assert jsontext.memory_entries("nothing") is None
    assert jsontext.critic_fields('```\n{"final_answer": ["a", "b"], "support": "Partially so", "utility": "9"}\n```') == ("a, b", "partially", 5)
    assert jsontext.critic_fields('text {"answer": " x ", "grounding": "contradicts", "utility": "?"}') == ("x", "none", None)
    assert jsontext.critic_fields(None) == (None, None, None)
    assert jsontext.html_text("<p>a<script>b</script>  c<!-- d --><br>e</p>") == "a c e"
    assert jsontext.html_text("x" * 60_000) == "x" * 50_000 + "..."
    head = "<table><tr><td>From:</td><td>Ann</td></tr></table><b>Subject:</b> Boat<title>T</title><p>Date: now</p>"
    assert jsontext.html_headers(head) == {"sender": "Ann", "subject": "Boat", "date": "now"}


def test_judge_and_critic_columns(spark):
    texts = ['{"accuracy": true, "explanation": "e"}', "It is incorrect", '"accuracy": false', "no idea", '{"accuracy": 0.5}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0]["accuracy"] for r in df.select(jsontext.judge_verdict(F.col("t"))).collect()] == [1.0, 1.0, 0.0, 0.0, 0.5]
    assert df.select(jsontext.judge_verdict(F.col("t"), literal=False)).collect()[1][0]["accuracy"] == 0.0
    c = spark.createDataFrame([("d", '{"support": "none"}'), ("d", '{"support": "fully", "answer": "f"}'), ("d", "junk")], "a string, t string")
    assert [r[0] for r in c.select(jsontext.critic_answer(F.col("a"), jsontext.critic(F.col("t")))).collect()] == ["Unknown", "f", "d"]


@pytest.mark.parametrize(
    "function,text,want",
    [
        (formats.gps_pair, "+52.2006-000.1184/", [52.2006, -0.1184]),
        (formats.gps_pair, "+95.0+000.1/", None),
        (formats.mail_address, "Ann <a@b.c>", "a@b.c"),
        (formats.mail_address, "a@b.c (Ann)", "a@b.c"),
        (formats.sender_name, '"Ann B" <a@b.c>', "Ann B"),
        (formats.sender_name, "a@b.c (Ann)", "Ann"),
        (formats.sender_name, "ann.b_c@x.y", "Ann B C"),
        (formats.mail_headers, "Subject: a\r\n b\r\nFrom: x\r\nFROM: y\r\n\r\nTo: z", {"subject": "a b", "from": "y"}),
        (formats.mail_body, "A: b\n\nx  y\n\nz", "x y z"),
        (formats.tag_list, " A, b,, C ", ["a", "b", "c"]),
        (formats.tag_set, "Zed, a, bb, bb", ["bb", "zed"]),
        (formats.bracket_id, "x [ab] [c]", "ab"),
        (formats.source_ids, "[SOURCE_ID: a, b] [source_id: b;c]", ["a", "b", "c"]),
        (formats.source_ids, "[x] y", ["x"]),
        (formats.source_ids, "none", []),
        (formats.id_line, "a\nID: 7 \nb", "7"),
        (formats.bare_evidence_id, "Image_20", "20"),
        (formats.attachments, "see attached: plan.pdf\nfile: x", ["plan.pdf"]),
        (formats.day_key, "2021:02:03 04:05:06", "2021-02-03"),
        (formats.day_key, "", "unknown"),
        (formats.day_key, "soon", None),
        (formats.clean_text, " a\x00  b\n", "a b"),
    ],
)
def test_formats(spark, function, text, want):
    assert one(spark, "t string", (text,), function(F.col("t")))[0] == want


def test_mail_dates(spark):
    texts = ["5/10/2024, 2:46 PM", "2024-05-10 14:46:00", "10 May 2024 14:46:00", "Fri, 10 May 2024 14:46:00", "2024-05-10T14:46:00", "Fri, 10 May 2024 14:46:00 +0200 (CEST)"]
    df = spark.createDataFrame([(t,) for t in texts] + [("2024-05-10",), ("x",), (None,)], "t string")
    got = [str(r[0]) for r in df.select(formats.mail_date(F.col("t"))).collect()]
    assert got == ["2024-05-10 14:46:00"] * 6 + ["2024-05-10 00:00:00", "None", "None"]


def test_durations(spark):
    df = spark.createDataFrame([(-1.0,), (9.0,), (187.5,), (3900.0,), (90000.0,)], "s double")
    s = F.col("s")
    assert [tuple(r) for r in df.select(formats.duration_compact(s), formats.eta(s)).collect()] == [("0s", "unknown"), ("9s", "9s"), ("3m07s", "3.1m"), ("1h05m", "1.1h"), ("25h00m", "1.0d")]
    assert [r[0] for r in df.where("s > 0").select(formats.duration_words(s)).collect()] == ["9.0s", "3m 7s", "1h 5m", "25h 0m"]
    assert [r[0] for r in df.limit(3).select(ranking.frame_times(s, 2)).collect()] == [[0.0], [3.0, 6.0], [62.5, 125.0]]
    assert one(spark, "d int", (1,), formats.degrees(F.lit(10), F.lit(30), F.lit(36.0), F.lit("s")))[0] == pytest.approx(-10.51)


def test_entities(spark):
    df = spark.createDataFrame([("- Ann: person\nno line\nRome: place\nann: person",)], "t string")
    e = formats.entity_lines(F.col("t"))
    assert [tuple(x) for x in df.select(formats.first_entities(e)).first()[0]] == [("Ann", "person"), ("Rome", "place")]


def test_summaries(spark, rows):
    df = spark.createDataFrame([(1, "2021:01:02 03:04:05", "x", ["b", "a"], None, 2.0), (2, None, " ", ["a", "c"], "bad", 9.0), (3, "junk", None, None, "", 1.0)], "n int, timestamp string, ocr_text string, tags array<string>, error string, duration double")
    r = summaries.media_summary(df).first()
    assert (r["total"], r["failed"], r["with_text"], str(r["earliest"]), r["duration"], r["success_rate"]) == (3, 1, 1, "2021-01-02 03:04:05", 3.0, pytest.approx(2 / 3))
    assert [tuple(x) for x in summaries.top_tags(df, "tags", "n").collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert rows(summaries.by_day(df, "timestamp", "n")) == [("2021-01-02", 1), ("unknown", 1)]
    m = spark.createDataFrame([("success", "2021-01-01", "a, b"), ("success", "2021-01-03 12:00:00", "a"), ("error", "1999-01-01", "z")], "status string, timestamp string, classification string")
    r = summaries.mail_summary(m).first()
    assert (r["total"], r["success"], r["errors"], r["span_days"]) == (3, 2, 1, 2)
    assert rows(summaries.categories(m)) == [("a", 2), ("b", 1)]
    rep = spark.createDataFrame([("m", "text", 25, "j", "number", 0.123), ("m", "text", 25, "j", "all", 0.5)], "model string, mode string, k int, judge string, qtype string, accuracy double")
    lines = [r["text"] for r in summaries.markdown(summaries.run_report(rep)).orderBy("line").collect()]
    assert lines == ["| model | mode | k | judge | number | list_recall | open_end | all |", "|---|---|---|---|---|---|---|---|", "| m | text | 25 | j | 12.3 |  |  | 50.0 |"]


def test_makers_retry_and_fail_alone(spark, rows):
    def maker(f):
        if (f["item_id"] == "bad").any():
            raise ValueError("no")
        return f.assign(note=f["text"].where(f["text"] != "", None))

    items = spark.createDataFrame([("a", "x"), ("bad", "y"), ("c", ""), ("d", "z")], "item_id string, text string").coalesce(1)
    done = spark.createDataFrame([("d",)], "item_id string")
    assert rows(memory.index_items(items, done, maker, "note string")) == [("a", "x", "success", None), ("bad", None, "failed", "no"), ("c", None, "empty", None)]
    seen = memory.ingest_in_order(items, ["text", "item_id"], [], lambda s, r: s + [r["item_id"]])
    assert seen == ["c", "a", "bad", "d"]
    w = memory.dialogue_windows(items.withColumn("s", F.lit("s")), "s", ["item_id"], 3, 1)
    out = memory.distil(w, "s", "text", lambda f: f.assign(entry=f["text"].str.replace("\n", "+")), "entry string")
    assert rows(out.select("window_id", "entry")) == [("s/0", "x+y+"), ("s/1", "+z")]


def test_streams_agree_with_batches(spark, rows, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(200).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 3).cast("int"))).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    df.repartition(3).write.parquet(src)
    ev.write_batches(ev.event_stream(spark, src), out, str(tmp_path / "c1")).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(df)
    ev.write_batches(ev.event_stream(spark, src), out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 200
    assert ev.window_counts(df).agg(F.sum("events")).first()[0] == 200
    assert ev.sessions(df).count() == 3
