import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keepsake.sources import readers as R
from keepsake.sources import sinks as S


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_question_lists(spark, rows, tmp_path):
    qas = [{"id": "1", "question": "q", "answer": "a", "evidence_ids": ["e"], "extra": 1}, {"id": "2"}]
    for name, data in (("plain", qas), ("wrapped", {"qas": qas})):
        got = R.qa_list(spark, put(tmp_path / f"{name}.json", data))
        assert rows(got.select("ord", "id", "answer", "evidence_ids")) == [(0, "1", "a", ["e"]), (1, "2", None, None)]
    with pytest.raises(PySparkException):
        R.qa_list(spark, put(tmp_path / "bad.json", {"other": 1})).collect()


def test_json_lines(spark, rows, tmp_path):
    p = put(tmp_path / "x.jsonl", '{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert rows(R.json_lines(spark, p, "a int", strict=False)) == [(1,), (2,)]
    with pytest.raises(Exception, match="(?s)FAILED_READ_FILE|MALFORMED"):
        R.json_lines(spark, p, "a int").collect()
    assert rows(R.json_lines(spark, str(tmp_path / "absent"), "a int", strict=False)) == []


def test_traces_and_recovery(spark, rows, tmp_path):
    put(tmp_path / "t" / "a.jsonl", '{"n": 1}\n\n{"n": 2}')
    ev = R.trace_events(spark, str(tmp_path / "t"))
    assert rows(ev.select("seq", F.try_variant_get("v", "$.n", "int"))) == [(0, 1), (2, 2)]
    put(tmp_path / "r" / "x.json", 'log {"n": 3} tail')
    put(tmp_path / "r" / "y.json", "nothing")
    assert rows(R.json_with_recovery(spark, str(tmp_path / "r")).select(F.try_variant_get("v", "$.n", "int"))) == [(3,), (None,)]


def test_existing_results(spark, rows, tmp_path):
    p = put(tmp_path / "e.json", [{"id": "1", "v": 1}, {"id": "1", "v": 2}, {"v": 3}])
    assert rows(R.existing_results(spark, p, "id string, v int")) == [("1", 2)]
    assert rows(R.existing_results(spark, str(tmp_path / "no"), "id string, v int")) == []


def test_files(spark, rows, tmp_path):
    for name in ("a.JPG", "sub/b.png", "c.txt", "m.eml", "n.html", "o.msg"):
        put(tmp_path / "f" / name, "x")
    got = R.files(spark, str(tmp_path / "f"), (".jpg", ".png"), content=False)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.collect()) == ["a.JPG", "b.png"]
    mails = R.mail_files(spark, str(tmp_path / "f"))
    assert rows(mails.where("kind <> 'msg'").select("kind", "text")) == [("eml", "x"), ("html", "x")]
    with pytest.raises(PySparkException):
        mails.select("text").collect()
    items = spark.createDataFrame([("gone/a.heic",), ("no",)], "image_path string")
    listing = got.select(F.regexp_replace("path", "^.*/", "").alias("path"))
    assert rows(R.media_files_of(items, "image_path", listing, [".png", ".jpg"])) == [("gone/a.heic", "a.JPG"), ("no", None)]


def test_runs_and_reports(spark, rows, tmp_path):
    ids = R.question_ids(spark, put(tmp_path / "ids.txt", " q1 \n\nq2\nq3\n"))
    put(tmp_path / "runs/t/a/m/q1/output/answer.json", {"id": "q1", "question": "x", "answer": "y"})
    put(tmp_path / "runs/t/a/m/q2/output/answer.json", "{broken")
    got = R.collect_runs(spark, ids, str(tmp_path / "runs"), "t", "a", "m")
    assert rows(got.select("id", "status", "found_answer")) == [("q1", "collected", "y"), ("q2", "malformed", None), ("q3", "missing", None)]
    assert rows(R.collect_runs(spark, ids, str(tmp_path / "none"), "t", "a", "m").groupBy("status").count()) == [("missing", 3)]
    put(tmp_path / "rep/M/text/niah25/J/atm_x_summary.json", {"accuracy": 0.5, "by_qtype": {"number": {"count": 1, "accuracy": 0.25}, "odd": 3}})
    put(tmp_path / "rep/M/text/other/J/atm_x_summary.json", {"accuracy": 0.5})
    put(tmp_path / "rep/M/text/niah25/J/else.json", {"accuracy": 0.5})
    got = R.report_files(spark, str(tmp_path / "rep")).drop("path")
    assert rows(got) == [("M", "text", 25, "J", "all", 0.5), ("M", "text", 25, "J", "number", 0.25)]


def test_store_probe(spark, rows):
    meta = spark.createDataFrame([(1, "item_id", "a"), (1, "data", "x"), (2, "item_id", "b"), (3, "item_id", ""), (3, "data", "y"), (4, "item_id", "c"), (4, "data", "")], "id int, key string, string_value string")
    assert rows(R.stored_ids(meta)) == [("a",)]


def test_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([("1", 1), ("2", 2)], "id string, v int")
    p = str(tmp_path / "lines")
    S.write_lines(df, p)
    S.write_lines(df.limit(1), p, append=True)
    assert R.json_lines(spark, p, "id string, v int").count() == 3
    S.write_document(df, str(tmp_path / "doc"))
    assert rows(R.json_document(spark, str(tmp_path / "doc"), "id string, v int")) == [("1", 1), ("2", 2)]
    u = str(tmp_path / "up")
    S.upsert(df, u)
    S.upsert(spark.createDataFrame([("2", 9), ("3", 3)], "id string, v int"), u)
    assert rows(S.read_upserted(spark, u)) == [("1", 1), ("2", 9), ("3", 3)]
    g = str(tmp_path / "prog")
    S.append_progress(spark.createDataFrame([("a", "success"), ("b", "failed")], "item_id string, status string"), g)
    S.append_progress(spark.createDataFrame([("a", "success"), ("c", "success")], "item_id string, status string"), g)
    assert rows(R.progress(spark, g)) == [("a",), ("c",)]
    S.rewrite_progress(spark.createDataFrame([("z",), ("z",)], "item_id string"), g)
    assert rows(R.progress(spark, g)) == [("z",)]
    m = str(tmp_path / "cache")
    S.merge_missing(df, m, "id")
    S.merge_missing(spark.createDataFrame([("2", 7), ("5", 5)], "id string, v int"), m, "id")
    assert rows(spark.read.parquet(m)) == [("1", 1), ("2", 2), ("5", 5)]


def test_vector_index_is_built_once(spark, tmp_path):
    calls = []

    def encode(df):
        calls.append(1)
        return df.withColumn("v", F.array(F.lit(1.0)))

    items = spark.createDataFrame([("a",)], "item_id string")
    p = str(tmp_path / "index")
    for _ in range(2):
        assert S.build_index(items, p, {"b": 1, "a": 2}, encode).count() == 1
    S.build_index(items, p, {"a": 2, "b": 1}, encode)
    assert len(calls) == 1
    S.build_index(items, p, {"a": 2, "b": 1}, encode, force=True)
    assert len(calls) == 2 and S.cache_key({"a": 1}) != S.cache_key({"a": 2})


def test_memory_variants(spark, rows, tmp_path):
    img = spark.createDataFrame([("x/i.jpg", "cap", "t")], "image_path string, caption string, timestamp string")
    vid = spark.createDataFrame([("y/v.mp4", "c2", "t")], "video_path string, caption string, timestamp string")
    i, v = S.memory_variant(img, vid, "raw")
    assert rows(i) == [("i", "images/i.jpg")] and rows(v) == [("v", "videos/v.mp4")]
    assert rows(S.memory_variant(img, vid, "descriptive")[0]) == [("i", "cap")]
    man = S.write_variant(img, vid, spark.createDataFrame([("m",)], "id string"), "Schema-Guided", str(tmp_path / "var"))
    assert rows(man) == [("sgm", 1, 1, 1)]
    with pytest.raises(ValueError):
        S.memory_mode("odd")
