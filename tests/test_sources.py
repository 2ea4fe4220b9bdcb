import json

from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.operators import annotators, dataset, profile
from lexiquarry.sources import readers, writers
from lexiquarry.streaming import files

E = "doc_id long, ord long, start int, end int, text string, type string, assertions array<string>, candidates array<string>"


def test_text_and_entity_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "10.txt").write_text("đau\nđầu", encoding="utf-8")
    (tmp_path / "in" / "2.txt").write_text("", encoding="utf-8")
    (tmp_path / "in" / "note.txt").write_bytes(b"\xef\xbb\xbfbad \xff byte")
    docs = readers.text_files(spark, str(tmp_path / "in"))
    assert [r["stem"] for r in readers.in_order(docs).collect()] == ["2", "10", "note"]
    assert {r["stem"]: r["text"] for r in docs.collect()}["10"] == "đau\nđầu"
    assert {r["stem"]: r["text"] for r in readers.text_files_any_encoding(spark, str(tmp_path / "in")).collect()} == {"10": "đau\nđầu", "2": "", "note": "bad � byte"}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "10.json").write_text(json.dumps([{"text": "đau", "position": [0, 3], "type": L.SYMPTOM}, {"text": "x", "position": None, "type": L.DRUG}]))
    (tmp_path / "e" / "2.json").write_text("broken")
    (tmp_path / "e" / "stats.json").write_text("[]")
    got = readers.entity_files(spark, str(tmp_path / "e")).orderBy("ord").collect()
    assert [(r["doc_id"], r["text"], r["start"], r["candidates"]) for r in got] == [(10, "đau", 0, []), (10, "x", None, [])]
    assert readers.entity_files(spark, str(tmp_path / "e"), docs).where("text is null").count() == 2
    (tmp_path / "e" / "note.json").write_text(json.dumps([{"text": "y", "position": [0, 1], "type": L.DRUG}]))
    placed = readers.entity_files(spark, str(tmp_path / "e"), docs)
    assert sorted((r["stem"], r["doc_id"], r["text"] or "") for r in placed.collect()) == [("10", 10, "x"), ("10", 10, "đau"), ("2", 2, ""), ("note", None, "y")]
    assert placed.columns == readers.entity_files(spark, str(tmp_path / "e")).columns
    assert readers.entity_files(spark, str(tmp_path / "e"), docs.select("doc_id", "text")).where("text = 'x'").count() == 1


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    e = spark.createDataFrame([(1, 0, 0, 1, "ă", L.DRUG, [], ["1"])], E)
    writers.export_entity_files(docs, e, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "1.json").read_text()) == [{"text": "ă", "position": [0, 1], "type": L.DRUG, "assertions": [], "candidates": ["1"]}]
    assert (tmp_path / "out" / "2.json").read_text() == "[]"
    writers.zip_folder(str(tmp_path / "out"), str(tmp_path / "out.zip"))
    assert (tmp_path / "out.zip").stat().st_size > 0
    writers.write_entity_files(docs, e, str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == 2
    assert [r["doc_id"] for r in readers.pending(docs, e).collect()] == [2]


def test_sqlite_dictionary(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table icd10 (code text, name_vi text)")
        db.executemany("insert into icd10 values (?, ?)", [("A", "x"), ("B", None), ("C", "")])
    got = readers.sqlite_dictionary(spark, str(tmp_path / "d.db"), "icd10", "code", "name_vi").collect()
    assert [(r["name"], r["code"], r["ord"]) for r in got] == [("x", "A", 0)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a b")
    run = lambda: files.run(files.read_texts(spark, str(tmp_path / "in")), lambda d: d.select("doc_id", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "2.txt").write_text("abc def")
    run()
    assert sorted((r["doc_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 3), (2, 7)]


def test_annotators(spark):
    docs = spark.createDataFrame([(1, "No aspirin, ASPIRIN 81; aspirins"), (2, None)], "doc_id long, text string")
    got = annotators.keywords(docs, {"aspirin": L.DRUG, "aspirin 81": L.DRUG}).orderBy("ord").collect()
    assert [(r["start"], r["text"]) for r in got] == [(3, "aspirin"), (12, "ASPIRIN 81")]
    assert annotators.annotate(docs, annotators.Mock).count() == 4


def test_conversations_and_split(spark):
    answer = json.dumps([{"text": "a", "type": L.DRUG, "position": [0, 1], "assertions": ["isNegated"], "candidates": ["1"]}])
    rows = [([("human", 'x """doc""" y'), ("gpt", answer)],), ([("human", "only")],), ([("human", "h"), ("gpt", "bad json")],)]
    c = spark.createDataFrame(rows, "conversations array<struct<from:string,value:string>>")
    got = [r["conversations"] for r in dataset.slim_conversations(c).collect()]
    assert json.loads(got[0][1]["value"]) == [{"text": "a", "type": L.DRUG, "assertions": ["isNegated"]}]
    assert got[1][0]["value"] == "only" and got[2][1]["value"] == "bad json"
    a, b = dataset.split(spark.range(1000), "id")
    assert a.count() + b.count() == 1000 and 60 < b.count() < 140


def test_profiles(spark):
    log = spark.createDataFrame([(i, float(v)) for i, v in enumerate([4, 3, 5, 1, 1])], "step long, loss double")
    r = profile.curve_stats(log, "step", "loss").first()
    assert (r["first_value"], r["last_value"], r["reduction_pct"], r["min_at"], r["max_at"], r["alert"]) == (4.0, 1.0, 75.0, 3, 2, False)
    assert [round(r["moving_avg"], 3) for r in profile.moving_average(log, ["step"], "loss", 3).orderBy("step").collect()] == [4.0, 3.0, 2.333]
    tags = spark.createDataFrame([([0, 1, 2, 3],)], "ner_tags array<int>")
    assert profile.entity_density(tags).first()["entities"] == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert profile.type_token_ratio(none).first()["ratio"] in (None, 0.0)


def test_annotator_failures_stay_with_their_document(spark):
    class Fails:
        """Fails on texts that say so, alone or in a batch."""

        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no such text")
            return [[{"text": t[:1], "type": L.DRUG, "position": [0, 1]}] if t else [] for t in texts]

    docs = spark.createDataFrame([(k, "bad" if k % 7 == 3 else f"text {k}") for k in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    found, failed = annotators.parted(annotators.annotate(docs, Fails, batch=5, isolate=True))
    bad = {k for k in range(40) if k % 7 == 3}
    assert {r["doc_id"]: r["error"] for r in failed.collect()} == {k: "ValueError: no such text" for k in bad}
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(set(range(40)) - bad)
    plain = annotators.annotate(docs.where("text <> 'bad'"), Fails)
    assert found.columns == plain.columns and found.schema.simpleString() == plain.schema.simpleString()
    assert found.exceptAll(plain).isEmpty()
    empty = annotators.annotate(docs.limit(0), Fails, isolate=True)
    assert empty.isEmpty()
