"""Nulls, empty and very long texts, repeated rows, ties, empty tables and columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import chat, lm, minhash, quality, toxicity, warc

SF = "/root/testdata/sf0.001"
LONG = "plain words of a very long text " * 60_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def odd_rows(spark, *clashing):
    """Odd texts in rows of (doc_id, text) and columns of the given names."""
    rows = [(1, None), (2, ""), (3, " \n"), (4, "same text here"), (4, "same text here"), (None, "same text here"), (5, LONG)]
    schema = "doc_id long, text string" + "".join(f", {c} string" for c in clashing)
    return spark.createDataFrame([(*r, *(c for c in clashing)) for r in rows], schema)


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    odd = spark.createDataFrame([(None, 1), (0, None), (10**9, 1)], "doc_id long, toxic int").withColumn("toxic", F.col("toxic").cast(labels.schema["toxic"].dataType))
    once, more = (toxicity.score(odd_rows(spark, "score", "predicted", "passages", "e_value"), toxicity.train(docs, x)).collect() for x in (labels, labels.union(odd)))
    assert [tuple(r) for r in once] == [tuple(r) for r in more]  # labels without id, value or document tell nothing
    assert len(once) == 7 and len({r["score"] for r in once[:3]}) == 1 and all(0 <= r["score"] <= 1 for r in once)
    assert len({r["score"] for r in once[3:6]}) == 1 and {r["e_value"] for r in once} == {"e_value"}
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in once)
    repeated = toxicity.score(docs, toxicity.train(docs, labels.union(labels)))
    assert repeated.count() == docs.count()
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.train(none, labels)).collect() == []


def test_quality(spark, docs):
    got = quality.score(odd_rows(spark, "quality", "good", "pattern"), quality.train(docs)).collect()
    assert len(got) == 7 and [r["quality"] for r in got[:3]] == [0, 0, 0] and not any(r["good"] for r in got[:3])
    assert len({r["quality"] for r in got[3:6]}) == 1 and {r["pattern"] for r in got} == {"pattern"}
    assert all(r["good"] == (r["quality"] >= 0.5) for r in got)
    # Every row may be repeated: the counts of patterns double, the classes stay.
    a, b = (quality.score(docs, quality.train(x)).collect() for x in (docs, docs.union(docs)))
    assert sum(x["good"] != y["good"] for x, y in zip(a, b, strict=True)) <= len(a) // 100
    assert quality.score(docs.limit(0), quality.train(docs)).collect() == []


def test_lm(spark):
    rows = odd_rows(spark, "difference", "n_words", "key", "bucket")
    m = lm.train(rows)
    got = lm.score(rows, m, m).collect()
    told = {r["doc_id"] or 0: (r["n_words"], r["background_loss"]) for r in got}
    assert len(got) == 7 and {r["key"] for r in got} == {"key"} and all(r["difference"] in (None, 0) for r in got)
    assert told[1] == told[2] == told[3] == (0, None) and told[0] == told[4] and told[5][0] == 420_000
    none = rows.limit(0)
    assert len(lm.score(rows, lm.train(none), lm.train(rows)).collect()) == 7


def test_chat(spark):
    rows = [(1, 0, "user", LONG, "x"), (1, 1, "assistant", None, "x"), (2, 0, "assistant", "", "y"), (3, 5, "assistant", f"{chat.TURN_END}\\{chat.TURN_START}", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.events_of(table)))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", LONG), ("assistant", "")]
    assert [list(got[c]["loss_texts"]) for c in (1, 2, 3)] == [[""], [""], [rows[3][3]]]
    assert chat.read_back(chat.render(chat.fold(chat.events_of(table.limit(0))))).collect() == []


def test_minhash(spark):
    rows = odd_rows(spark, "component", "sketch", "key", "rep").union(odd_rows(spark, "component", "sketch", "key", "rep").where("doc_id = 5").withColumn("doc_id", F.lit(6).cast("long")))
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect())
    assert got == [(0, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 5, True), (6, 5, False)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, LONG, "a"), (7, "u", LONG, "b"), (3, "u", "x" * 1000, "c"), (4, "u", "x" * 999, "d"), (5, "u", "x" * 999, "e")], "page_id long, url string, html string, type string")
    path = str(tmp_path / "w")
    warc.write(pages, path, warc.shared_payloads(pages))
    kept = ["record_id", "type", "block"]
    whole = warc.reassemble(warc.read(spark, path, True))
    assert all(r["complete"] for r in whole.select("complete").collect())
    back = warc.payload(warc.read(spark, path, False).select(*kept).union(whole.select(*kept))).collect()
    got = {warc_id(r["record_id"]): (r["type"], None if r["type"] == "revisit" else hashlib.sha1(r["payload"]).hexdigest()) for r in back}
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert got == {1: ("revisit", None), 7: ("response", sha(LONG)), 3: ("response", sha("x" * 1000)), 4: ("response", sha("x" * 999)), 5: ("response", sha("x" * 999))}


def warc_id(urn):
    return int(urn.strip("<>").split(":")[2])
