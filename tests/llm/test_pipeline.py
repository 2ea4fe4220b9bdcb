"""The stages of the pipeline against plain versions, on odd tables, and all of them in a row."""

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F
from test_minhash import brute, corpus

from lexiquarry.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.001"
#: The smallest tables on which documents are predicted toxic.
MORE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that have the names of what the stages work out.
CLASHING = ("good", "predicted", "score", "kept", "component_id", "stays", "rows", "rest", "item_id", "coverage", "ids", "decoded", "digest")


def table(spark, rows):
    """Documents of (doc_id, text) with clashing extra columns."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return docs.select("*", *(F.lit(c).alias(c) for c in CLASHING))


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("stage", [f for _, f in p.STAGES])
def test_empty_table(spark, stage):
    out = stage(spark, table(spark, []), SF)
    assert out.collect() == []
    assert stage is p.encode or out.columns == p.COLUMNS


def test_good_rows_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.score(docs, quality.train(docs)).where("good").collect()}
    assert {r["doc_id"] for r in p.keep_good(spark, docs, SF).collect()} == good
    some = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept, gone = next(r for r in some if r[0] in good), next(r for r in some if r[0] not in good)
    odd = [(-1, None), (-2, ""), (-3, " \n"), (None, kept[1]), kept, (-4, gone[1]), (-5, " ".join([kept[1]] * 2000))]
    got = rows(p.keep_good(spark, table(spark, some + odd), SF))
    assert got.count(kept) == 2 and (None, kept[1]) in got
    assert not {-1, -2, -3, -4} & {i for i, _ in got} and -5 in {i for i, _ in got}


def test_civil_rows_stay(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    labels = spark.read.parquet(f"{MORE}/labels.parquet").select("doc_id", "toxic")
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels.where(~toxicity.held_out()))).where("predicted = 1").collect()}
    some = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert toxic and {r["doc_id"] for r in p.keep_civil(spark, docs, MORE).collect()} == {i for i, _ in some} - toxic
    bad = next(r for r in some if r[0] in toxic)
    odd = [(-1, None), (-2, ""), (None, bad[1]), (-3, bad[1]), (-4, "plain words"), (-4, "plain words")]
    got = rows(p.keep_civil(spark, table(spark, some + odd), MORE))
    assert bad not in got and (None, bad[1]) not in got and -3 not in {i for i, _ in got}
    assert {(-1, None), (-2, "")} <= set(got) and got.count((-4, "plain words")) == 2


def test_one_of_each_group_stays(spark):
    some = corpus(11)
    first = {i: c for i, (_, c) in brute(some, 5, 80).items()}
    want = [(i, t) for i, t in some if first[i] == i]
    once, other = want[0], next((i, t) for i, t in some if first[i] != i)
    odd = [once, once, other, (None, once[1]), (None, None)]
    got = rows(p.keep_one_of_each(spark, table(spark, some + odd), SF))
    assert got == sorted([*want, (None, once[1]), (None, None)], key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_texts_of_one_id_are_judged_alone(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    near = b.replace("b59", "other")
    assert rows(p.keep_one_of_each(spark, table(spark, [(1, b), (5, a), (5, b)]), SF)) == [(1, b), (5, a)]
    assert rows(p.keep_one_of_each(spark, table(spark, [(1, near), (5, a), (5, b), (5, a), (9, a)]), SF)) == [(1, near), (9, a)]
    assert rows(p.keep_one_of_each(spark, table(spark, [(5, a), (5, b), (5, None), (7, "")]), SF)) == [(5, None), (5, a), (5, b), (7, "")]


def test_leaks_go(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5).collect()]
    leaks = [(k, f"Some words before. {t} And some after.") for k, t in enumerate(items)] + [(9, items[0].upper()), (9, "the other row of that id")]
    clean = [(20, None), (21, ""), (22, "A text of no test at all, about hills and the sea."), (22, "A text of no test at all, about hills and the sea."), (None, items[0]), (23, "word " * 200_000)]
    got = rows(p.drop_benchmark(spark, table(spark, leaks + clean), SF))
    assert got == sorted(clean, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_encode_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    some = [(1, "It's one text\n\n of 日本"), (1, "It's one text\n\n of 日本"), (2, None), (3, ""), (None, "no id"), (4, "é" * 200_000)]
    out = p.encode(spark, table(spark, some), SF).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in out), key=key) == sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in some), key=key)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_run_is_the_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:2]:
        docs = stage(spark, docs, SF)
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = {i: c for i, (_, c) in brute(kept, 5, 80).items()}
    once = table(spark, [(i, t) for i, t in kept if first[i] == i])
    last = p.encode(spark, p.drop_benchmark(spark, once, SF), SF)
    out = p.run(spark, SF)
    assert out.columns == last.columns
    assert sorted((r["doc_id"], list(r["ids"])) for r in out.collect()) == sorted((r["doc_id"], list(r["ids"])) for r in last.collect())
