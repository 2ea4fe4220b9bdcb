"""Steps that give a document's text to a list of its entities, not to each of them, against plain versions."""

import random

from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.operators import bio, spans, tokens

E = "doc_id long, ord long, start int, end int, text string, type string"


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Repartition") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def random_rows(seed, docs=6):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abB \nÉ𝒳") for _ in range(rng.randint(0, 60))) for _ in range(docs)] + [None, ""]
    rows = []
    for d, text in enumerate(texts):
        for k in range(12):
            s = rng.randint(0, 60)
            e = s + rng.randint(1, 4)
            said = (text or "")[s:e] if rng.random() < 0.4 else "".join(rng.choice("abB é𝒳") for _ in range(rng.randint(1, 2)))
            rows.append((d, k, s, e, said, rng.choice([L.DRUG, L.SYMPTOM])))
    return texts, rows


def test_tokens_are_not_shuffled(spark):
    d = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    assert exchanges(tokens.tokens(d)) == 0


def test_tokens_of_blocks(spark, monkeypatch):
    import pyarrow as pa
    import regex

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab,_. \n\t\x1c　éđ中𝒳😀́٣;") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", " "]
    monkeypatch.setattr(tokens, "BLOCK", 97)
    for pattern, plain in ((tokens.SPACED, f"[^{tokens.SPACE_CHARS}]+"), (tokens.WORDS, rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{tokens.SPACE_CHARS}]")):
        got = tokens._in_blocks(pa.array(texts, pa.string()), tokens._kinds(pattern)).to_pylist()
        assert got == [None if t is None else [{"word": m.group(), "start": m.start(), "end": m.end()} for m in regex.finditer(plain, t)] for t in texts]


def test_relocation_equals_plain(spark):
    for seed in range(3):
        texts, rows = random_rows(seed)
        d, e = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(rows, E)
        near, first = {}, {}
        for i, k, s, t, said, _ in rows:
            doc = texts[i]
            asked, key = said.strip(), (i, k)
            first[key] = (s, t)
            if doc is None:
                continue
            low, hits = doc.lower(), []
            at = low.find(asked.lower())
            while asked and at >= 0:
                hits.append(at)
                at = low.find(asked.lower(), at + len(asked))
            if asked and doc[s:t].strip().lower() == asked.lower():
                near[key] = (s, t)
            elif hits:
                at = min(hits, key=lambda h: (abs(h - s), h))
                near[key] = (at, at + len(asked))
            if not (t <= len(doc) and doc[s:t].lower() == said.lower()) and (at := low.find(said.lower())) >= 0:
                first[key] = (at, at + len(said))
        for f, want in ((spans.check_then_search, near), (spans.first_hit, first)):
            got = f(e, d).collect()
            assert {(r["doc_id"], r["ord"]): (r["start"], r["end"]) for r in got} == want and len(got) == len(want)
        for r in spans.misaligned(e, d).collect():
            doc = texts[r["doc_id"]]
            assert r["bad"] == (doc is None or doc[r["start"] : r["end"]] != r["text"])


def test_text_goes_to_lists(spark):
    d = spark.createDataFrame([(0, "ab " * 50)], "doc_id long, text string")
    e = spark.createDataFrame([(0, k, 3 * k, 3 * k + 2, "ab", L.DRUG) for k in range(50)], E)
    assert spans.packed(e, d).count() == 1 and spans.misaligned(e, d).where("not bad").count() == 50


def test_sides_are_dealt_once(spark):
    _, rows = random_rows(5)
    e = spark.createDataFrame(rows, E)
    assert exchanges(spans.merge(e, e)) <= 4


def test_documents_are_tagged_as_tokens(spark):
    texts, rows = random_rows(7)
    d, e = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(rows, E)
    for pattern in (tokens.SPACED, tokens.WORDS):
        each = bio.tag_documents(d, e, pattern).select("doc_id", F.posexplode("tags").alias("ord", "tag"))
        want = {(r["doc_id"], r["ord"]): r["tag"] for r in bio.tag_tokens(tokens.tokens(d, pattern), e).collect()}
        assert {(r["doc_id"], r["ord"]): r["tag"] for r in each.collect()} == want and len(want) > 20


def test_the_line_before_is_not_context(spark):
    from lexiquarry.operators import assertions

    row = spark.createDataFrame([("we said no\nho today", 11, 13)], "doc string, start int, end int")
    assert row.select(assertions.context(F.col("doc"), F.col("start"), F.col("end"))[0]).first()[0] == ""


def test_substrings_by_few_anchors(spark, monkeypatch):
    from lexiquarry.operators import linking

    rng = random.Random(2)
    big = ["".join(rng.choice("abc𝒳") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    small = [b[i : i + n] for b in big for i, n in ((rng.randint(0, 40), rng.choice([1, 5, 9, 40])),)] + ["abcabcabcabc", ""]
    want = {(s, b) for s in small for b in big if s and s in b}
    frames = spark.createDataFrame([(s,) for s in small], "s string"), spark.createDataFrame([(b,) for b in big], "b string")
    for bound in (200_000, 3):
        monkeypatch.setattr(linking, "GRAMS", bound)
        found = linking.containing(*frames)
        assert {(r["s"], r["b"]) for r in found.collect()} == want
        if bound > 3:  # the other grams of the long strings are no rows of a join
            assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_context_of_lists_equals_that_of_rows(spark, monkeypatch):
    from lexiquarry.operators import assertions

    monkeypatch.setattr(assertions, "HELD", 9)
    for seed in range(2):
        texts, rows = random_rows(seed)
        texts = [t and t.replace("b", ".") for t in texts]
        d, e = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(rows, E)
        found = assertions.with_context(e, d, 7, 3)
        left, right = assertions.context(F.col("doc"), F.col("start"), F.col("end"), 7, 3)
        want = e.join(d.withColumnRenamed("text", "doc"), "doc_id").select("doc_id", "ord", left, right)
        assert sorted(map(tuple, found.select("doc_id", "ord", "_left", "_right").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        # No text goes through the driver, though both tables are small.
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_tag_numbers_of_many_documents_equal_those_of_one(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    monkeypatch.setattr(bio, "PAIRS_HELD", 5)
    documents = []
    for _ in range(60):
        spans_ = sorted({(s, s + rng.randint(1, 3)) for s in (rng.randint(0, 20) for _ in range(rng.randint(0, 9)))})
        documents.append((spans_, [(rng.randint(0, 4), s := rng.randint(-3, 20), s + rng.randint(1, 9), rng.choice(bio._KINDS)) for _ in range(rng.randint(0, 7))]))
    columns = [[[x[0] for x in s] for s, _ in documents], [[x[1] for x in s] for s, _ in documents], *([[x[k] for x in e] for _, e in documents] for k in range(3)), [[bio._KINDS.index(x[3]) for x in e] for _, e in documents]]
    got = bio.tag_numbers(*(pa.array(c, pa.list_(pa.int64())) for c in columns)).to_pylist()
    assert [[bio._NAMES[k] for k in row] for row in got] == [bio.tags([x[0] for x in s], [x[1] for x in s], e) for s, e in documents]


def test_lists_of_tags_equal_rows_of_tags(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))) for _ in range(20)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = F.array(*map(F.lit, ("O", "B-x", "I-x", "I-y", "z", None)))
    tag = lambda word, i: F.get(names, F.pmod(F.xxhash64(word, i), F.lit(6)).cast("int"))
    prob = lambda word: F.length(word) / 4.0
    end = lambda word, e: F.when(word != "ab", e)
    lists = tokens.token_lists(d).select("doc_id", F.transform("t", lambda x, i: F.struct(x["word"].alias("word"), tag(x["word"], i).alias("tag"), prob(x["word"]).alias("prob"), x["start"].alias("start"), end(x["word"], x["end"]).alias("end"))).alias("t"))
    rows = lists.select("doc_id", F.posexplode("t").alias("ord", "x")).select("doc_id", "ord", "x.*")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 5
    columns = "doc_id", "type", "first", "last", "n"
    for threshold, strict in ((None, False), (0.5, False), (None, True)):
        found = bio.decode_lists(lists, threshold=threshold, strict=strict)
        assert exchanges(found) == 0 and same(found.select(*columns), bio.decode(rows, ["doc_id"], "ord", threshold, strict).select(*columns))
    found = bio.group_lists(lists)
    assert exchanges(found) == 0 and same(found, bio.simple_groups(rows))


def test_merge_of_lists_equals_that_of_rows(spark):
    _, rows = random_rows(9)
    rows = sorted({(None if r[0] == 1 else r[0], *r[1:]) for r in rows}, key=str)
    a, b = (spark.createDataFrame([r for r in rows if r[1] % 2 == k], E) for k in (0, 1))
    fields = "ord", "start", "end", "text", "type"
    none = F.array().cast("array<string>")
    both = a.withColumn("side", F.lit(0)).union(b.withColumn("side", F.lit(1))).repartition(3, "doc_id").groupBy("doc_id")
    one = F.struct(*fields, none.alias("assertions"), none.alias("candidates"))
    both = both.agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == k, one))).alias(n) for k, n in enumerate(("_a", "_b"))))
    found = spans.merge_lists(both)
    assert exchanges(found) == exchanges(both)
    assert sorted(map(str, found.collect())) == sorted(map(str, spans.merge(a, b).collect()))
