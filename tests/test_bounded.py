"""Steps whose memory, time or shuffles must not outgrow their input, against plain versions."""

import random
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions import text as X
from lexiquarry.operators import linking, metrics, spans, tokens


def test_semantic_in_small_packs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{i % 50}", str(i), i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(90)]
    rows += [("odd", "x", 90, [None, 1.0, 1.0]), ("odd", "y", 91, [float("nan"), 1.0, 1.0]), ("zero", "z", 92, [0.0, 0.0, 0.0])]
    names = spark.createDataFrame(rows, "name string, code string, ord long, v array<double>")

    def cosine(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    whole = [r for r in rows if r[0] != "odd"]
    monkeypatch.setattr(linking, "VECTOR_BLOCK", 8 * 3 * 40)  # forty vectors
    for same in (True, False):
        got = linking.semantic(names.select(F.col("name").alias("q"), "v").where("ord < 50 or ord > 89"), names, -1.0, same).collect()
        assert {r["q"] for r in got} == {r[0] for r in whole}
        for r in got:
            own = next(v for n, _, _, v in whole if n == r["q"])
            scores = {o: cosine(own, v) for n, _, o, v in whole if same or n != r["q"]}
            first = min(o for o, s in scores.items() if s > max(scores.values()) - 1e-9)
            assert abs(r["score"] - max(scores.values())) < 1e-9
            assert abs(scores[int(r["code"]) if r["code"] != "z" else 92] - scores[first]) < 1e-9
    copies = spark.createDataFrame([(f"c{i}", str(i), i, [0.1, 0.7, 0.3]) for i in range(40)], names.schema)
    got = {r["q"]: r["code"] for r in linking.semantic(copies.select(F.col("name").alias("q"), "v"), copies, -1.0, same=False).collect()}
    assert got == {f"c{i}": "0" if i else "1" for i in range(40)}


def test_texts_become_strings_by_blocks(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aé đéệẛ̣𝒳") for _ in range(rng.choice([0, 1, 7, 300]))) for _ in range(60)] + [None, "", "plain"]
    assert [len(p) for p in X.in_blocks(pa.array(["ab", "c", None, "", "defgh", "i", "j"]), 3)] == [2, 3, 1, 1]
    assert [x for p in X.in_blocks(pa.array(texts), 100) for x in p.to_pylist()] == texts and not list(X.in_blocks(pa.array([], pa.string())))
    # What a batch makes of its texts is never held for more than a block of them.
    seen = []
    monkeypatch.setattr(X, "in_blocks", lambda x, size=100, f=X.in_blocks: (seen.append(len(p)) or p for p in f(x, 100)))
    got = X._mapped(pa.array(texts), X._unmarked).to_pylist()
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    assert got == [None if s is None else bare(s) for s in texts] and max(seen) < 40 and sum(seen) == len(texts)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "doc_id long, text string")
    for r in rows.select("text", X.nfc("text").alias("c"), X.strip_marks("text").alias("b")).collect():
        assert (r["c"], r["b"]) == ((None, None) if r["text"] is None else (unicodedata.normalize("NFC", r["text"]), bare(r["text"])))


def test_chunks_by_blocks(spark):
    rng = random.Random(8)
    texts = [" ".join("ab𝒳é"[: rng.randint(1, 4)] for _ in range(rng.choice([0, 3, 40]))) for _ in range(30)] + [None, "", "   "]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "doc_id long, text string").coalesce(1)
    find = lambda: rows.select("doc_id", tokens.bounded_windows(F.col("text"), 10, 3, 25).alias("c")).orderBy("doc_id").collect()
    for r, text in zip(find(), texts, strict=True):
        spans = [m.span() for m in re.finditer(r"\S+", text or "")]
        want, at = [], 0
        while at < len(spans):
            stop = max(at + 1, sum(1 for k, (_, e) in enumerate(spans) if k < at + 10 and e <= spans[at][0] + 25))
            want.append((text[spans[at][0] : spans[stop - 1][1]][:25], spans[at][0]))
            at = len(spans) if stop >= len(spans) else max(stop - 3, at + 1)
        assert [(c["text"], c["start_offset"]) for c in r["c"]] == (want or [((text or "")[:600], 0)])


def plain_errors(g, p):
    row = list(range(len(p) + 1))
    for i, x in enumerate(g, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(p, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors_work_out_their_words_once(spark):
    rng = random.Random(9)
    side = lambda: " ".join(rng.choice(["a", "b", "𝒳", "é", "cc"]) for _ in range(rng.randint(0, 6)))
    pairs = [(side(), side()) for _ in range(40)] + [(None, "a"), ("a", None), (" a b ", "a b"), ("", "")]
    df = spark.createDataFrame(pairs, "g string, p string")
    found = df.select("g", "p", metrics.word_errors(F.col("g"), F.col("p")).alias("e"), metrics.text_score(F.col("g"), F.col("p")).alias("s"), metrics.text_score(F.col("g"), F.col("p"), F.lit(1)).alias("one"))
    for r in found.collect():
        g, p = r["g"], r["p"]
        want = None if None in (g, p) else plain_errors(g.split(), p.split())
        assert r["e"] == want
        if want is not None:
            assert abs(r["s"] - max(0, 1 - want / max(len(g.split()), 1))) < 1e-12 and abs(r["one"] - max(0, 1 - 1 / max(len(g.split()), 1))) < 1e-12
    # Of the expression as it is run: words are split once a side.
    plan = df.select(metrics.word_errors(F.col("g"), F.col("p")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2


def test_versions_are_shuffled_once(spark):
    one = "doc_id long, ord long, start int, end int, text string, type string, candidates array<string>"
    rng = random.Random(10)
    rows = [[(rng.choice([0, 1, None]), k, rng.randint(0, 1), 2, rng.choice(["x", "y", None]), rng.choice(["T", "U"]), rng.choice([None, ["c"]])) for k in range(14)] for _ in range(2)]
    old, new = (spark.createDataFrame(r, one) for r in rows)
    found = spans.version_diff(old, new)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # one a side
    last, out = [{}, {}], []
    for side, held in zip(rows, last, strict=True):
        for d, _, s, e, text, kind, c in side:
            held[d, text, kind] = (s, e, c)
    for k in {*last[0], *last[1]}:
        x, y = last[0].get(k), last[1].get(k)
        if None in k:  # nulls are equal to nothing
            out += [(k, "missing")] * (x is not None) + [(k, "new")] * (y is not None)
        elif x is None or y is None or x != y:
            out.append((k, "new" if x is None else "missing" if y is None else "modified"))
    assert sorted(((r["doc_id"], r["text"], r["type"]), r["change"]) for r in found.collect() if None not in r[:3]) == sorted(o for o in out if None not in o[0])
    assert sorted(map(str, (((r["doc_id"], r["text"], r["type"]), r["change"]) for r in found.collect()))) == sorted(map(str, out))
    # A version with the old one's entities by sides, as the query has them.
    sides = old.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    assert spans.changes(sides.where("doc_id is not null and text is not null")).count() == 0


def test_scores_of_sides(spark):
    key = "doc_id long, start int, end int, type string"
    gold = [(0, 0, 2, "T"), (0, 3, 5, "T"), (1, 0, 2, "U"), (1, 0, 2, "U")]
    pred = [(0, 0, 2, "T"), (0, 3, 5, "U"), (1, 0, 2, "U")]
    sides = spark.createDataFrame([(*x, 1, 0) for x in gold] + [(*x, 0, 1) for x in pred], key + ", g int, p int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(metrics.scores_of_sides(sides)) == rows(metrics.span_scores(spark.createDataFrame(gold, key), spark.createDataFrame(pred, key)))
    assert {r["type"]: (r["gold"], r["pred"], r["correct"]) for r in metrics.scores_of_sides(sides).collect()} == {"T": (2, 1, 1), "U": (1, 2, 1), "all": (3, 3, 2)}


def test_answers_with_and_without_fences_and_spaces(spark):
    e = '[{"text":"a ``` b","position":[0,1],"type":"T"}]'
    plain = '[{"text":"a","position":[0,1],"type":"T"}]'
    answers = [plain, f" {plain}\n", f" {plain}　", f"```json\n{plain}\n```", f" ```json {plain}```\n", e, "", " ", None, "no"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(answers)], "i int, s string")
    before = F.regexp_replace(X.strip(F.col("s")), r"(?m)^```json\s*|```$", "")
    old = F.coalesce(F.from_json(before, X.ENTITY_JSON), F.array().cast(X.ENTITY_JSON))
    got = df.select("i", X.parse_entities(F.col("s")).alias("new"), old.alias("old")).orderBy("i").collect()
    assert all(r["new"] == r["old"] for r in got) and [len(r["new"]) for r in got] == [1] * 6 + [0] * 4


def test_type_override_settles_each_layer(spark):
    names = lambda *n: spark.createDataFrame([(x, x.upper(), i) for i, x in enumerate(n)], "name string, code string, ord long")
    asked = spark.createDataFrame([(x,) for x in ("Alphabetic", "alphabetik", "betablock", "betablok", "zzz", None)], "text string")
    found = linking.override_type(asked, names("alphabetic"), names("betablock", "alphabetik"), 0.85, "edits")
    assert {(r["q"], r["type"]) for r in found.collect()} == {("alphabetic", L.DIAGNOSIS), ("alphabetik", L.DIAGNOSIS), ("betablock", L.DRUG), ("betablok", L.DRUG)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
