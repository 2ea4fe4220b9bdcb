import difflib
import random
import unicodedata

from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.operators import annotators, assertions, bio, linking, metrics, profile, spans, tokens

E = "doc_id long, ord long, start int, end int, text string, type string, assertions array<string>, candidates array<string>"


def entities(spark, rows):
    return spark.createDataFrame([(*r, [], []) if len(r) == 6 else r for r in rows], E)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_windows_by_count(spark):
    d = docs(spark, *(" ".join(["w"] * n) for n in (256, 257, 452, 453)), "", " \n", None)
    got = {r["doc_id"]: r["n"] for r in tokens.word_windows(d).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 3, 4: 1, 5: 1, 6: 1}


def test_token_offsets_slice_the_text(spark):
    text = "Bệnh nhân ho,\n 𝒳 đau đầu  "
    for pattern in (tokens.SPACED, tokens.WORDS):
        rows = tokens.tokens(docs(spark, text), pattern).orderBy("ord").collect()
        assert [text[r["start"] : r["end"]] for r in rows] == [r["word"] for r in rows]
    assert [r["word"] for r in tokens.tokens(docs(spark, text)).orderBy("ord").collect()] == text.split()


def test_bounded_windows(spark):
    text = " ".join(f"w{i}" for i in range(300)) + " " + "x" * 900
    c = docs(spark, text).select(tokens.bounded_windows(F.col("text")).alias("c")).first()["c"]
    assert all(len(x["text"]) <= 450 and len(x["text"].split()) <= 120 for x in c)
    assert all(text[x["start_offset"] :].startswith(x["text"]) for x in c)
    assert c[-1]["text"] == "x" * 450


def test_merge_vector(spark):
    a = entities(spark, [(0, 0, 10, 26, "x", L.DIAGNOSIS, ["isHistorical"], ["I10"]), (0, 1, 50, 58, "y", L.SYMPTOM, [], [])])
    b = entities(spark, [(0, 0, 14, 26, "tăng huyết áp", L.DIAGNOSIS), (0, 1, 70, 77, "z", L.SYMPTOM)])
    got = spans.merge(a, b).orderBy("ord").collect()
    assert [(r["start"], r["origin"]) for r in got] == [(14, "both"), (50, "a"), (70, "b")]
    assert got[0]["text"] == "tăng huyết áp" and got[0]["candidates"] == ["I10"] and got[0]["assertions"] == ["isHistorical"]


def greedy(a, b):
    """A plain version of the merge's pairing."""
    used, out = set(), []
    for s, e, t in a:
        best, top = None, 0.0
        for j, (x, y, u) in enumerate(b):
            inter = min(e, y) - max(s, x)
            v = inter / (max(e, y) - min(s, x)) if inter > 0 else 0.0
            if j not in used and u == t and v >= 0.5 and v > top:
                best, top = j, v
        if best is not None:
            used.add(best)
        out.append(best)
    return out


def test_merge_equals_greedy(spark):
    rng = random.Random(3)
    for _ in range(3):
        side = lambda: [(s := rng.randint(0, 30), s + rng.randint(1, 12), rng.choice([L.DRUG, L.SYMPTOM])) for _ in range(8)]
        a, b = side(), side()
        rows = lambda z: entities(spark, [(0, i, s, e, f"{i}", t) for i, (s, e, t) in enumerate(z)])
        got = spans.merge(rows(a), rows(b)).collect()
        pairs = [j for j in greedy(a, b) if j is not None]
        assert sorted(int(r["text"]) for r in got if r["origin"] == "both") == sorted(pairs)
        assert len(got) == len(a) + len(b) - len(pairs)
        assert [r["start"] for r in sorted(got, key=lambda r: r["ord"])] == sorted(r["start"] for r in got)


def test_tie_goes_to_the_first(spark):
    a = entities(spark, [(0, 0, 0, 20, "a", L.DRUG)])
    b = entities(spark, [(0, 0, 0, 10, "first", L.DRUG), (0, 1, 10, 20, "second", L.DRUG)])
    assert [(r["text"], r["origin"]) for r in spans.merge(a, b).orderBy("ord").collect()] == [("first", "both"), ("second", "b")]


def test_empty_sides(spark):
    none = entities(spark, [])
    b = entities(spark, [(0, 0, 0, 10, "x", L.DRUG)])
    assert [r["origin"] for r in spans.merge(none, b).collect()] == ["b"]
    assert spans.merge(none, none).collect() == []


def test_clean(spark):
    text = "là bị đau đầu, Aspirin 500 mg x 4 viên; siêu âm bụng vào ngày 1/2/2020; gout 123"
    place = lambda s: (text.index(s), text.index(s) + len(s), s)
    rows = [("là bị đau đầu,", L.DIAGNOSIS), ("Aspirin 500 mg x 4 viên;", L.DRUG), ("siêu âm bụng vào ngày 1/2/2020", L.DIAGNOSIS), ("gout", L.DIAGNOSIS), ("123", L.DRUG)]
    e = entities(spark, [(0, i, *place(s), t) for i, (s, t) in enumerate(rows)])
    got = {r["ord"]: (r["text"], r["type"], text[r["start"] : r["end"]]) for r in spans.clean(e, docs(spark, text)).collect()}
    assert got[0] == ("đau đầu", L.SYMPTOM, "đau đầu")
    assert got[1] == ("Aspirin 500", L.DRUG, "Aspirin 500")
    assert got[2] == ("siêu âm bụng", L.TEST, "siêu âm bụng")
    assert got[3][0] == "gout" and 4 not in got
    assert spans.clean(entities(spark, [(0, 0, *place("Aspirin"), L.DRUG)]), docs(spark, text)).collect() == []


def test_closest_position_tiers(spark):
    composed = "Bệnh nhân đau đầu rồi đau đầu."
    split = unicodedata.normalize("NFD", composed)
    e = entities(spark, [(0, 0, 20, 27, "Đau đầu", L.SYMPTOM), (1, 0, 0, 0, "đau đầu", L.SYMPTOM), (0, 1, 11, 18, "đau dầu rồi", L.SYMPTOM), (0, 2, 0, 1, "zzzzzz", L.DRUG)])
    d = docs(spark, composed, split)
    got = {(r["doc_id"], r["ord"]): r for r in spans.closest_position(e, d).collect()}
    assert got[0, 0]["start"] == 22 and got[0, 0]["text"] == "đau đầu"
    assert unicodedata.normalize("NFC", got[1, 0]["text"]) == "đau đầu"
    assert got[0, 1]["text"].startswith("đau đầu")
    assert (0, 2) not in got
    texts = {0: composed, 1: split}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["text"] for r in got.values())


def test_coalesce_and_dedup(spark):
    text = "đau đầu và, sốt\nho"
    e = entities(spark, [(0, 0, 0, 3, "đau", L.SYMPTOM), (0, 1, 4, 7, "đầu", L.SYMPTOM), (0, 2, 12, 15, "sốt", L.SYMPTOM), (0, 3, 16, 18, "ho", L.SYMPTOM)])
    assert [r["text"] for r in spans.coalesce_adjacent(e, docs(spark, text)).orderBy("ord").collect()] == ["đau đầu", "sốt", "ho"]
    twice = entities(spark, [(0, 0, 0, 3, "a", L.SYMPTOM), (0, 1, 0, 3, "a", L.DIAGNOSIS)])
    assert [r["type"] for r in spans.dedup_by_priority(twice).collect()] == [L.DIAGNOSIS]


def test_restore_symptoms(spark):
    e = entities(spark, [(0, 0, 0, 1, "Đau ngực trái", L.DIAGNOSIS), (0, 1, 0, 1, "viêm gan", L.DIAGNOSIS), (0, 2, 0, 1, "ho", L.DRUG)])
    assert [r["type"] for r in spans.restore_symptoms(e).orderBy("ord").collect()] == [L.SYMPTOM, L.DIAGNOSIS, L.DRUG]


def test_flags(spark):
    text = "Mẹ có tiền sử lao. Bệnh nhân không ho, sốt âm tính."
    e = entities(spark, [(0, 0, text.index("lao"), text.index("lao") + 3, "lao", L.DIAGNOSIS), (0, 1, text.index("ho,"), text.index("ho,") + 2, "ho", L.SYMPTOM), (0, 2, text.index("sốt"), text.index("sốt") + 3, "sốt", L.TEST)])
    got = [r["assertions"] for r in assertions.with_flags(e, docs(spark, text)).orderBy("ord").collect()]
    assert got == [["isFamily", "isHistorical"], ["isNegated"], []]


def test_bio(spark):
    tags = ["B-A", "I-A", "B-A", "I-B", "O", "I-A", "I-A"]
    df = spark.createDataFrame([(0, i, t, 0.9) for i, t in enumerate(tags)], "k int, pos int, tag string, prob double")
    key = lambda d: sorted((r["first"], r["last"], r["type"]) for r in d.collect())
    assert key(bio.decode(df, ["k"])) == [(0, 1, "A"), (2, 2, "A"), (3, 3, "B"), (5, 6, "A")]
    assert key(bio.decode(df, ["k"], strict=True)) == [(0, 1, "A"), (2, 2, "A")]
    labels = spark.createDataFrame([([1, 0], [2, 1])], "y array<int>, n array<int>")
    assert labels.select(bio.propagate(F.col("y"), F.col("n")).alias("z")).first()["z"] == [-100, 1, 2, 0, -100]
    assert labels.select(bio.propagate(F.col("y"), F.col("n"), inner=False).alias("z")).first()["z"] == [-100, 1, -100, 0, -100]
    e = spark.createDataFrame([([[1.0, 0.0], [0.0, 0.4]],)], "emissions array<array<double>>")
    assert bio.viterbi(e, [[0.5, 0.0], [0.0, 0.5]], [0.0, 0.0], [0.0, 0.0]).first()["path"] == [0, 0]


def test_dictionaries_and_cascade(spark):
    icd = spark.createDataFrame([("Bệnh lao", "A15", 0), ("lao", "A16*", 1), ("đau nửa đầu", "G43", 2), (None, "X", 3)], "name string, code string, ord long")
    last = {r["name"]: r["code"] for r in linking.last_wins(icd).collect()}
    assert last == {"lao": "A16*", "bệnh lao": "A15", "đau nửa đầu": "G43"}
    rx = linking.first_wins(spark.createDataFrame([("Aspirin", 1, 0), ("aspirin", 2, 1), ("amlodipine", 3, 2)], "name string, code long, ord long"))
    m = spark.createDataFrame([("Aspirin 81 mg", L.DRUG), ("amlodipin", L.DRUG), ("lao", L.DIAGNOSIS), ("ho", L.SYMPTOM), ("tiêm", L.DRUG), ("Dau nua dau", L.DIAGNOSIS)], "text string, type string")
    got = {(r["q"], r["layer"]): r["code"] for r in linking.cascade(m, linking.last_wins(icd), rx).collect()}
    assert got == {("aspirin", "exact"): "1", ("amlodipin", "fuzzy"): "3", ("lao", "exact"): "A16*", }
    got = {r["q"]: r["layer"] for r in linking.cascade(m, linking.last_wins(icd), rx, full=False, use_substring=True, cutoff=0.8).collect()}
    assert got["amlodipin"] == "substring"


def test_fuzzy_loses_nothing(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    names = sorted({word(rng.randint(1, 14)) for _ in range(120)})
    asked = {word(rng.randint(1, 14)) for _ in range(60)}
    for n in names[:60]:
        k = rng.randrange(len(n))
        asked |= {n[:k] + rng.choice("abcde") + n[k + 1 :], n[:k] + n[k + 1 :] or "a", n[:k] + "e" + n[k:]}
    table = spark.createDataFrame([(n, n, i) for i, n in enumerate(names)], "name string, code string, ord long")
    queries = spark.createDataFrame([(q,) for q in asked], "q string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b))

    score = {"blocks": lambda q, n: difflib.SequenceMatcher(None, n, q).ratio(), "edits": edits}
    for scorer, cutoff in (("blocks", 0.8), ("blocks", 0.88), ("edits", 0.8)):
        want = {q: max((score[scorer](q, n), n) for n in names) for q in sorted(asked)}
        want = {q: n for q, (v, n) in want.items() if v >= cutoff}
        assert {r["q"]: r["code"] for r in linking.fuzzy(queries, table, cutoff, scorer).collect()} == want


def test_semantic_leaves_out_all_of_the_own_name(spark):
    v = spark.createDataFrame([("a", "1", 0, [1.0, 0.0]), ("a", "2", 1, [1.0, 0.1]), ("b", "3", 2, [0.9, 0.3])], "name string, code string, ord long, v array<double>")
    got = linking.semantic(v.where("code = '1'").select(F.col("name").alias("q"), "v"), v, 0.0, same=False).first()
    assert (got["name"], got["code"]) == ("b", "3")


def test_keywords_in_a_long_text(spark):
    text = "x" * 400_000 + " no Dans con " + "é" * 400_000 + " nocon con"
    got = annotators.keywords(docs(spark, text, None, ""), {"con": L.DRUG, "dans": L.TEST, "dans con": L.SYMPTOM}).orderBy("ord").collect()
    assert [(r["text"], r["type"], text[r["start"] : r["end"]]) for r in got] == [("Dans con", L.SYMPTOM, "Dans con"), ("con", L.DRUG, "con")]


def test_groups_reports_and_counters(spark):
    pieces = [(0, 0, "a", "B-X", 0, 1), (0, 1, "##b", "I-X", 1, 2), (0, 2, "c", "B-X", 3, 4), (0, 3, "d", "I-Y", 5, None)]
    got = bio.simple_groups(spark.createDataFrame(pieces, "doc_id long, ord long, word string, tag string, start int, end int")).orderBy("ord").collect()
    assert [(r["text"], r["start"], r["end"], r["type"]) for r in got] == [("ab", 0, 2, "X"), ("c", 3, 4, "X")]
    rows, seen = profile.observed(entities(spark, [(0, 0, 0, 1, "a", L.DRUG, [], ["1"]), (5, 0, 0, 1, "b", L.DRUG, [], [])]))
    rows.collect()
    assert seen.get == {"entities": 2, "documents": 2, "linked": 1, "last_doc": 5}
    words = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40_000)), "w1")], "g string, p string")
    assert words.select(metrics.word_errors(F.col("p"), F.col("p")).alias("e")).first()["e"] == 0


def test_scores(spark):
    s = spark.createDataFrame([("ho đờm xanh nhiều", "ho xanh đặc nhiều")], "g string, p string")
    r = s.select(metrics.word_errors(F.col("g"), F.col("p")).alias("e"), metrics.text_score(F.col("g"), F.col("p")).alias("t")).first()
    assert (r["e"], r["t"]) == (2, 0.5)
    j = spark.createDataFrame([([], [], ["a"])], "a array<string>, b array<string>, c array<string>")
    r = j.select(metrics.jaccard(F.col("a"), F.col("b")).alias("x"), metrics.jaccard(F.col("a"), F.col("c")).alias("y")).first()
    assert (r["x"], r["y"]) == (1.0, 0.0)
    same = entities(spark, [(0, 0, 0, 3, "a b", L.DRUG)])
    assert metrics.component_scores(same, same).first()["final_score"] == 1.0


def test_version_diff(spark):
    old = entities(spark, [(0, 0, 0, 1, "a", L.DRUG), (0, 1, 2, 3, "b", L.DRUG), (0, 2, 4, 5, "c", L.DRUG)])
    new = entities(spark, [(0, 0, 0, 1, "a", L.DRUG), (0, 1, 3, 4, "b", L.DRUG), (0, 2, 4, 5, "d", L.DRUG)])
    assert {r["text"]: r["change"] for r in spans.version_diff(old, new).collect()} == {"b": "modified", "c": "missing", "d": "new"}


def test_most_similar_equals_all_windows():
    def slow(t, window):
        top, place = 0.0, None
        for n in range(max(1, len(t) - 15), min(len(window), len(t) + 15) + 1):
            for s in range(len(window) - n + 1):
                r = difflib.SequenceMatcher(None, t, window[s : s + n]).ratio()
                if r > top:
                    top, place = r, (s, s + n)
        return place if place and top >= 0.70 else None

    rng = random.Random(5)
    for _ in range(150):
        window = "".join(rng.choice("abcé \n") for _ in range(rng.randint(0, 60)))
        s = rng.randint(0, max(len(window) - 8, 0))
        t = "".join(rng.choice("abcx ") if rng.random() < 0.2 else c for c in window[s : s + rng.randint(4, 14)])
        assert not t or spans.most_similar(t, window) == slow(t, window)
    assert spans.most_similar("abc", "") is None


def _plain_place(doc, text, hint, compat):
    """The three tiers, one mention at a time and without any index."""

    def hits(low, needle):
        found, at = [], low.find(needle)
        while at >= 0:
            found.append(at)
            at = low.find(needle, at + len(needle))
        return found

    def closest(found):
        return min(found, key=lambda s: (abs(s - hint), s))

    if found := hits(doc.lower(), text.lower()):
        return closest(found), closest(found) + len(text)
    composed, wanted = unicodedata.normalize("NFC", doc), unicodedata.normalize("NFC", text)
    if found := hits(composed.lower(), wanted.lower()):
        if compat:
            blocks = difflib.SequenceMatcher(None, composed, doc).get_matching_blocks()
            back = [next((b + i - a for a, b, n in blocks if a <= i <= a + n), i) for i in range(len(composed) + 1)]
        else:
            # A composed character begins where the shortest prefix that composes to more than what is before it begins.
            back = [max(p for p in range(len(doc) + 1) if len(unicodedata.normalize("NFC", doc[:p])) <= i and (p == len(doc) or not unicodedata.combining(doc[p]))) for i in range(len(composed) + 1)]
        return back[closest(found)], back[closest(found) + len(wanted)]
    low = max(0, hint - 80)
    window, best = doc[low : hint + len(text) + 80].lower(), None
    for n in range(max(1, len(text) - 15), min(len(window), len(text) + 15) + 1):
        for s in range(len(window) - n + 1):
            score = difflib.SequenceMatcher(None, text.lower(), window[s : s + n]).ratio()
            if score >= 0.70 and (best is None or score > best[0]):
                best = (score, low + s, low + s + n)
    return best[1:] if best else None


def test_closest_position_equals_a_plain_search(spark):
    rng = random.Random(4)
    words = ["đau", "đầu", "sốt", "ho", "khó", "thở", "aa", "Aspirin"]
    texts, rows = [], []
    for d in range(12):
        text = " ".join(rng.choice(words) for _ in range(25))
        texts.append(unicodedata.normalize("NFD" if d % 2 else "NFC", text))
        for k in range(10):
            own = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
            own = own.upper() if k % 5 == 0 else own.replace("a", "b", 1) if k % 5 == 1 else own
            rows.append((d, k, None if k == 7 else rng.randint(0, 120), None, unicodedata.normalize(rng.choice(["NFC", "NFD"]), own), L.SYMPTOM))
    rows += [rows[0], (0, 90, 3, 4, " ", L.DRUG), (0, 91, 3, 4, "ho", ""), (99, 0, 0, 2, "ho", L.DRUG)]
    for mode in ("exact", "compat"):
        got = [(r["doc_id"], r["ord"], r["start"], r["end"], r["text"]) for r in spans.closest_position(entities(spark, rows), docs(spark, *texts), offset_map=mode).collect()]
        want = []
        for d, k, start, _, text, _ in rows[:121]:
            if place := _plain_place(texts[d], text, start or 0, mode == "compat"):
                want.append((d, k, *place, texts[d][place[0] : place[1]]))
        assert sorted(got) == sorted(want) and len(want) > 60
    near = spans.closest_position(entities(spark, rows), docs(spark, *texts), fuzzy=False)
    assert 0 < near.count() < len(want)
    assert spans.closest_position(entities(spark, []), docs(spark, *texts)).count() == 0


def test_alignment_keeps_columns_and_copes_with_growing_characters(spark):
    d = docs(spark, "İİİ đau", None, "")
    e = entities(spark, [(0, 0, 4, 7, "đau", L.SYMPTOM), (0, 1, 0, 3, unicodedata.normalize("NFD", "đau"), L.SYMPTOM), (1, 0, 0, 1, "a", L.DRUG), (2, 0, 0, 1, "a", L.DRUG)])
    more = e.withColumns({"doc": F.lit("x"), "key": F.lit(1), "mention": F.lit(2)})
    got = spans.closest_position(more, d)
    assert got.columns == more.columns and {r["doc_id"] for r in got.collect()} == {0}


def test_tags_equal_a_plain_walk(spark):
    rng = random.Random(8)
    toks, ents, want = [], [], {}
    for d in range(6):
        own = []
        at = 0
        for k in range(60):
            n = rng.randint(1, 90 if k % 20 == 0 else 8)
            own.append((d, k, "w", at, at + n))
            at += n + rng.randint(0, 3)
        toks += own
        tags = ["O"] * len(own)
        for k in range(15):
            s = rng.randint(0, at)
            e = (d, k, s, s + rng.randint(-2, 120), "t", rng.choice([*L.TYPES, "none"]))
            ents.append(e)
            inside = [i for i, t in enumerate(own) if t[3] >= e[2] and t[4] <= e[3]] if e[5] in L.TYPES else []
            for place, i in enumerate(inside):
                if place == 0:
                    tags[i] = "B-" + e[5]
                elif tags[i] == "O":
                    tags[i] = "I-" + e[5]
        want |= {(d, i): t for i, t in enumerate(tags)}
    frame = spark.createDataFrame(toks, "doc_id long, ord long, word string, start int, end int")
    assert {(r["doc_id"], r["ord"]): r["tag"] for r in bio.tag_tokens(frame, entities(spark, ents)).collect()} == want
