import gzip
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import ann, bpe, chat, decontam, licenses, lm, quality, queries, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)

    def slow(x):  # the best segment, then both sides of it
        best = max(((sum(x[a:b]), -(b - a), -a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = -best[2], best[3]
        return [*slow(x[:a]), (a, b), *((a2 + b, b2 + b) for a2, b2 in slow(x[b:]))]

    for _ in range(300):
        x = [rng.choice([-3.1, -1.3, 0.7, 2.9, 4.1]) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == slow(x)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).join(labels, "doc_id").select("toxic", "score", "predicted", "passages", "text").toPandas()
    a, b = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert np.mean(a[:, None] > b[None, :]) + np.mean(a[:, None] == b[None, :]) / 2 > 0.85
    assert got[got.toxic == 0].predicted.mean() < 0.03
    for text, found in zip(got.text, got.passages, strict=True):
        assert all(0 <= p["start"] < p["end"] <= len(text) for p in found)
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "x")], DOCS), model).collect()
    assert len({r["score"] for r in odd[:2]}) == 1 and odd[0]["passages"] == []
    blank = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs.limit(1), blank).first()["predicted"] == 0


def test_held_out_is_crc32(spark):
    got = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_chat_events(spark):
    log = [
        (1, 0, "open", 1, "user", None), (1, 1, "delta", 1, None, "he"), (1, 2, "delta", 1, None, "y"),
        (1, 3, "open", 2, "assistant", None), (1, 4, "delta", 2, None, "bad"), (1, 5, "open", 3, "user", None), (1, 6, "delta", 3, None, "gone"),
        (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "go<|od\\c"), (1, 9, "edit", 1, None, "hello"), (1, 10, "delta", 1, None, "!"),
    ]
    df = spark.createDataFrame(log, chat.EVENTS).repartition(4)
    r = chat.read_back(chat.render(chat.fold(df))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "hello!"), ("assistant", "go<|od\\c")]
    assert r["loss_texts"] == ["go<|od\\c"]
    assert r["formatted"].count(chat.TURN_START) == 2 and r["formatted"].count("<|") == 4
    assert chat.fold(df.limit(0)).collect() == [] == chat.read_back(chat.render(chat.fold(df.limit(0)))).collect()
    long = spark.createDataFrame([(1, 0, "user", "é" * 3_000_000), (1, 1, "assistant", "<|x" * 1_000_000)], "conv_id long, turn int, role string, text string")
    began = time.time()
    r = chat.read_back(chat.render(chat.fold(chat.events_of(long)))).first()
    assert r["turns"][0]["text"] == "é" * 3_000_000 and r["loss_texts"] == ["<|x" * 1_000_000] and time.time() - began < 60


def test_chat_round_trip(spark):
    rng = random.Random(2)
    piece = lambda: "".join(rng.choice(["<|im_end|>", "\\", "\\c", "<|", "\n", "é𝒳", "a", "b", "|>"]) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", None, "sys\ntem"]), rng.choice([piece(), None])) for c in range(8) for t in range(rng.randint(1, 5))]
    got = chat.read_back(chat.render(chat.fold(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), piece=2)))).collect()
    for r in got:
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss_texts"] == [t for role, t in want if role == "assistant"]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 6))
    x[50:200] = x[50]  # copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000, None, ""), (1001, [0.0] * 6, ""), (1002, [float("nan")] * 6, ""), (1003, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (1004, [1.0], "")]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")).collect()
    y = x.astype(np.float32).astype(float)
    for q in range(0, 600, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == best.tolist()
        assert np.allclose([r["score"] for r in own], d[best], rtol=1e-12)
    few = ann.nearest(spark.createDataFrame(rows[100:103], "vec_id long, embedding array<float>, score string")).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == [101, 102]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def true_lists(x, every, k=10):
    out = {}
    for q in range(0, len(x), every):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        out[q] = np.lexsort((np.arange(len(x)), d))[:k].tolist()
    return out


@pytest.mark.parametrize("kind", ["centred", "shifted", "clusters"])
def test_nearest_wherever_the_data_lies(spark, kind):
    rng = np.random.default_rng(8)
    n, every = 3000, 50
    x = {
        "centred": lambda: rng.standard_normal((n, 3)) @ rng.standard_normal((3, 32)) * 0.01,
        "shifted": lambda: rng.standard_normal((n, 3)) @ rng.standard_normal((3, 32)) * 0.01 + 1e6,
        "clusters": lambda: rng.standard_normal((60, 32))[rng.integers(0, 60, n)] * 1e3 + rng.standard_normal((n, 2)) @ rng.standard_normal((2, 32)),
    }[kind]()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    want = true_lists(x, every)
    assert lists(ann.nearest(vectors, every=every)) == want
    got = lists(ann.nearest(vectors, every=every, exact=False))
    recall = np.mean([len(set(got[q]) & set(w)) / len(w) for q, w in want.items()])
    assert recall >= 0.9, recall


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.5, 0.0], 2), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 1), (3, [1.0, 0.5, 0.1], 1), (None, [1.0, 0.0], 1), (4, [], 1), (5, [1.1, 0.0], 1)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), k=3)
    assert lists(got) == {0: [1, 2, 5], 100: [3]}  # each length on its own, ties to the smaller id, repeats once


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(side**3))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_quality_without_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = quality.score(docs, quality.train(docs)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "gold"), "doc_id").toPandas()
    assert ((got.good.astype(int)) == got.gold).mean() > 0.95
    assert got[got.gold == 1].good.mean() > 0.97
    odd = quality.score(spark.createDataFrame([(1, None), (2, " ")], DOCS), quality.train(docs.limit(0))).collect()
    assert [r["good"] for r in odd] == [False, False]


@pytest.fixture(scope="module")
def spec():
    return open(queries.vocabulary_path(), encoding="utf-8").read()


def test_bpe_equals_the_library(spec):
    from tokenizers import Tokenizer

    np.seterr(over="ignore")
    tables = bpe.Tables.of(spec)
    codec, library = bpe.Codec(tables), Tokenizer.from_file(queries.vocabulary_path())
    rng = random.Random(5)
    parts = ["a", "the", " of", "ing", "  ", "\n", "\t", "é", "日本", "𝒳", "'s", "'ll", "123", "<|endoftext|>", "<|", "!!", "\x1c", "\x85", " ", "²", "aaaa", "----", "'", "'re", "'r", "\xa0", "it's", "'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 20_000, ""]
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert bpe.gather(tables, np.array(ids, np.int64))[0].tobytes().decode() == t
    raw = [t.encode() for t in texts]
    ids, count = codec.block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_is_exact_when_hashes_meet(spec, monkeypatch):
    np.seterr(over="ignore")
    tables = bpe.Tables.of(spec)
    texts = b"one two three one fourfive"
    raw, ends = np.frombuffer(texts, np.uint8), np.array([0, 7, len(texts)])
    want = [x.tolist() for x in bpe.Codec(tables).block(raw, ends)]
    monkeypatch.setattr(bpe.Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    assert [x.tolist() for x in bpe.Codec(tables).block(raw, ends)] == want
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "REMEMBERED", 2)  # generations come and go
    codec = bpe.Codec(tables)
    assert [[x.tolist() for x in codec.block(raw, ends)] for _ in range(3)] == [want] * 3


def test_bpe_rejects_other_vocabularies(spec):
    file = json.loads(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "id": 60_000, "lstrip": True}]}, {"model": {**file["model"], "ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.Tables.of(json.dumps({**file, **change}))
    vocab = file["model"]["vocab"] | {"qxzq": 60_000}  # an entry that no merges reach
    codec = bpe.Codec(bpe.Tables.of(json.dumps({**file, "model": {**file["model"], "vocab": vocab}})))
    assert 60_000 not in codec.encode("qxzq") and codec.encode("qxzq") == bpe.Codec(bpe.Tables.of(spec)).encode("qxzq")


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_bpe(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    spec = bpe.vocabulary(spark, queries.vocabulary_path())
    odd = bpe.decode(bpe.encode(spark.createDataFrame([(1, None, 3), (2, "", 4)], "doc_id long, text string, decoded int"), spec), spec).collect()
    assert [(r["ids"], r["decoded"]) for r in odd] == [([], ""), ([], "")]
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, "é" * 300_000, "y"), (3, "w" * 50_000, "z")]
    both = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), spec).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in both) == sorted((r[0], r[1]) for r in rows)
    assert all(r["ids"] == library.encode(r["decoded"], add_special_tokens=False).ids for r in both)
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), spec).collect() == []


def test_lm_losses(spark):
    s = lm.Shape()
    a = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], DOCS)
    b = spark.createDataFrame([(1, "stocks fell as markets closed lower")], DOCS)
    target, background = lm.train(a, s), lm.train(a.union(b), s)
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame([(1, "the cat sat"), (2, "markets closed lower"), (3, ""), (4, None)], DOCS), target, background, s).collect()}
    assert got[1]["difference"] < 0 < got[2]["difference"]
    assert got[3]["difference"] is None and got[4]["n_words"] == 0
    words, c, n = ["the", "cat", "sat"], {"the": 2, "cat": 1, "sat": 1}, 6
    p = [(c[w] + 0.5) / (n + 0.5 * (1 << 18)) for w in words]
    follow = [None, 1 / 2, 1 / 1]
    want = np.mean([-np.log(x if f is None else 0.3 * x + 0.7 * f) for x, f in zip(p, follow, strict=True)])
    assert abs(got[1]["target_loss"] - want) < 1e-9


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big = "é" * 30_000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", None), (4, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (5, "u", "s" * 10), (6, "u", "s" * 10), (None, "u", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "w")
    warc.write(pages, path, warc.shared_payloads(pages))
    segments = warc.read(spark, path, True)
    assert segments.count() == 2
    whole = warc.reassemble(segments)
    assert whole.first()["complete"]
    assert not warc.reassemble(segments.where("segment = 1")).first()["complete"]
    back = warc.payload(warc.read(spark, path, False).select("record_id", "type", "block").union(whole.select("record_id", "type", "block"))).collect()
    got = {int(r["record_id"].split(":")[2] or 0): (r["type"], r["payload"]) for r in back}
    assert got[2] == ("response", big.encode()) and got[1][0] == "revisit" and got[3] == ("response", b"")
    assert got[4][1] == rows[3][2].encode() and got[5] == got[6] == ("response", b"s" * 10) and got[0][1] == b"n"
    assert warc.dechunked(warc.chunked(b"x" * 20_000, 7)) == b"x" * 20_000
    facts = [(1, "response", None, "d", None, 9, "d"), (2, "revisit", 9, "d", 1, None, None), (3, "revisit", 8, "d", 1, None, None), (4, "revisit", 9, "e", 1, None, None), (5, "response", None, "x", None, None, None)]
    got = {r["page"]: (r["size"], r["digest"], r["verified"]) for r in warc.resolve(spark.createDataFrame(facts, "page long, type string, told_bytes long, told_digest string, refers long, size long, digest string")).collect()}
    assert got == {1: (9, "d", True), 2: (9, "d", True), 3: (9, "d", False), 4: (None, None, False), 5: (None, None, False)}
    archive = b"".join(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], b"x" * i) + b"\r\n" for i in (0, 5, 3_000_000))
    members = gzip.compress(archive[:200]) + gzip.compress(archive[200:])
    for data in (archive, gzip.compress(archive), members):
        for step in (1000, 1 << 20):
            assert [(r[1], len(r[-1])) for r in warc.parse(warc.unpacked(data, step))] == [("0", 0), ("5", 5), ("3000000", 3_000_000)]
    for data in (archive[:-50], b"nothing"):
        with pytest.raises(ValueError):
            list(warc.parse(warc.unpacked(data)))
    empty = warc.shared_payloads(pages.limit(0))
    warc.write(pages.limit(0), str(tmp_path / "none"), empty)
    assert warc.read(spark, str(tmp_path / "none")).collect() == []
    assert warc.dechunked(b"5\r\nab") is None and warc.http_payload(b"nothing") is None


def test_decontamination(spark):
    item = "A farmer named Tom bought 10 apples for 4 dollars and Tom sold 6 apples to his friend yesterday"
    docs = [
        (1, f"Some words before. {item}. And after."), (2, item.upper()), (3, item.replace("Tom", "Alice").replace("10", "77").replace("4", "5")),
        (4, item.replace("and Tom", "and Bob")), (5, "A farmer went to town and saw many other people there who had never bought apples"), (6, None), (7, ""), (None, item),
    ]
    bench = spark.createDataFrame([(1, item, 0), (2, "", 0), (3, None, 0)], "item_id long, text string, key int")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.contaminated(spark.createDataFrame([(*d, "k") for d in docs], f"{DOCS}, key string"), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1)}
    assert got[1, 1] and got[2, 1] and not got[3, 1]
    assert decontam.contaminated(spark.createDataFrame([], DOCS), bench).collect() == []


def test_licenses(spark):
    docs = spark.createDataFrame(
        [(1, "intro\nReleased under the MIT License.\nend"), (2, "Licensed under the Apache License, Version 2.0."), (3, "the of and\nplain words here to read"), (4, None), (5, "")], DOCS
    )
    model = licenses.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["licenses"]] for r in licenses.scan(docs, model).collect()}
    assert got == {1: [(1, "MIT")], 2: [(0, "Apache-2.0")], 3: [], 4: [], 5: []}


def test_lm_counts_are_exact(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in rng.integers(0, 400_000, 200_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    n, pairs = {}, {}
    for i, w in enumerate(words):
        n[w] = n.get(w, 0) + 1
        if i % 1000:
            pairs[words[i - 1], w] = pairs.get((words[i - 1], w), 0) + 1
    model, few = lm.train(docs), lm.train(docs.where("doc_id < 10"))
    got = {r["doc_id"]: r for r in lm.score(docs, few, model).collect()}
    assert len(got) == len(texts)
    for d in (0, 77, 199):
        own = words[1000 * d : 1000 * d + 1000]
        mine, both = Counter(own), Counter(zip(own, own[1:], strict=False))
        count = {w: n[w] - mine[w] for w in own}
        p = [(count[w] + 0.5) / (len(words) - 1000 + 0.5 * (1 << 18)) for w in own]
        want = [-np.log(p[0])]
        for i in range(1, 1000):
            a = own[i - 1]
            want.append(-np.log(0.3 * p[i] + 0.7 * (pairs[a, own[i]] - both[a, own[i]]) / count[a] if count[a] else p[i]))
        assert abs(got[d]["background_loss"] - np.mean(want)) < 1e-9


def lm_by_hand(texts, counted):
    """Mean losses of each text under the model of the texts in `counted`, without itself."""
    cut = {i: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) for i, t in texts.items()}
    word, pair = Counter(), Counter()
    every = set()
    for i, w in cut.items():
        every |= set(w)
        if i in counted:
            word.update(w)
            pair.update(zip(w, w[1:], strict=False))
    out = {}
    for i, w in cut.items():
        own, two = (Counter(w), Counter(zip(w, w[1:], strict=False))) if i in counted else (Counter(), Counter())
        total = sum(word.values()) - sum(own.values())
        sums = []
        for k, x in enumerate(w):
            p = (word[x] - own[x] + 0.5) / (total + 0.5 * max(1 << 18, len(every)))
            before = word[w[k - 1]] - own[w[k - 1]] if k else 0
            sums.append(-np.log(0.3 * p + 0.7 * (pair[w[k - 1], x] - two[w[k - 1], x]) / before if before else p))
        out[i] = np.mean(sums) if sums else None
    return out


def test_lm_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    want = lm_by_hand(texts, clean), lm_by_hand(texts, set(texts))
    got = {r["doc_id"]: r for r in queries.op7_lm_scores(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, r in got.items():
        for name, w in zip(("target_loss", "background_loss"), want, strict=True):
            assert r[name] is w[d] or abs(r[name] - w[d]) < 1e-9


def test_lm_tells_what_occurs_twice(spark):
    rng = random.Random(3)
    make = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    texts = [make() for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[7], "", None])), "doc_id long, difference string").withColumnRenamed("difference", "text")
    m = lm.train(docs)
    got = {r["doc_id"]: r["background_loss"] for r in lm.score(docs, m, m).collect()}
    assert max(got[7], got[60]) < min(v for d, v in got.items() if v is not None and d not in (7, 60)) and got[61] is None
    assert lm.score(docs.limit(0), lm.train(docs.limit(0)), lm.train(docs.limit(0))).collect() == []


def test_decontamination_filter_holds_all_keys(spark):
    keys = np.random.default_rng(2).integers(0, 1 << 63, 70_000, dtype=np.int64)
    bits = decontam._bloom(spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(5), len(keys))
    assert 8 * len(bits) == 1 << 21

    def passed(h):
        at = np.arange(len(h))
        for place in decontam._places(h, 8 * len(bits)):
            at = at[(bits[(p := place(at)) >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
        return len(at)

    np.seterr(over="ignore")
    assert passed(keys.view(np.uint64)) == len(keys) and passed(np.random.default_rng(3).integers(0, 1 << 63, 100_000, dtype=np.uint64)) < 500


def test_decontamination_odd_tables(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"w{i}x" for i in range(200_000))
    docs = [(1, item, "a"), (1, item, "a"), (2, f"{long} {item}", "b"), (3, "", "c")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item, 1.0), (7, item, 1.0), (8, item, 2.0)], "item_id long, text string, coverage double")
    got = sorted((r["doc_id"], r["item_id"], r["coverage"], r["exact"], r["start"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(1, 7, 1.0, True, 0), (1, 8, 1.0, True, 0), (2, 7, 1.0, True, 200_000), (2, 8, 1.0, True, 200_000)]
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def held(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), DOCS), bench).collect()}


def test_decontamination_names(spark):
    item = "A farmer named Tom bought 10 apples for 4 dollars and Tom sold 6 apples to his friend yesterday"
    start = "John has twelve red marbles in his bag today. John buys seven more green marbles from the shop. John gives half of them away."
    docs = [item.upper(), item.lower(), start.replace("John", "Maria"), start.upper()]
    assert held(spark, [item, start], docs) == {(0, 0), (1, 0), (2, 1), (3, 1)}


def test_decontamination_short_items(spark):
    items = ["How tall is the Eiffel Tower?", "Why?", "What is 7 plus 5?", ""]
    docs = ["Some words. How tall is the Eiffel Tower? It is tall.", "He asked why and left", "we ask what is 7 plus 5? Easy", "how tall is the man", "What is 7"]
    assert held(spark, items, docs) == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_near_copies(spark):
    fifteen = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    twenty = f"{fifteen} pi rho sigma tau upsilon"
    city = "The train that leaves Paris at 7 in the morning reaches the coast before noon on every day"
    docs = [fifteen.replace(" theta ", " other "), twenty.replace(" kappa ", " kappa extra "), city.replace("Paris", "New York").replace("7", "1,250"), city.replace("7", "3.5"), "alpha beta gamma and other letters"]
    got = held(spark, [fifteen, twenty, city], docs)
    assert {(0, 0), (1, 1), (2, 2), (3, 2)} <= got and not any(d == 4 for d, _ in got)


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))


def found(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: [(x["paragraph"], x["lines"], x["family"]) for x in r["licenses"]] for r in licenses.scan(docs, model).collect()}
    return [got[i] for i in range(len(texts))]


def test_licenses_of_all_lines(spark, license_model):
    lines = ["SPDX-License-Identifier: MIT", "License: GPLv3", "Licensed under the Eclipse Public License 2.0", "Licensed under the Mozilla Public License 2.0.", "the river was wide and cold"]
    got = found(spark, license_model, ["\n\n".join(lines)])[0]
    assert [f for _, _, f in got] == ["MIT", "GPL", "unknown", "MPL"]


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights.",
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License.",
}
UNSEEN = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License.",
    "Boost Software License, Version 1.0: permission is hereby granted to any person or organization obtaining a copy.",
]
PLAIN = ["The permission to enter was granted by the guard at noon.", "We met the author of the work in a public garden.", "A free copy of the book lies on the table", "The source of the river is high in the hills.", "any version of the story is true", "This."]


def test_licenses_wrapped_unseen_and_plain(spark, license_model):
    texts = [f"Some words of the document.\n\n{t}\n\nThe end." for t in (*WRAPPED.values(), *UNSEEN, *PLAIN)]
    got = found(spark, license_model, texts)
    for family, own in zip(WRAPPED, got, strict=False):
        assert own == [(2, WRAPPED[family].count("\n") + 1, family)], (family, own)
    unseen = got[len(WRAPPED) : len(WRAPPED) + len(UNSEEN)]
    assert all({f for _, _, f in own} <= {"unknown"} for own in unseen) and sum(map(bool, unseen)) >= len(UNSEEN) - 1, unseen
    assert not any(got[len(WRAPPED) + len(UNSEEN) :])


def test_licenses_precision_and_recall(spark, license_model):
    rng = random.Random(77)
    cases = [(f, " ".join(w for w in t.split() if rng.random() > 0.1)) for f, ts in licenses.TEMPLATES.items() for t in ts for _ in range(5)]
    got = found(spark, license_model, [t for _, t in cases])
    told = [[x[2] for x in own if x[2] != "unknown"] for own in got]
    right = sum(f in own for (f, _), own in zip(cases, told, strict=True))
    assert right >= 0.85 * len(cases) and right >= 0.97 * sum(map(len, told)), (right, len(cases), sum(map(len, told)))


def test_licenses_odd_rows(spark, license_model):
    rows = [(1, "MIT License", "x"), (1, "MIT License", "x"), (2, "plain words " * 100_000 + "\nReleased under the MIT License.", "y"), (3, None, "z"), (4, " \n\n", "z")]
    got = sorted((r["doc_id"], [x["family"] for x in r["licenses"]]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string"), license_model).collect())
    assert got == [(1, ["MIT"]), (1, ["MIT"]), (2, ["MIT"]), (3, []), (4, [])]
    blank = licenses.train(spark.createDataFrame([], DOCS))
    assert licenses.scan(spark.createDataFrame([], DOCS), blank).collect() == []


def test_items_of_one_id_and_very_short_items(spark):
    one = "The quiet river runs past seven mills before the town begins to sell bread and salt"
    two = "Every lantern on the northern wall was lit by a keeper who never spoke of storms"
    bench = spark.createDataFrame([(1, one), (1, two), (1, one), (2, "the"), (3, "the end"), (4, "what now then")], "item_id long, text string")
    docs = [f"Before. {one}. After.", f"Before. {two}. After.", f"{one} {two}", "the", "The end.", "the end is near, what now then", "the clean text of a walk in the hills"]
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), DOCS), bench, least=3)
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in got.collect()) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (5, 4, 1.0)]


def test_many_segments_keep_every_byte(spark):
    import random

    parts = [random.Random(k).randbytes(1 << 15) for k in range(600)]
    rows = [("u", f"r{k}", "response", None, None, None, None, k, "r1" if k > 1 else None, len(b"".join(parts)) if k == 600 else None, bytearray(b)) for k, b in enumerate(parts, 1)]
    random.Random(1).shuffle(rows)
    names = "uri string, record_id string, type string, date string, payload_digest string, refers_to string, payload_length long, segment long, origin_id string, total_length long, block binary"
    got = warc.reassemble(spark.createDataFrame(rows, names)).first()
    assert got["complete"] and bytes(got["block"]) == b"".join(parts)
