import random
import re

import pytest

from lexiquarry.llm import minhash
from lexiquarry.llm.minhash import MinMax


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    texts = []
    for _ in range(6):  # groups of edited copies, some of which only hang together through others
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(1, 7)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    texts += [" ".join([*passage, *(word() for _ in range(40))]) for _ in range(40)]
    texts += [texts[0], texts[0].upper(), "", " \n ", "one", "one two", "One  Two", None, "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("size", "percent", "bands"), [(3, 85, 30), (5, 80, 45)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, bands):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    rows = corpus(size)
    docs = spark.createDataFrame([(i, t, 1, None) for i, t in rows], "doc_id long, text string, component int, sketch string").repartition(5)
    got = minhash.near_duplicates(docs, MinMax(size, percent, bands)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], schema)).collect()
    assert sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in got) == [(0, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]
