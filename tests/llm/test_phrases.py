import random
import re
from collections import Counter

import pytest

from lexiquarry.llm import phrases

LONG = "alpha beta gamma. " * 40_000


def plain(rows, max_n=3, least=10, percent=50, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            f.update(("und" if lang is None else lang, w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    totals = Counter()
    for (lang, w), n in f.items():
        totals[lang] += n if len(w) == 1 else 0
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), z in cands.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                part = lang, w[i : i + n]
                if 100 * z >= percent * cands.get(part, 10**9):
                    covered.add(part)
    out = []
    for lang in totals:
        rows = []
        for (own, w), a in cands.items():
            if own != lang or (own, w) in covered:
                continue
            cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    words = ["Ab", "ab", "c", "É", "é", "d\xa0e", "x-y", "日本", "\U0001d4b3", "𝒳z", "\x0e"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", " ! "]
    langs = ["en", "de", None, "und", ""]
    rows = [(rng.choice(langs), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for _ in range(size)]
    return [*rows, (None, None), ("en", ""), ("de", " .,\n"), ("zz", None), ("en", LONG), ("en", LONG), *rows[:5]]


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "n", "score", "k1") for r in rows], "lang string, text string, n string, score string, key string")
    return sorted(tuple(r) for r in phrases.mine(docs, **options).collect())


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"max_n": 4, "least": 5, "percent": 80}), (3, {"least": 2, "top": 7}), (4, {"max_n": 2, "least": 1})])
def test_equal_to_brute_force(spark, seed, options):
    rows = corpus(seed, 150)
    want = plain(rows, **options)
    assert mined(spark, rows, **options) == want and len(want) > 10


def test_words_that_share_a_key_get_new_ones(spark):
    rows = corpus(5, 60)
    # About 45 words in 2^11 keys meet often; a seed without a meeting gives the same counts.
    assert mined(spark, rows, bits=11) == plain(rows)
    with pytest.raises(ValueError, match="seeds"):
        mined(spark, rows, bits=2)


def test_nothing(spark):
    assert mined(spark, []) == [] == mined(spark, [(None, None), ("en", "")])


def test_no_row_for_each_gram_is_shuffled(spark):
    docs = spark.createDataFrame([("en", " ".join(f"w{i}" for i in range(5000)))], "lang string, text string")
    rows = phrases._words(docs, 0, 64, 7)
    assert rows.count() == 5000 and "bucket" in rows._jdf.queryExecution().executedPlan().toString()
    batches = phrases._dealt(phrases._cuts(phrases.np.arange(0, 1 << 63, 1 << 60, dtype="uint64"), 3), lambda a, b: bytes([a, b]))
    assert batches.to_pylist() == [{"bucket": 0, "data": bytes([0, 6])}, {"bucket": 1, "data": bytes([6, 8])}]


def test_runs_that_share_a_key_are_told_apart(monkeypatch):
    u = lambda *x: phrases.np.array(x, "uint64")
    monkeypatch.setattr(phrases, "gram_key", lambda keys: keys[0] & phrases.U(1))
    keys, n = phrases._added([u(1, 3, 1, 2, 3), u(7, 7, 7, 7, 7)])
    assert sorted(zip(*(k.tolist() for k in keys), n.tolist(), strict=True)) == [(1, 7, 2), (2, 7, 1), (3, 7, 2)]
    keys, n = phrases._added(keys, n)
    assert sorted(zip(*(k.tolist() for k in keys), n.tolist(), strict=True)) == [(1, 7, 2), (2, 7, 1), (3, 7, 2)]
