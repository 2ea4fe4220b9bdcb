"""Toxic passages: maximum-scoring segments over token log-odds.

A token's score is its log-odds between toxic and other labelled texts, with
a Dirichlet prior in proportion to the token's share of both (rare words are
drawn to zero). Tokens are words and the beginnings of words, of which the
longest that is known counts; tokens whose score isn't several standard errors from zero
count as a small loss. A linear-time scan finds every maximal segment of a
text. A segment's score becomes an E-value by extreme-value statistics
(Karlin-Altschul): the expected number of segments of at least this score in
a clean text of that length. The text's score is a logistic calibration of
its best E-value and of the total of its significant segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._fit import drawn, logistic, sigmoid
from ._kernel import ALNUM, U, Words, blocks, buffers, mix
from ._store import Store

PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))


@dataclass
class Model:
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted hashes
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other: float = -0.1  # of a token that the model doesn't have
    scale: float = 1.0  # Karlin-Altschul's lambda and K
    k: float = 0.1
    weights: tuple[float, ...] = (0.0, 0.0, -4.0)  # of surprise, total and one
    significant: float = 0.05

    def e_value(self, score: float, length: int) -> float:
        return self.k * max(length, 1) * math.exp(-self.scale * score)


#: Bytes of the word beginnings that are tokens beside the whole words.
STEMS = (5, 6, 7, 8)


def _tokens(words: Words) -> Iterator[np.ndarray]:
    """For each stem length, then for whole words: a hash for each word (0 where the word is no longer than the stem)."""
    length = words.ends - words.starts
    whole = words.hashes()
    for n in STEMS:
        cut = words.hashes(np.minimum(words.starts + n, words.ends))
        yield np.where(length > n, mix(cut + U(n)), U(0)).view(np.int64)
    yield whole.view(np.int64)


def _word_scores(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score, known) of each word: that of the longest token of it that the model has."""
    scores, known = np.full(len(words.starts), model.other), np.zeros(len(words.starts), bool)
    if len(model.tokens):
        for h in _tokens(words):
            at = np.searchsorted(model.tokens, h)
            at[at == len(model.tokens)] = 0
            hit = model.tokens[at] == h
            scores[hit] = model.scores[at[hit]]
            known |= hit
    return scores, known


def _words(part: pa.RecordBatch, text: str) -> Words:
    lower = pc.utf8_lower(pc.fill_null(part.column(text), ""))
    return Words(*buffers(lower), ALNUM)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence, in linear time (Ruzzo and Tompa)."""
    # Each candidate: start, end, running sum before it, running sum at its end.
    stack: list[tuple[int, int, float, float]] = []
    before: list[int] = []  # for each candidate, the nearest earlier one with a smaller sum before it
    total = 0.0
    for i, s in enumerate(scores):
        left = total
        total += s
        if s <= 0:
            continue
        now = (i, i + 1, left, total)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j = before[j]
            if j < 0 or stack[j][3] >= now[3]:
                stack.append(now)
                before.append(j)
                break
            now = (stack[j][0], now[1], stack[j][2], now[3])
            del stack[j:], before[j:]
    return [(a, b, r - x) for a, b, x, r in stack]


def passages(scores: np.ndarray, known: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments of one text's words; a run of words that the model doesn't have is one item of the scan."""
    at = np.flatnonzero(known)
    if not (scores[at] > 0).any():
        return []
    items, places = [], []
    last = 0
    for i, s in zip(at.tolist(), scores[at].tolist(), strict=True):
        if i > last:
            items.append(float(scores[last]) * (i - last))
            places.append((last, i))
        items.append(s)
        places.append((i, i + 1))
        last = i + 1
    return [(places[a][0], places[b - 1][1], s) for a, b, s in segments(items)]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id's text leaves no remainder by 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def _counts(rows: DataFrame) -> DataFrame:
    """(token, toxic, texts): labelled texts that hold a token, summed over batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 4 << 20):
                words = _words(part, "text")
                kinds = [h.view(U) for h in _tokens(words)]
                h, doc = np.concatenate(kinds), np.tile(words.doc_of_word(), len(kinds))
                h, doc = h[h > 0], doc[h > 0]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new]
                if len(h):
                    tokens, start = np.unique(h, return_index=True)
                    toxic = np.add.reduceat(np.asarray(part.column("toxic"), np.int64)[doc], start)
                    texts = np.diff(np.append(start, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(toxic), pa.array(texts)], names=["token", "toxic", "texts"])

    found = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(run, "token long, toxic long, texts long")
    return found.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))


def _best(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, length, best, total) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                words = _words(part, "text")
                value, known = _word_scores(words, model)
                b = words.bounds
                found = [passages(value[b[i] : b[i + 1]], known[b[i] : b[i + 1]]) for i in range(part.num_rows)]
                best = [max((s for _, _, s in x), default=0.0) for x in found]
                total = [sum(s for _, _, s in x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(np.diff(b)), pa.array(best, pa.float64()), pa.array(total, pa.float64())], names=["toxic", "length", "best", "total"])

    return rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(run, "toxic long, length long, best double, total double")


def _features(model: Model, length: np.ndarray, best: np.ndarray, total: np.ndarray) -> np.ndarray:
    e = model.k * np.maximum(length, 1) * np.exp(-model.scale * best)
    surprise = -np.log(np.maximum(-np.expm1(-e), 1e-12))
    return np.column_stack([np.where(best > 0, surprise, 0.0), np.log1p(total)])


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, prior: float = 0.05, errors: float = 3.0) -> Model:
    """Learn a model from labelled rows.

    docs: doc_id, text; labels: doc_id, toxic. About `bound` labelled rows are
    drawn by a hash of their id, four fifths for token counts and one for the
    extreme-value and logistic fits; so the model's size and what the driver
    gets are bounded. Rows with a null id, text or label tell nothing, nor do
    labels of ids without a document; repeated labels count each time. Without
    rows of both labels the model finds nothing toxic and gives a constant score.
    """
    labels = labels.select("doc_id", "toxic").dropna()
    n = labels.count()
    picked = labels.where(drawn("doc_id", n, bound, 21))
    # At most about `bound` rows of 12 bytes: a size that doesn't grow with the data.
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(picked), "doc_id")
    store = Store(docs.sparkSession, "toxicity")
    rows = store.table(rows, "labelled")
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit(22)), F.lit(5)) == 0
    counts = store.table(_counts(rows.where(~calibrate)), "counts")
    sums = counts.agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")).first()
    model = Model()
    if not sums["texts"] or not sums["toxic"] or sums["toxic"] == sums["texts"]:
        return model
    n_tox, n_all = float(sums["toxic"]), float(sums["texts"])
    n_clean = n_all - n_tox
    strength = prior * n_all
    a = F.col("texts") * F.lit(prior)
    tox, clean = F.col("toxic") + a, F.col("texts") - F.col("toxic") + a
    odds = F.log(tox / (n_tox + strength - tox)) - F.log(clean / (n_clean + strength - clean))
    scored = counts.select("token", odds.alias("score"), F.sqrt(1 / tox + 1 / clean).alias("error"), (clean / (n_clean + strength)).alias("share"))
    kept = scored.where(F.abs("score") > errors * F.col("error")).toPandas().sort_values("token")
    model.tokens, scores, share = kept["token"].to_numpy(np.int64), kept["score"].to_numpy(), kept["share"].to_numpy()
    model.scores = np.where(scores < 0, np.maximum(scores, -1.0), scores)
    rest = max(1 - share.sum(), 1e-6)

    def excess(x: float) -> float:
        return float(np.sum(share * np.exp(np.minimum(x * model.scores, 500)))) + rest * math.exp(x * model.other) - 1

    low, high = 1e-6, 1e-6
    while excess(high) <= 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) <= 0 else (low, mid)
    model.scale = high
    fit = _best(rows.where(calibrate), model).toPandas()
    y, length, best, total = (fit[c].to_numpy() for c in ("toxic", "length", "best", "total"))
    if (y == 0).any():
        model.k = float((y == 0).sum() / np.maximum(length, 1)[y == 0].dot(np.exp(-model.scale * best[y == 0])))
    if 0 < y.sum() < len(y):
        model.weights = tuple(logistic(_features(model, length, best, total), y, ridge=0.1).tolist())
    store.drop(rows, counts)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1), predicted (1 from 0.5 on) and passages (start, end, score, e_value).

    Passages are the significant maximal segments; start and end count code
    points of the lower-cased text. Null and empty texts have no passage and
    the score of a text without toxic words. Texts are read whole, however long,
    and repeated rows get equal values; a null id is no obstacle. Columns of the
    three names are replaced, all others kept.
    """
    new = ("score", "predicted", "passages")
    kept = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            for part in blocks(batch, text):
                words = _words(part, text)
                value, known = _word_scores(words, m)
                b, n = words.bounds, part.num_rows
                best, total, spans = np.zeros(n), np.zeros(n), [[] for _ in range(n)]
                rows = np.unique(np.searchsorted(b, np.flatnonzero(value > 0), "right") - 1)
                lead = None
                for i in rows.tolist():
                    found = passages(value[b[i] : b[i + 1]], known[b[i] : b[i + 1]])
                    best[i] = max(s for _, _, s in found)
                    total[i] = sum(s for _, _, s in found)
                    if lead is None:  # code points before each byte
                        lead = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                    base = lead[words.offsets[i]]
                    for x, y, s in found:
                        e = m.e_value(s, int(b[i + 1] - b[i]))
                        if e <= m.significant:
                            spans[i].append({"start": int(lead[words.starts[b[i] + x]] - base), "end": int(lead[words.ends[b[i] + y - 1]] - base), "score": s, "e_value": e})
                p = sigmoid(_features(m, np.diff(b), best, total) @ np.array(m.weights[:2]) + m.weights[2])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=[*kept, *new]
                )

    plain = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", PASSAGES)])
    return plain.mapInArrow(run, schema)
