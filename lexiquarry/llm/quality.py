"""Document quality without gold labels: weak labellers, EM, and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Expectation-maximisation over the counts of vote patterns (all documents
count; there are few patterns) estimates how often each labeller casts each
vote on good and on bad documents, and from that the posterior of a pattern.
A linear scorer over hashed shape trigrams learns the posteriors on a bounded
sample and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._fit import drawn, sigmoid, sparse_logistic
from ._kernel import ALNUM, NON_SPACE, U, Words, blocks, buffers, byte_class, mix
from ._store import Store

ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "capitals", "exclamations", "pipes", "repeats", "function_words", "sentences", "letters")
#: The first labellers are detectors: they vote bad or not at all.
DETECTORS = 5
#: Prior of the estimation, in multiples of a class's documents: detectors abstain on good documents,
#: and the others vote rightly. It ties the classes to their names and keeps a kind of junk that only
#: one detector knows from passing as good.
PRECISE, TRUST = 20.0, 0.05
#: Buckets of the hashed shape trigrams; four plain ratios follow them.
BUCKETS = 4096
RATIOS = 4
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et un une du en que qui dans pour par sur au pas plus est ne se ce il sont avec "
    "el los las y del por con para una su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre"
)
_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_UPPER = byte_class((0x41, 0x5A))
_ASCII_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
_SYMBOLS = byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_ENDS = byte_class((0x2E, 0x2E), (0x3F, 0x3F), (0x21, 0x21))


def _shape_classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, white space, and each ASCII mark for itself."""
    out = np.arange(256, dtype=np.int64)
    out[_LETTERS] = ord("a")
    out[_UPPER] = ord("A")
    out[0x30:0x3A] = ord("0")
    out[[0x09, 0x0B, 0x0C, 0x0D]] = 0x20
    return out


_SHAPE = _shape_classes()


def _known(words: str) -> np.ndarray:
    raw = words.encode()
    return np.unique(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM).hashes())


_FUNCTION = _known(FUNCTION_WORDS)


class Look:
    """What labellers and scorer see of a block of texts."""

    def __init__(self, part: pa.RecordBatch, text: str):
        data, self.offsets = buffers(part.column(text))
        self.data, self.docs = data, len(self.offsets) - 1
        words = Words(data, self.offsets, NON_SPACE)
        h = words.hashes()
        self.words = np.diff(words.bounds)
        many = np.maximum(self.words, 1)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        first = words.bounds[:-1][self.words > 0]
        same[first] = False
        self.repeats = self._sum(same, words.bounds) / many
        plain = Words(data, self.offsets, ALNUM)
        self.function = self._sum(np.isin(plain.hashes(), _FUNCTION), plain.bounds) / np.maximum(np.diff(plain.bounds), 1)
        count = lambda mask: self._sum(mask[data], self.offsets)
        only = lambda c: byte_class((ord(c), ord(c)))
        self.symbols = count(_SYMBOLS) / many
        self.capitals = count(_UPPER) / np.maximum(count(_ASCII_LETTERS), 1)
        self.bangs = count(only("!")) / many
        self.pipes = count(only("|")) / many
        self.ends = count(_ENDS) / many
        self.letters = count(ALNUM) / np.maximum(count(NON_SPACE), 1)

    @staticmethod
    def _sum(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def votes(self) -> np.ndarray:
        """A vote for each labeller and text.

        The detectors of junk vote bad or abstain, the others either way; in
        texts of fewer than five words all abstain.
        """
        rule = lambda bad, good=False: np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
        long = self.words >= 20
        out = np.column_stack(
            [
                rule(self.symbols > 0.4),
                rule(self.capitals > 0.4),
                rule(self.bangs > 0.3),
                rule(self.pipes > 0.2),
                rule(self.repeats > 0.3),
                rule(long & (self.function < 0.02), self.function > 0.08),
                rule(long & (self.ends < 0.01), (self.ends > 0.02) & (self.ends < 0.5)),
                rule(self.letters < 0.7, self.letters > 0.8),
            ]
        )
        out[self.words < 5] = ABSTAIN
        return out

    def shapes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of each trigram of the texts' byte classes, runs of one class taken once."""
        cls = _SHAPE[self.data]
        new = np.ones(len(cls), bool)
        new[1:] = cls[1:] != cls[:-1]
        new[self.offsets[:-1][self.offsets[:-1] < len(cls)]] = True
        at = np.flatnonzero(new)
        seq, doc = cls[at], np.searchsorted(self.offsets, at, "right") - 1
        if len(seq) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tri = (seq[:-2] << 16) | (seq[1:-1] << 8) | seq[2:]
        inside = doc[:-2] == doc[2:]
        return (mix(tri[inside].astype(U)) % U(BUCKETS)).astype(np.int64), doc[:-2][inside]

    def ratios(self) -> np.ndarray:
        return np.column_stack([self.repeats, np.minimum(self.function, 0.3) * 3, self.capitals, np.minimum(self.symbols, 2)])


@dataclass
class Model:
    patterns: dict[str, float]  # posterior of being good, by vote pattern
    accuracy: dict[str, tuple[float, float]]  # labeller: how often it votes good on good, bad on bad
    weights: np.ndarray
    constant: float


def votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `pattern`: a digit for each labeller (0 abstains, 1 bad, 2 good)."""
    kept = [c for c in docs.columns if c != "pattern"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                v = Look(part, text).votes().astype(np.uint8) + 48
                found = [r.tobytes().decode() for r in v]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept if c != text), pa.array(found, pa.string())], names=[*(c for c in kept if c != text), "pattern"])

    plain = docs.select(*(F.col(f"`{c}`") for c in kept))
    fields = [f for f in plain.schema.fields if f.name != text]
    return plain.mapInArrow(run, T.StructType([*fields, T.StructField("pattern", T.StringType())]))


def em(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """(posterior of good by pattern, labellers' accuracies) of a two-class model with independent labellers.

    The pattern without votes is always among the posteriors; as nothing speaks
    against it, it gets the share of good documents, one half at least.
    """
    if not patterns:
        return {}, {}
    names = sorted({"0" * len(LABELLERS): 0} | patterns)
    v = np.array([[int(c) for c in x] for x in names])
    n = np.array([patterns.get(x, 0) for x in names], float)
    good = np.where((v == BAD).any(1), 0.1, np.where((v == GOOD).any(1), 0.99, 0.5))
    for _ in range(rounds):
        prior = np.clip(n @ good / n.sum(), 0.02, 0.98)
        log = np.log([prior, 1 - prior])[None, :].repeat(len(names), 0)
        for k in range(v.shape[1]):
            for c, w in enumerate((good, 1 - good)):
                p = np.array([(n * w)[v[:, k] == x].sum() + 0.5 for x in (ABSTAIN, BAD, GOOD)])
                if c == 0 and k < DETECTORS:
                    p[ABSTAIN] += PRECISE * (n * w).sum()
                elif k >= DETECTORS:
                    p[GOOD if c == 0 else BAD] += TRUST * (n * w).sum()
                log[:, c] += np.log(p / p.sum())[v[:, k]]
        good = sigmoid(log[:, 0] - log[:, 1])
    good[names.index("0" * len(LABELLERS))] = max(0.5, float(n @ good / n.sum()))
    rate = lambda k, w, vote: float((n * w)[v[:, k] == vote].sum() / max((n * w).sum(), 1e-9))
    told = {name: (rate(k, good, GOOD), rate(k, 1 - good, BAD)) for k, name in enumerate(LABELLERS)}
    return dict(zip(names, good.tolist(), strict=True)), told


def _sampled_shapes(rows: DataFrame) -> DataFrame:
    """One row for each sampled text: pattern, and its non-zero buckets with their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                look = Look(part, "text")
                bucket, doc = look.shapes()
                key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
                total = np.bincount(doc, minlength=look.docs)
                at = np.searchsorted(key // BUCKETS, np.arange(look.docs + 1))
                share = count / np.maximum(total[key // BUCKETS], 1)
                pattern = [r.tobytes().decode() for r in look.votes().astype(np.uint8) + 48]
                ends = pa.array(at.astype(np.int32))
                ratios = look.ratios()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pattern, pa.string()),
                        pa.ListArray.from_arrays(ends, pa.array((key % BUCKETS).astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(share.astype(np.float32))),
                        pa.ListArray.from_arrays(pa.array(np.arange(look.docs + 1, dtype=np.int32) * RATIOS), pa.array(ratios.ravel().astype(np.float32))),
                    ],
                    names=["pattern", "buckets", "shares", "ratios"],
                )

    return rows.select("text").mapInArrow(run, "pattern string, buckets array<int>, shares array<float>, ratios array<float>")


def train(docs: DataFrame, bound: int = 6000, id: str = "doc_id", text: str = "text") -> Model:
    """Learn from all documents' votes; the scorer from about `bound` documents drawn by a hash of their id.

    The driver gets the counts of vote patterns (no more than 3 ** labellers)
    and the drawn documents' shapes. Null, empty and blank texts vote like all
    others, null ones don't train the scorer; repeated rows count each time.
    Without any documents the scorer is untrained: 0.5 for every text with words.
    Other columns are not read.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    store = Store(docs.sparkSession, "quality")
    counted = store.table(votes(rows).groupBy("pattern").count(), "patterns")
    counts = {r["pattern"]: r["count"] for r in counted.collect()}
    posterior, accuracy = em(counts)
    sample = _sampled_shapes(rows.where(drawn("id", sum(counts.values()), bound, 31)).where("text is not null")).toPandas()
    sample = sample[[p in posterior for p in sample["pattern"]]]
    if not len(sample):
        return Model(posterior, accuracy, np.zeros(BUCKETS + RATIOS), 0.0)
    y = np.array([posterior[p] for p in sample["pattern"]])
    n = [len(b) for b in sample["buckets"]]
    row = np.concatenate([np.repeat(np.arange(len(y)), n), np.repeat(np.arange(len(y)), RATIOS)])
    col = np.concatenate([*sample["buckets"], np.tile(np.arange(BUCKETS, BUCKETS + RATIOS), len(y))]).astype(np.int64)
    value = np.concatenate([10 * np.concatenate(list(sample["shares"])), np.concatenate(list(sample["ratios"]))]).astype(float)
    weights, constant = sparse_logistic(row, col, value, y, BUCKETS + RATIOS, ridge=0.3, steps=150, rate=0.3)
    store.drop(counted)
    return Model(posterior, accuracy, weights, constant)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `quality` (0 to 1) and `good` (from 0.5 on).

    Null, empty and blank texts have quality 0. A row is judged by its whole
    text alone, however long, so repeated rows get equal values. Columns of
    the two names are replaced, all others kept.
    """
    new = ("quality", "good")
    kept = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in blocks(batch, text):
                look = Look(part, text)
                bucket, doc = look.shapes()
                mean = np.bincount(doc, m.weights[bucket], look.docs) / np.maximum(np.bincount(doc, minlength=look.docs), 1)
                q = np.where(look.words > 0, sigmoid(10 * mean + look.ratios() @ m.weights[BUCKETS:] + m.constant), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(q), pa.array(q >= 0.5)], names=[*kept, *new])

    plain = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*plain.schema.fields, T.StructField("quality", T.DoubleType()), T.StructField("good", T.BooleanType())])
    return plain.mapInArrow(run, schema)
