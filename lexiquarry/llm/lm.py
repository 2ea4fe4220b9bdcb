"""Cross-entropy difference of two matched n-gram models.

Both models are interpolated bigram models over one vocabulary, with the same
smoothing; only the counts differ. Counts are exact: every word and every word
pair has its own 64-bit key, and a model has as many keys as its texts. No task
or driver holds a model: chunks of documents send their distinct keys to
buckets of the key space, a bucket adds up its keys' counts, and the counts go
back to the chunks. A document's score is the mean over its words of the loss
under the target model less the loss under the background model: the lower,
the more it is like the target. What a document itself adds to a model is
taken off before it is scored by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernel import ALNUM, U, Words, blocks, buffers, mix, release
from ._store import Store

#: Bytes of text of which a chunk's keys are distinct.
CHUNK_BYTES = 8 << 20
#: Keys, as chunks give them out, of one bucket, about.
BUCKET_KEYS = 1 << 21


@dataclass(frozen=True)
class Shape:
    """Parameters that both models share."""

    least_words: int = 1 << 18  # the vocabulary that smoothing reckons with, or the models' own if that is larger
    trust: float = 0.7  # of the bigram estimate against the unigram one
    add: float = 0.5  # to every word count


@dataclass
class Model:
    """The texts that a model counts; the counts are made where they are used, by bucket."""

    docs: DataFrame
    text: str
    where: Column


def _keys(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word keys, pair keys, whether a word has one before it, bounds by text); word keys are even, pair keys odd."""
    found = []
    for block in blocks(part, text):
        words = Words(*buffers(pc.utf8_lower(pc.fill_null(block.column(text), ""))), ALNUM)
        h = words.hashes() & ~U(1)
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        inner = np.ones(len(h), bool)
        inner[words.bounds[:-1][words.bounds[:-1] < words.bounds[1:]]] = False
        found.append((h, mix(before * U(0x9FB21C651E98DF25) + h) | U(1), inner, np.diff(words.bounds)))
    word, pair, inner, n = (np.concatenate(x) for x in zip(*found, strict=True))
    return word, pair, inner, np.concatenate([[0], np.cumsum(n)])


def _pack(a: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    raw = np.ascontiguousarray(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64).ravel()


#: Columns that say whether a row is the target's and the background's.
_T, _B = "counts in target", "counts in background"
_CHUNKS = "scored int, chunk long, keys binary, target binary, background binary, size long, docs binary"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])


def _chunks(docs: DataFrame, text: str, scored: bool) -> DataFrame:
    """The distinct keys of each chunk of documents with both counts (scored 0); of chunks to score the rows also (scored 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, text, CHUNK_BYTES):
                word, pair, inner, bounds = _keys(part, text)
                keys, at = np.unique(np.concatenate([word, pair[inner]]), return_inverse=True)
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                doc = np.concatenate([doc, doc[inner]])
                n = [np.bincount(at[np.asarray(part.column(c))[doc]], minlength=len(keys)) for c in (_T, _B)]
                yield _rows([(0, number if scored else None, _pack(np.diff(keys.view(np.int64), prepend=0)), *map(_pack, n), len(keys), None)], _CHUNKS)
                if scored:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(part)
                    yield _rows([(1, number, None, None, None, None, sink.getvalue().to_pybytes())], _CHUNKS)
                number += 1
                release()

    return docs.mapInArrow(run, _CHUNKS)


_PARTS = "chunk long, bucket int, keys binary, target binary, background binary"


def _dealt(chunks: DataFrame, bits: int) -> DataFrame:
    """The chunks' keys and counts cut at the bounds of 2^bits buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                keys = np.cumsum(_unpack(r["keys"])).view(U)
                n = [_unpack(r[c]) for c in ("target", "background")]
                cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits)).tolist() if bits else []
                cuts = [0, *cuts, len(keys)]
                rows = [(r["chunk"], k, _pack(np.diff(keys[a:b].view(np.int64), prepend=0)), *(_pack(x[a:b]) for x in n)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                yield _rows(rows, _PARTS)

    return chunks.select("chunk", "keys", "target", "background").mapInArrow(run, _PARTS)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them ends; what is read later is in tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def train(docs: DataFrame, s: Shape = Shape(), text: str = "text", where: Column | None = None) -> Model:
    """A model of all texts of `docs`, or of those `where` a condition holds; models of one frame are counted in one pass.

    Null, empty and blank texts add nothing, repeated rows add each time. A
    model of no text has no counts: every word is equally unlikely in it.
    """
    return Model(docs, text, F.lit(True) if where is None else F.coalesce(where, F.lit(False)))


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[at], np.add.reduceat(np.concatenate(n)[order], at)


_ANSWERS = "chunk long, bucket int, target binary, background binary, total_t long, total_b long, words long"


def _answers(table: pa.Table) -> pa.Table:
    """For a bucket: the counts of each chunk's keys under both models, and a row (chunk null) of the bucket's own sums."""
    bucket = table.column("bucket")[0].as_py()
    read = [(r["chunk"], np.cumsum(_unpack(r["keys"])).view(U), r) for r in table.to_pylist()]
    models = [_summed([k for _, k, _ in read], [_unpack(r[name]) for _, _, r in read]) for name in ("target", "background")]
    words = [n[(k & U(1)) == 0] for k, n in models]
    rows = [(None, bucket, None, None, *(int(n.sum()) for n in words), int(((words[0] > 0) | (words[1] > 0)).sum()))]
    for chunk, keys, _ in read:
        if chunk is not None:
            rows.append((chunk, bucket, *(_pack(n[np.searchsorted(k, keys)]) for k, n in models), None, None, None))
    return pa.Table.from_batches([_rows(rows, _ANSWERS)])


def loss(word: np.ndarray, pair: np.ndarray, before: np.ndarray, total: np.ndarray, cells: int, inner: np.ndarray, s: Shape) -> np.ndarray:
    """-ln p of each word given the one before it, from the counts of the word, the pair and the word before, and all words' total."""
    p = (word + s.add) / (total + s.add * cells)
    known = inner & (before > 0)
    follows = np.where(known, pair / np.maximum(before, 1), 0.0)
    weight = np.where(known, s.trust, 0.0)
    return -np.log((1 - weight) * p + weight * follows)


def _own(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each place's key is in its document."""
    if not len(key):
        return np.zeros(0, np.int64)
    _, at, n = np.unique(doc * (int(key.max()) + 1) + key, return_inverse=True, return_counts=True)
    return n[at]


def score(docs: DataFrame, target: Model, background: Model, s: Shape = Shape(), text: str = "text") -> DataFrame:
    """`docs` with n_words, target_loss, background_loss (means, in nats) and difference.

    A row that a model counts (its frame is `docs` itself) is scored by the
    model without it: its own counts are taken off, those of other rows with
    the same text stay. Null, empty and wordless texts have no losses and no
    difference (null). Columns of the four names are replaced, all others and
    repeated rows kept.
    """
    new = ("n_words", "target_loss", "background_loss", "difference")
    kept = [c for c in docs.columns if c not in new]
    spark = docs.sparkSession
    store = Store(spark, "lm")
    frames: list[list] = [[docs, text, list(dict.fromkeys([*kept, text])), F.lit(False), F.lit(False)]]
    for i, m in ((3, target), (4, background)):
        found = next((f for f in frames if f[0] is m.docs and f[1] == m.text), None)
        if found is None:
            frames.append(found := [m.docs, m.text, [m.text], F.lit(False), F.lit(False)])
        found[i] = m.where
    path = store.path("chunks")
    with _tidy(spark):
        for i, (d, c, columns, t, b) in enumerate(frames):
            flagged = d.select(*(F.col(f"`{x}`") for x in columns), t.alias(_T), b.alias(_B))
            _chunks(flagged, c, not i).write.mode("append").partitionBy("scored").parquet(path)
        chunks = spark.read.schema(_CHUNKS).parquet(path)
        keys = chunks.where("scored = 0")
        bits = max(0, int(np.ceil(np.log2(max((keys.agg(F.sum("size")).first()[0] or 0) / BUCKET_KEYS, 1)))))
        answers = store.table(_dealt(keys, bits).groupBy("bucket").applyInArrow(_answers, _ANSWERS), "answers")
    sums = answers.where("chunk is null").agg(F.sum("total_t"), F.sum("total_b"), F.sum("words")).first()
    totals, cells = [x or 0 for x in sums[:2]], max(s.least_words, sums[2] or 0)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        part = pa.ipc.open_stream(rows[0]["docs"]).read_all().combine_chunks().to_batches()[0]
        word, pair, inner, bounds = _keys(part, text)
        at = np.unique(np.concatenate([word, pair[inner]]), return_inverse=True)[1]
        word = at[: len(word)]
        pair = np.zeros(len(word), np.int64)
        pair[inner] = at[len(word) :]
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        own_word, own_pair = _own(doc, word), np.zeros(len(word), np.int64)
        own_pair[inner] = _own(doc[inner], pair[inner])
        mean = []
        for name, flag, total in zip(("target", "background"), (_T, _B), totals, strict=True):
            count = np.concatenate([np.zeros(0, np.int64), *(_unpack(r[name]) for r in rows[1:])])
            counted = np.asarray(part.column(flag))[doc]
            of_word = count[word] - counted * own_word
            of_pair = np.where(inner, count[pair] - counted * own_pair, 0)
            before = np.zeros(len(word), np.int64)
            before[1:] = of_word[:-1]
            each = loss(of_word, of_pair, before, total - counted * n[doc], cells, inner, s)
            sums = np.concatenate([[0.0], np.cumsum(each)])
            mean.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1))
        out = [pa.array(x, pa.float64(), mask=n == 0) for x in (*mean, mean[0] - mean[1])]
        return pa.table([*(part.column(c) for c in kept), pa.array(n.astype(np.int64)), *out], names=[*kept, *new])

    fields = [T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in new[1:])]
    blank = F.lit(None).cast("binary")
    rows = chunks.where("scored = 1").select("chunk", F.lit(-1).alias("bucket"), "docs", blank.alias("target"), blank.alias("background"))
    rows = rows.union(answers.where("chunk is not null").select("chunk", "bucket", blank.alias("docs"), "target", "background"))
    kinds = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.fields
    return rows.groupBy("chunk").applyInArrow(run, T.StructType([*kinds, *fields]))
