"""Phrase collocation mining: exact n-gram counts by language, scored by their weakest cut.

Texts are cut to n-grams level by level, added up per block of text, dealt to
buckets of the key space as packed arrays and added up there. A word stands as a 64-bit key made of its language and
its bytes; the dictionary of all words proves that no two share a key, else the
keys are made anew from another seed, so counts by key are counts by word. An
n-gram can only be frequent if both of its parts of n - 1 words are: a Bloom
filter of those (bounded size, false hits only) sifts the rows of each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _kernel as K
from ._store import Store
from .decontam import _bloom, _places

U = np.uint64
#: Bytes that end a piece of text, and bytes that part words.
BREAK = K.byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
GAP = BREAK | K.byte_class((0x20, 0x20), (0x09, 0x09))
#: Bytes of text from which words are counted together, and n-grams that are counted together.
TEXT_BLOCK, GRAM_BLOCK = 4 << 20, 1 << 20
#: Bytes of text for each bucket of keys, and the fewest buckets: a bucket is added up in one piece.
BUCKET, FEWEST = 8 << 20, 24
#: Seeds tried until all words have keys of their own.
SEEDS = 8
_STEP = U(0x9FB21C651E98DF25)


def gram_key(keys: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for runs of words."""
    if len(keys) == 1:
        return keys[0]
    acc = keys[0].copy()
    for k in keys[1:]:
        acc = acc * _STEP + k
    return K.mix(acc)


class _Pieces:
    """The words of a block (columns lang, text), with their keys and the number of their piece."""

    def __init__(self, block: pa.RecordBatch, seed: int, bits: int):
        data, offsets = K.buffers(block.column("text"))
        fold = np.random.default_rng(seed).permutation(256).astype(np.uint8)[K._LOWER]
        self.words = K.Words(data, offsets, ~GAP, fold)
        self.langs = block.column("lang").dictionary_encode()
        salt = [int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "little") for x in self.langs.dictionary.to_pylist()]
        self.lang = np.asarray(self.langs.indices, dtype=np.int64)[self.words.doc_of_word()]
        self.keys = K.mix(self.words.hashes() ^ np.array(salt, U)[self.lang]) & U((1 << bits) - 1)
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAK[data], out=ends[1:])
        doc = self.words.doc_of_word()
        #: Whether each word goes on with the one before it.
        self.goes_on = np.zeros(len(doc), bool)
        at = ends[self.words.starts]
        self.goes_on[1:] = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])

    def grams(self, n: int) -> list[np.ndarray]:
        """The n keys of every run of n words inside a piece."""
        whole = np.ones(max(len(self.keys) - n + 1, 0), bool)
        for j in range(1, n):
            whole &= self.goes_on[j : j + len(whole)]
        at = np.flatnonzero(whole)
        return [self.keys[at + j] for j in range(n)]

    def counted(self) -> pa.RecordBatch:
        """(key, lang, word, n) of the block. A word whose bytes aren't those of the first word of its key has a row of its own."""
        low = K._LOWER[self.words.data]
        order = np.argsort(self.keys, kind="stable")
        start, size = self.words.starts[order], (self.words.ends - self.words.starts)[order]
        key, lang = self.keys[order], self.lang[order]
        head = np.ones(len(order), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        same = (size == size[first]) & (lang == lang[first])
        long = np.where(same, size, 0)
        before = np.concatenate([[0], np.cumsum(long)])
        step = np.arange(before[-1])
        differ = low[step + np.repeat(start - before[:-1], long)] != low[step + np.repeat(start[first] - before[:-1], long)]
        same[np.unique(np.searchsorted(before, np.flatnonzero(differ), "right") - 1)] = False
        own = head | ~same
        # Rows that aren't the same as their key's first count alone.
        n = np.bincount(first[same & ~head], minlength=len(order))[own] + 1
        begin, length = start[own], size[own]
        bounds = np.concatenate([[0], np.cumsum(length)])
        text = low[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], length)]
        word = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text.tobytes()))
        names = self.langs.dictionary.take(pa.array(lang[own]))
        return pa.RecordBatch.from_arrays([pa.array(key[own].view(np.int64)), names, word.cast(pa.string()), pa.array(n)], names=["key", "lang", "word", "n"])


def _added(keys: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal runs of words added up, sorted by their key: their words' keys and their counts (of `n`, or of rows)."""
    whole = gram_key(keys)
    order = np.argsort(whole)
    whole = whole[order]
    ties = np.flatnonzero(whole[1:] == whole[:-1])
    keys = [k[order] for k in keys]
    if any((k[ties] != k[ties + 1]).any() for k in keys):
        # Other runs share a key: equal ones must stand together.
        again = np.lexsort((*keys[::-1], whole))
        order, keys = order[again], [k[again] for k in keys]
    head = np.ones(len(order), bool)
    head[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(head)
    return [k[at] for k in keys], np.diff(np.append(at, len(order))).astype(U) if n is None else np.add.reduceat(n[order], at) if len(at) else np.zeros(0, U)


def _names(n: int) -> list[str]:
    return [f"k{i + 1}" for i in range(n)]


_DEALT = "bucket int, data binary"


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Where sorted 64-bit keys are parted to buckets of equal shares of the key space."""
    step = (1 << 64) // buckets + 1
    return [0, *np.searchsorted(keys, np.array([step * i for i in range(1, buckets)], U)).tolist(), len(keys)]


def _dealt(cuts: list[int], data) -> pa.RecordBatch:
    """A row for each bucket that has any; `data(a, b)` gives its bytes."""
    some = [(i, data(a, b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["bucket", "data"])


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _words(rows: DataFrame, seed: int, bits: int, buckets: int) -> DataFrame:
    """(key, lang, word, n), added up in a bucket of keys at a time: Spark shuffles packed blocks, not a row for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for block in K.blocks(batch, "text", TEXT_BLOCK):
                found = _Pieces(block, seed, bits).counted()
                cuts = _cuts(np.asarray(found.column("key")).view(U) << U(64 - bits), buckets)
                yield _dealt(cuts, lambda a, b, found=found: _stream(found.slice(a, b - a)))

    def added(table: pa.Table) -> pa.Table:
        every = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("data")])
        return every.group_by(["key", "lang", "word"], use_threads=False).aggregate([("n", "sum")]).select(["key", "lang", "word", "n_sum"]).rename_columns(["key", "lang", "word", "n"])

    return rows.mapInArrow(run, _DEALT).groupBy("bucket").applyInArrow(added, "key long, lang string, word string, n long")


def _grams(rows: DataFrame, n: int, least: int, seed: int, bits: int, sieve, buckets: int) -> DataFrame:
    """(k1, ..., kn, n): n-grams that occur `least` times, of those whose two parts of n - 1 words the filter knows; added up as words are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        flags = sieve.value
        held: list[list[np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            keys, count = _added([np.concatenate(x) for x in zip(*held, strict=True)])
            return _dealt(_cuts(gram_key(keys), buckets), lambda a, b: b"".join([*(k[a:b].tobytes() for k in keys), count[a:b].tobytes()]))

        for batch in batches:
            for block in K.blocks(batch, "text"):
                keys = _Pieces(block, seed, bits).grams(n)
                for part in (slice(0, n - 1), slice(1, n)):
                    h = gram_key(keys[part])
                    at = np.arange(len(h))
                    for place in _places(h, 8 * len(flags)):
                        at = at[(flags[(p := place(at)) >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
                    keys = [k[at] for k in keys]
                held.append(keys)
                if sum(len(x[0]) for x in held) >= GRAM_BLOCK:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    def added(table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        parts = [np.frombuffer(x.as_buffer(), U).reshape(n + 1, -1) for x in table.column("data")]
        keys, count = _added([np.concatenate([x[i] for x in parts]) for i in range(n)], np.concatenate([x[n] for x in parts]))
        some = np.flatnonzero(count >= least)
        return pa.table([*(pa.array(k[some].view(np.int64)) for k in keys), pa.array(count[some].view(np.int64))], names=[*names, "n"])

    names = _names(n)
    return rows.mapInArrow(run, _DEALT).groupBy("bucket").applyInArrow(added, ", ".join(f"{c} long" for c in [*names, "n"]))


def _with_key(table: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            key = gram_key([np.asarray(batch.column(c)).view(U) for c in range(n)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return table.select(*_names(n)).mapInArrow(run, "key long")


def counts(docs: DataFrame, store: Store, max_n: int = 3, least: int = 10, bits: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """All words (key, lang, word, n), and for each length up to `max_n` the table (k1, ..., n) of phrases that occur `least` times or more."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(FEWEST, -(-size // BUCKET))
    for seed in range(SEEDS):
        words = store.table(_words(rows, seed, bits, buckets), "words")
        if words.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            break
        store.drop(words)
    else:
        raise ValueError(f"{SEEDS} seeds gave words that share a key of {bits} bits")
    levels = [words.where(F.col("n") >= least).select(F.col("key").alias("k1"), "n")]
    for n in range(2, max_n + 1):
        known = levels[-1]
        sieve = docs.sparkSession.sparkContext.broadcast(_bloom(_with_key(known, n - 1), max(known.count(), 1)))
        levels.append(store.table(_grams(rows, n, least, seed, bits, sieve, buckets), f"grams{n}"))
        sieve.destroy()
    return words, levels


def _scored(levels: list[DataFrame], n: int) -> DataFrame:
    """(k1, ..., a, l, r, score): candidates of n words with their lowest-scoring cut."""
    names = _names(n)
    rows = levels[n - 1].withColumnRenamed("n", "a")
    cuts = []
    wide = "decimal(15,0)"
    for k in range(1, n):
        for side, own in (("l", names[:k]), ("r", names[k:])):
            part = levels[len(own) - 1]
            rows = rows.join(part.select(*(F.col(f"k{i + 1}").alias(c) for i, c in enumerate(own)), F.col("n").alias(f"{side}{k}")), own)
        product = F.col(f"l{k}").cast(wide) * F.col(f"r{k}").cast(wide)
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (F.col("a").cast(wide) * F.col("a").cast(wide)), product)
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return rows.withColumn("best", best).select(*names, "a", "best.l", "best.r", "best.score")


def _outside(candidates: DataFrame, longer: DataFrame, n: int, percent: int) -> DataFrame:
    """Candidates of n words without an extension by one word that occurs `percent` of their times or more.

    A phrase of more words holds an extension by one that occurs as often at least, so these tell all.
    """
    names = _names(n)
    ends = [longer.select(*(F.col(f"k{i + 1 + at}").alias(c) for i, c in enumerate(names)), F.col("n").alias("wider")) for at in (0, 1)]
    most = ends[0].union(ends[1]).groupBy(*names).agg(F.max("wider").alias("wider"))
    covered = [candidates[c] == most[c] for c in names]
    return candidates.join(most, [*covered, most["wider"] * 100 >= candidates["a"] * percent], "left_anti")


def mine(docs: DataFrame, max_n: int = 3, least: int = 10, percent: int = 50, top: int = 2000, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `max_n` words.

    docs: lang (null: "und"), text (null: empty). A-Z are lower-cased; texts are
    cut at marks and line ends to pieces, those at spaces and tabs to words.
    A phrase counts in every place, overlaps included, within pieces. Candidates
    occur `least` times (a); of its cuts the one with the lowest
    floor(10^6 a^2 / (l r)) scores it, ties to the shortest first part. Those
    inside a longer candidate with `percent` of their count go. Order: score,
    a, then phrase in bytes; repeated rows count again, an empty table gives no
    rows, further columns are not read. Arithmetic is exact for counts up to 10^15.
    """
    store = Store(docs.sparkSession, "phrases")
    words, levels = counts(docs, store, max_n, least, bits)
    known = words.where(F.col("n") >= least).select("key", "lang", "word")
    found = None
    for n in range(2, max_n + 1):
        rows = _scored(levels, n)
        if n < max_n:
            rows = _outside(rows, levels[n], n, percent)
        for i, c in enumerate(_names(n)):
            spelt = known.select(F.col("key").alias(c), F.col("word").alias(f"w{i}"), *(["lang"] if i == 0 else []))
            rows = rows.join(spelt, c)
        rows = rows.select("lang", F.concat_ws(" ", *(f"w{i}" for i in range(n))).alias("phrase"), "a", "l", "r", "score")
        found = rows if found is None else found.union(rows)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return best.join(totals, "lang").select("lang", long("rank"), "phrase", "a", "l", "r", "n", long("score"))
