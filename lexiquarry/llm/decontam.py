"""Benchmark decontamination by template windows.

Words become template words: a number, a unit after a number, or a run of
names becomes a typed placeholder, any other word stays, lower-cased. What is
a name depends on the reading (see `Template`). Windows of template words of the documents are
hash-joined with those of the benchmark. A document holds an item if aligned
windows cover enough of it and the slots are consistent: each value of the
item corresponds to one value in the document and the other way round, so a
copy with other numbers or names is found, and a text that only has the same
frame with values at random isn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernel import ALNUM, U, Words, blocks, buffers, mix, windows
from ._store import Store

WINDOW = 8
#: Neighbouring shifts whose windows add up.
BAND = 4
#: Bits of the benchmark's Bloom filter for each window, and probes of a window; 2e-3 of other windows pass at most.
BLOOM_BITS, PROBES = 16, 4
#: Bits of the filter at least and at most (32 MB, for 16 million windows; beyond, more windows pass, and the join settles them).
BLOOM_LEAST, BLOOM_MOST = 1 << 20, 1 << 28
#: Bits of a piece of the filter that tasks make.
PIECE = 1 << 15
#: Units that follow a number.
UNITS = (
    "mm cm m km in inch inches ft feet yd yards mile miles mg g kg t lb lbs oz ml l gal s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years w kw kwh j kj v a hz khz mhz ghz b kb mb gb tb usd eur gbp dollar dollars euro euros cent cents pound pounds percent "
    "degrees celsius fahrenheit k c f kmh mph n pa kpa bar mol cal kcal"
)
NUMBER, UNIT, NAME = U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B), U(0x3C6EF372FE94F82B)
KINDS = np.array([NUMBER, UNIT, NAME])
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LATIN_UPPER = np.zeros(256, bool)  # second byte of U+00C0 .. U+00DE
_LATIN_UPPER[0x80:0x9F] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3A, 0x3F]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x2C, 0x2E]] = True


def _hashes(words: str) -> np.ndarray:
    raw = words.encode()
    return np.unique(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM).hashes())


_UNIT_HASHES = _hashes(UNITS)


def _upper_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an ASCII or Latin-1 capital starts at these bytes."""
    safe = np.minimum(at, len(data) - 1)
    after = np.minimum(at + 1, len(data) - 1)
    return (at < len(data)) & (_UPPER[data[safe]] | ((data[safe] == 0xC3) & _LATIN_UPPER[data[after]]))


#: Words that open sentences and are no names.
OPENERS = (
    "a an the this that these those he she it they we i you his her its their our my your who what when where which why how if in on at for from to of by with as "
    "and but or so then there here is are was were be do does did can could will would should may let given each every all some any no not one two three after before "
    "during while since until once suppose assume consider find calculate compute determine write explain describe show prove solve"
)

_OPENER_HASHES = _hashes(OPENERS)


class Template:
    """The template words of a block of texts, in one of three readings.

    0: a title-case word is a name, at the start of a sentence also unless it
    is a common opener; 1: a name only inside a sentence; 2: no word is a name
    (for texts whose case tells nothing). A run of names, and a number with
    separators, is one template word. A slot's value is the hash of its
    lower-cased words.
    """

    def __init__(self, h: np.ndarray, t: np.ndarray, joined: np.ndarray, title: np.ndarray, bounds: np.ndarray):
        first = np.flatnonzero(~joined)  # the first word of each template word
        run = np.cumsum(~joined) - 1
        depth = np.arange(len(h)) - first[run] if len(h) else run
        value = h.copy()
        if joined.any():
            np.add.at(value := h * 0, run, mix(h + depth.astype(U) * U(0x9E3779B97F4A7C15)))
            value = np.where(np.bincount(run, minlength=len(first)) > 1, value[: len(first)], h[first])
        self.words, self.hashes, self.values = first, t[first], value
        self.slots = np.where(np.isin(self.hashes, KINDS), value, U(0))
        self.titles = np.concatenate([[0], np.cumsum(np.add.reduceat(title.astype(np.int64), first) if len(first) else np.zeros(0, np.int64))])
        self.bounds = np.searchsorted(first, bounds)
        self.origin = bounds[:-1]


def templates(column: pa.Array) -> list[Template]:
    """The three readings of the texts."""
    text = pc.fill_null(column, "")
    data, offsets = buffers(text)
    words = Words(data, offsets, ALNUM)
    h = Words(*buffers(pc.utf8_lower(text)), ALNUM).hashes()
    n = len(h)
    if not n:
        off = np.zeros(0, bool)
        return [Template(h, h, off, off, words.bounds) for _ in range(3)]
    starts = np.zeros(n, bool)  # first word of a text
    starts[words.bounds[:-1][words.bounds[:-1] < words.bounds[1:]]] = True
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = starts.copy()
    opens[1:] |= stops[words.starts[1:]] > stops[words.ends[:-1]]
    number = _DIGIT[data[words.starts]]
    more = np.zeros(n, bool)  # goes on with the number before
    gap = words.starts[1:] - words.ends[:-1]
    more[1:] = number[1:] & number[:-1] & ~starts[1:] & (gap == 1) & _SEPARATOR[data[words.ends[:-1]]]
    opens &= ~more
    unit = np.isin(h, _UNIT_HASHES)
    unit[1:] &= number[:-1] & ~opens[1:]
    unit[0] = False
    second = words.starts + np.where(data[words.starts] < 0x80, 1, 2)
    title = _upper_at(data, words.starts) & (second < words.ends) & ~_upper_at(data, second) & ~unit & ~number
    out = []
    for name in (title & ~(opens & np.isin(h, _OPENER_HASHES)), title & ~opens, np.zeros(n, bool)):
        t = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
        joined = more.copy()
        joined[1:] |= name[1:] & name[:-1] & ~opens[1:]
        out.append(Template(h, t, joined, title & ~opens, words.bounds))
    return out


def item_size(n: np.ndarray, size: int) -> np.ndarray:
    """Words of an item's windows: all of a short item; else so few that one altered word leaves half of the windows."""
    return np.where(n < size, n, np.minimum(size, np.maximum(3, (n + 1) // 3)))


def _key(h: np.ndarray, reading: int, size: int) -> np.ndarray:
    return mix(h + U((reading * 64 + size) * 0xD6E8FEB86659FD93 % (1 << 64)))


def _windows(rows: DataFrame, size: int, sizes: list[int] | None = None, wanted=None) -> DataFrame:
    """(id, reading, key, pos, word, total, plain, cells) of windows: of items all, of documents (with `sizes`) those that may be wanted.

    `pos` counts template words and `word` words; `cells` are an item's slots or a document's values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        bits = wanted.value if wanted is not None else None
        for batch in batches:
            for part in blocks(batch, "text"):
                for reading, t in enumerate(templates(part.column("text"))):
                    n = np.diff(t.bounds)
                    own = item_size(n, size)
                    for w in range(1, size + 1) if sizes is None else sizes:
                        h, b = windows(t.hashes, t.bounds, w, short=False)
                        h = _key(h, reading, w)
                        if bits is None:
                            at = np.flatnonzero(np.repeat(own == w, np.diff(b)))
                        else:
                            at = np.arange(len(h))
                            for place in _places(h, 8 * len(bits)):
                                at = at[(bits[(p := place(at)) >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
                        doc = np.searchsorted(b, at, "right") - 1
                        start = t.bounds[doc] + (at - b[doc])
                        if bits is not None and reading == 2:  # where case tells names, the other readings hold
                            keep = t.titles[start + w] == t.titles[start]
                            at, doc, start = at[keep], doc[keep], start[keep]
                        if not len(at):
                            continue
                        cells = (t.slots if bits is None else t.values)[start[:, None] + np.arange(w)[None, :]]
                        plain = np.concatenate([[0], np.cumsum(t.slots == 0)])
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("id").take(pa.array(doc)),
                                pa.array(np.full(len(at), reading, np.int32)),
                                pa.array(h[at].view(np.int64)),
                                pa.array((start - t.bounds[doc]).astype(np.int64)),
                                pa.array((t.words[start] - t.origin[doc]).astype(np.int64)),
                                pa.array(np.diff(b)[doc].astype(np.int64)),
                                pa.array((plain[t.bounds[doc + 1]] - plain[t.bounds[doc]]).astype(np.int64)),
                                pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * w), pa.array(cells.ravel().view(np.int64))),
                            ],
                            names=["id", "reading", "key", "pos", "word", "total", "plain", "cells"],
                        )

    return rows.mapInArrow(run, "id long, reading int, key long, pos long, word long, total long, plain long, cells array<long>")


def _places(h: np.ndarray, size: int) -> list[Callable[[np.ndarray], np.ndarray]]:
    """For each probe, the bits of a Bloom filter of `size` bits (a power of two) that some of the keys ask for."""
    step = lambda at: mix(h[at] ^ U(0x2545F4914F6CDD1D)) | U(1)
    return [lambda at, i=i: ((h[at] + U(i) * step(at)) & U(size - 1)).astype(np.int64) for i in range(PROBES)]


def _bloom(keys: DataFrame, count: int) -> np.ndarray:
    """The Bloom filter of `count` keys. Tasks make its pieces and merge them by place, so the driver gets no more than its size."""
    size = min(max(1 << (BLOOM_BITS * count - 1).bit_length(), BLOOM_LEAST), BLOOM_MOST)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            h = np.asarray(batch.column(0)).view(U)
            bits = np.unique(np.concatenate([place(np.arange(len(h))) for place in _places(h, size)]))
            number, first = np.unique(bits // PIECE, return_index=True)
            found = []
            for own in np.split(bits % PIECE, first[1:]):
                one = np.zeros(PIECE, np.uint8)
                one[own] = 1
                found.append(np.packbits(one, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), pa.array(found, pa.binary())], names=["piece", "bits"])

    def merged(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    schema = "piece long, bits binary"
    out = np.zeros(size // 8, np.uint8)
    for r in keys.select("key").mapInArrow(pieces, schema).groupBy("piece").applyInArrow(merged, schema).collect():
        out[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = 0.5, least: int = 1) -> DataFrame:
    """(doc_id, item_id, coverage, exact, start): the items that documents hold.

    docs: doc_id, text; benchmark: item_id, text. Windows have as many words as
    `item_size` says, `size` at most; an item of fewer words is one window of
    its own length, found anywhere in a document, but with
    fewer than `least` words only in documents of just these words (by default
    an item of one word is found wherever the word stands). An item without words is found nowhere,
    one of slots only with its own values. Several texts of one item_id are
    looked for each on its own, and the best stands for the item. `coverage` is the
    share of the item's windows found in one alignment (at least `share`),
    `start` the first word of that alignment in the document, `exact` whether
    all slots have the item's values. An alignment is a shift, or a band of
    `BAND` neighbouring shifts, so that words may be lost or put in. It is
    dropped if the slots of its found windows contradict each other. Of several
    alignments of an item in a document the best is reported (largest coverage,
    exact first, then the earliest). Rows with a null id or text take no part;
    repeated rows count once. Further columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "decontam")
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    texts = store.table(texts.select(F.xxhash64("item_id", "text").alias("id"), "item_id", "text"), "texts")
    items = store.table(_windows(texts.select("id", "text"), size), "items")
    sizes = sorted(r[0] for r in items.select(F.size("cells")).distinct().collect())
    wanted = spark.sparkContext.broadcast(_bloom(items, items.count()))
    found = _windows(docs.select(F.col("doc_id").cast("long").alias("id"), "text").dropna(), size, sizes, wanted)
    # What is left are places that look like benchmark windows: a small part of the documents' windows.
    found = found.where((F.size("cells") >= least) | (F.col("total") == 1))
    hits = store.table(found.select(F.col("id").alias("doc_id"), "key", F.col("pos").alias("dpos"), F.col("word").alias("dword"), F.col("cells").alias("dcells")), "hits")
    right = items.select(F.col("id").alias("item"), "reading", "key", F.col("pos").alias("ipos"), F.col("word").alias("iword"), "total", "plain", F.col("cells").alias("icells"))
    met = hits.join(right, "key").withColumn("shift", F.col("dpos") - F.col("ipos")).withColumn("first", F.col("dword") - F.col("iword"))
    pairs = F.filter(F.arrays_zip("icells", "dcells"), lambda s: s["icells"] != 0)
    # A single shift (width 1), and each band of shifts that holds it.
    bands = [F.struct(F.lit(1).alias("width"), F.col("shift").alias("at")), *(F.struct(F.lit(BAND).alias("width"), (F.col("shift") - k).alias("at")) for k in range(BAND))]
    groups = met.withColumn("pairs", pairs).withColumn("band", F.explode(F.array(*bands))).groupBy("doc_id", "item", "reading", "band")
    aligned = groups.agg(
        F.count_distinct("ipos").alias("windows"),
        F.first("total").alias("total"),
        F.first("plain").alias("plain"),
        F.min("first").alias("first"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    left = F.transform("pairs", lambda s: s["icells"])
    other = F.transform("pairs", lambda s: s["dcells"])
    consistent = (F.size(F.array_distinct(left)) == F.size("pairs")) & (F.size(F.array_distinct(other)) == F.size("pairs"))
    exact = F.forall("pairs", lambda s: s["icells"] == s["dcells"])
    aligned = aligned.where(consistent & (F.col("windows") >= share * F.col("total")) & ((F.col("plain") > 0) | exact))
    aligned = aligned.join(texts.select(F.col("id").alias("item"), "item_id"), "item")
    best = aligned.select("doc_id", "item_id", F.struct((F.col("windows") / F.col("total")).alias("coverage"), exact.alias("exact"), (-F.col("first")).alias("back")).alias("best"))
    best = best.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", "best.coverage", "best.exact", (-F.col("best.back")).alias("start"))
