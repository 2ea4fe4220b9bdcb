"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two signature values, the least and
the greatest hash, so a signature of `2 * hashes` values costs `hashes`
evaluations; matches of greatest values are as unbiased for the Jaccard
similarity as those of least values, and the pair has a lower variance than
two independent minima. Values are cut into bands; documents that share a
band are candidates, and each candidate pair that could matter is confirmed
on the full shingle sets.

Large groups never become all their pairs:

1. Equal sets (128-bit digests) are one node.
2. In every band bucket only the pairs of the most central member with the
   others are confirmed. Central is who shares the most bucket places: among
   edited copies that is the text they were made from.
3. Buckets that this leaves in one component are done. In the others, pairs
   of different components are compared by their sketches in blocks of
   bounded size; pairs whose estimate is over six standard errors below the
   threshold are left, and the rest are confirmed on the full sets. Pairs stay
   inside the task; it gives out the links that join components.
4. Components come from confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernel import NON_SPACE, U, Words, blocks, buffers, distinct, mix, windows
from ._store import Store, grouped
from .components import components


@dataclass(frozen=True)
class MinMax:
    """Parameters: a pair with `100 * intersection >= percent * union` is a link.

    At a similarity s a pair shares no band with probability
    (1 - s ** rows) ** bands: 7e-7 for the defaults at 0.85, 1e-6 for
    percent=80, bands=45 at 0.8. `rows` is even: half of a band's values
    are minima and half maxima, and each value serves one band.
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 30
    rows: int = 6
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows // 2


#: Members of a bucket that one task compares with one another.
BLOCK = 2000
#: Shingles of the members whose full sets one task compares with one another.
BLOCK_SHINGLES = 1_000_000


def shingle_sets(batch: pa.RecordBatch, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, with their bounds."""
    words = Words(*buffers(batch.column(text)), NON_SPACE)
    return distinct(*windows(words.hashes(), words.bounds, size, short=True))


def signature(sets: np.ndarray, bounds: np.ndarray, p: MinMax) -> np.ndarray:
    """One row of 2 * p.hashes values for each text that has shingles."""
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 1 << 63, p.hashes, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, p.hashes, dtype=np.uint64)
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), 2 * p.hashes), U)
    if len(at):
        for k in range(p.hashes):
            y = sets * a[k]
            y += b[k]
            out[:, k] = np.minimum.reduceat(y, at)
            out[:, p.hashes + k] = np.maximum.reduceat(y, at)
    return out


def band_keys(values: np.ndarray, p: MinMax) -> np.ndarray:
    """A 64-bit key for each band; a band takes both kinds of values, of different permutations."""
    out = np.empty((len(values), p.bands), U)
    low = p.rows // 2
    for band in range(p.bands):
        key = np.full(len(values), np.random.default_rng([p.seed, band]).integers(1, 1 << 62), U)
        for j in range(p.rows):
            k = band * low + j % low
            side = k if j < low else p.hashes + (k + p.hashes // 2) % p.hashes
            key = mix(key * U(0x9FB21C651E98DF25) + values[:, side])
        out[:, band] = key
    return out


def signatures(docs: DataFrame, p: MinMax, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, h1, h2, bands, sketch) of each row: set size, digest, band keys, a byte of each signature value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in blocks(batch, "text"):
                sets, bounds = shingle_sets(part, "text", p.shingle)
                n = np.diff(bounds)
                has = n > 0
                at = bounds[:-1][has]
                digest = np.zeros((2, len(n)), U)
                if len(at):
                    digest[0, has] = np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), at)
                    digest[1, has] = np.add.reduceat(mix(sets + U(0x14057B7EF767814F)), at)
                values = signature(sets, bounds, p)
                keys = band_keys(values, p).view(np.int64)
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(has * p.bands, out=ends[1:])
                width = np.zeros(len(n) + 1, np.int32)
                np.cumsum(has * values.shape[1], out=width[1:])
                sketch = (values >> U(37)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(n.astype(np.int64)),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(width), pa.py_buffer(sketch.tobytes())]),
                    ],
                    names=["id", "n", "h1", "h2", "bands", "sketch"],
                )

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, h1 long, h2 long, bands array<long>, sketch binary")


def _confirm(pairs: DataFrame, texts: DataFrame, p: MinMax) -> DataFrame:
    """(a, b, inter, total) of the pairs (a, b), from the whole texts.

    The text of b comes first; that of a, which may be in very many pairs,
    comes in copies, one for each thousand pairs, so that no key is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for part in blocks(batch, "text_b"):
                left, lb = shingle_sets(part, "text_a", p.shingle)
                right, rb = shingle_sets(part, "text_b", p.shingle)
                rows = range(part.num_rows)
                inter = np.array([len(np.intersect1d(left[lb[i] : lb[i + 1]], right[rb[i] : rb[i + 1]], assume_unique=True)) for i in rows], np.int64)
                total = np.diff(lb) + np.diff(rb) - inter
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(inter), pa.array(total.astype(np.int64))], names=["a", "b", "inter", "total"])

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 1000).cast("int").alias("copies"))
    dealt = pairs.join(many, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(many, "a")
    left = left.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = dealt.drop("copies").join(right, "b").join(left, ["a", "copy"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, inter long, total long")


def _block_pairs(t: pa.Table, p: MinMax, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the rows that row i of a bucket's two blocks must be compared with.

    They are in another component, of a fit size and with sketches that leave a
    link possible. A pair that shares several buckets counts in the first of
    them only, and pairs with the bucket's leader are confirmed already.
    """
    ids, n, comp, block = (np.asarray(t.column(c)) for c in ("id", "n", "component", "block"))
    key, leader, lo, hi = (t.column(c)[0].as_py() for c in ("key", "leader", "lo", "hi"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), 2 * p.hashes)
    bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(len(ids), p.bands)
    band = int(np.flatnonzero(bands[0] == key)[0])
    others = np.flatnonzero((block == hi) & (ids != leader))
    for i in np.flatnonzero((block == lo) & (ids != leader)).tolist():
        j = others[others > i] if lo == hi else others
        j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= p.percent * np.maximum(n[j], n[i]))]
        if len(j):
            j = j[(sketch[j] == sketch[i]).sum(1) >= least]
            j = j[~(bands[j, :band] == bands[i, :band]).any(1)]
            if len(j):
                yield i, j


def _dealt(members: DataFrame, parts: Column) -> DataFrame:
    """Buckets in `parts` blocks, one group (key, lo, hi) for each pair of blocks, sorted by group."""
    out = members.withColumn("parts", parts.cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = out.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("parts", "other")
    return out.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")


def _across(members: DataFrame, texts: DataFrame, p: MinMax, store: Store) -> DataFrame:
    """Links (a, b) between different components of one bucket, enough of them to join what belongs together.

    members: key, size, id, n, component, leader, sketch, bands. First the
    members that have a possible link at all are found by their sketches; then
    these bring their texts, and the pairs are confirmed on the full sets.
    Neither step gives out pairs: a group names its members, then no more links
    than it has members.
    """
    s = p.percent / 100
    # A byte also matches by chance; six standard errors under the expected matches at the threshold.
    expected = s + (1 - s) / 256
    least = int(2 * p.hashes * (expected - 6 * (expected * (1 - expected) / (2 * p.hashes)) ** 0.5))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["key", "lo", "hi"]):
            touched = np.zeros(t.num_rows, bool)
            for i, j in _block_pairs(t, p, least):
                touched[i] = True
                touched[j] = True
            if touched.any():
                yield from t.select(["key", "id"]).filter(pa.array(touched)).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for t in grouped(batches, ["key", "lo", "hi"]):
            ids = np.asarray(t.column("id"))
            sets, bounds = shingle_sets(t.select(["text"]).combine_chunks().to_batches()[0], "text", p.shingle)
            size = np.diff(bounds)
            root = {int(c): int(c) for c in np.asarray(t.column("component"))}
            comp = np.asarray(t.column("component"))

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            found = []
            for i, j in _block_pairs(t, p, least):
                own = top(int(comp[i]))
                j = j[np.array([top(int(c)) != own for c in comp[j]])]
                if not len(j):
                    continue
                mine = sets[bounds[i] : bounds[i + 1]]
                theirs = np.concatenate([sets[bounds[k] : bounds[k + 1]] for k in j.tolist()])
                at = np.searchsorted(mine, theirs)
                at[at == len(mine)] = 0
                inter = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(size[j])[:-1]]))
                for k in j[100 * inter >= p.percent * (size[i] + size[j] - inter)].tolist():
                    x, y = top(int(comp[i])), top(int(comp[k]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((int(ids[i]), int(ids[k])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], names=["a", "b"])

    flagged = _dealt(members, F.ceil(F.col("size") / BLOCK)).mapInArrow(possible, "key long, id long").distinct()
    rows = store.table(members.join(flagged, ["key", "id"], "left_semi"), "possible")
    shingles = rows.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    rows = rows.join(shingles, "key").join(texts, "id")
    return _dealt(rows, F.col("parts")).mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, p: MinMax = MinMax(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    A text of fewer words than a shingle is one shingle; a null, empty or
    blank text has none, is its own component and is kept. Rows with equal
    doc_id count as one document with several texts and repeat in the result
    as in the input; a row whose doc_id is null takes no part: component null,
    kept true. Other columns of `docs` are not read. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    store = Store(spark, "minhash")
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sig = store.table(signatures(docs, p, id, text), "signatures")
    full = sig.where("n > 0 and id is not null")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    nodes = store.table(classes, "classes")
    reps = full.join(nodes.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi")
    places = reps.select("id", F.explode("bands").alias("key"))
    shared = places.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = store.table(places.join(shared, "key").distinct(), "members")

    mass = members.groupBy("id").agg(F.sum("size").alias("mass"))
    weighed = members.join(mass, "id")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("mass", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("leader"))
    led = store.table(members.join(leaders, "key"), "led")
    size_of = reps.select("id", "n")
    near = led.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    near = near.join(size_of.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(size_of.withColumnsRenamed({"id": "b", "n": "nb"}), "b")
    near = near.where(100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb")).select("a", "b").distinct()
    is_link = F.expr(f"100 * inter >= {p.percent} * total")
    first = store.table(_confirm(near, texts, p).where(is_link).select("a", "b"), "links")

    found = store.table(components(first, store), "components")
    placed = led.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.where("size > 2").groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    still = placed.join(open_keys, "key", "left_semi").join(reps.select("id", "n", "sketch", "bands"), "id")
    more = store.table(_across(still, texts, p, store), "more-links")
    # The first components stand for their links: stars hold the same reachability.
    every = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), store)

    of_class = nodes.join(every.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    rows = sig.select("id", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
