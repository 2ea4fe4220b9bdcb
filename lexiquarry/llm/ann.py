"""Nearest neighbours by shifted space-filling curves.

Every curve orders all vectors by the Hilbert key of a random projection,
shifted along the diagonal; each projected coordinate counts by its rank in a
bounded sample, so that neither place nor scale of the data matters. Rows are
range-partitioned and sorted by (curve, key); a query's window on each curve
gives candidates, also across the edges of partitions, which merge and are
ranked by their exact distances. The best of the windows bound each query's
radius; an exact check in blocks of queries then completes the lists with
whatever lies inside the radius. Vectors without low-dimensional structure
need that check: no ordering on a line keeps their neighbours close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._fit import drawn
from ._store import Store


@dataclass(frozen=True)
class Curves:
    curves: int = 6
    axes: int = 6  # of a projection
    bits: int = 8  # of a coordinate
    window: int = 60  # rows on each side of a query
    sample: int = 4000  # vectors that centre and ranks come from, about
    seed: int = 17


#: Queries that one pass over the vectors checks; 10 MB at 64 components.
QUERY_BLOCK = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of integer points (n, axes), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            on = (x[i] & q) > 0
            x[0] = np.where(on, x[0] ^ p, x[0])
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[axes - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def usable(vectors: DataFrame, id: str, vector: str) -> tuple[DataFrame, list[int]]:
    """((id, v) of the vectors that take part, their lengths).

    Null vectors, those with a null, NaN or infinite component, zero and empty
    vectors, and null ids take no part. Components stay float if they are.
    """
    kind = vectors.schema[vector].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>" if plain else "array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & fine)
    return rows, sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())


@dataclass
class Frame:
    """Where the data lies: its centre, and the projections with the ranks of their coordinates."""

    centre: np.ndarray
    maps: list[np.ndarray]
    knots: list[np.ndarray]  # for each map, sorted values of each coordinate, (axes, values)

    @classmethod
    def fit(cls, rows: DataFrame, dim: int, c: Curves) -> Frame:
        """From about `c.sample` vectors drawn by a hash of their id."""
        some = rows.where(drawn("id", rows.count(), c.sample, 51)).select("v").toPandas()["v"].to_list()
        x = np.stack(some).astype(float) if some else np.zeros((1, dim))
        rng = np.random.default_rng(c.seed)
        axes = min(c.axes, dim)
        maps = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :axes] for _ in range(c.curves)]
        centre = np.median(x, 0)
        return cls(centre, maps, [np.sort((x - centre) @ m, 0).T for m in maps])

    def cells(self, x: np.ndarray, k: int, c: Curves) -> np.ndarray:
        """Integer points of the vectors (less the centre) on curve k."""
        y = x @ self.maps[k]
        unit = np.column_stack([np.searchsorted(v, y[:, j]) / (len(v) + 1) for j, v in enumerate(self.knots[k])])
        return np.floor((unit + k / c.curves) / 2 * ((1 << c.bits) - 1)).astype(np.int64)


def _keys(rows: DataFrame, dim: int, frame: Frame, c: Curves) -> DataFrame:
    """(curve, key, id, v): a row for each curve."""
    shared = rows.sparkSession.sparkContext.broadcast(frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("v"), dim) - f.centre
                for k in range(c.curves):
                    key = hilbert_keys(f.cells(x, k, c), c.bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, k, np.int32)), pa.array(key), part.column("id"), part.column("v")], names=["curve", "key", "id", "v"])

    return rows.mapInArrow(run, T.StructType([T.StructField("curve", T.IntegerType()), T.StructField("key", T.LongType()), *rows.schema.fields]))


#: What a sorted partition gives out: the best pairs of its windows, and the rows at its edges (edge, side, place and v set).
_FOUND = "query_id long, vec_id long, score double, curve int, edge int, side int, place int, v array<double>"


def _pairs_in(curve: np.ndarray, ids: np.ndarray, x: np.ndarray, asked: np.ndarray, every: int, k: int, w: int) -> list[np.ndarray]:
    """[query ids, vector ids, distances] of the k nearest in the windows of the rows `asked`."""
    q, v, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in asked[ids[asked] % every == 0].tolist():
        j = np.arange(max(0, i - w), min(len(ids), i + w + 1))
        j = j[(curve[j] == curve[i]) & (ids[j] != ids[i])]
        s = np.sqrt(((x[j] - x[i]) ** 2).sum(1))
        best = np.lexsort((ids[j], s))[:k]
        q.append(np.full(len(best), ids[i]))
        v.append(ids[j[best]])
        d.append(s[best])
    return [np.concatenate(a) for a in (q, v, d)]


def _windows(keyed: DataFrame, dim: int, every: int, k: int, c: Curves, store: Store) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query's window.

    Of a partition it holds a stretch of rows at a time that overlaps the next
    by the window. Equal keys are told apart by a hash of the id, so copies of
    one vector spread over partitions. The last rows of a partition and the
    first of the next, two windows of each, meet in a group of their own.
    """
    w = c.window

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        n = len(found[0])
        blank = [pa.nulls(n, t) for t in (*[pa.int32()] * 4, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*map(pa.array, found), *blank], names=_NAMES)

    def edge(curve: np.ndarray, ids: np.ndarray, x: np.ndarray, number: int, side: int) -> pa.RecordBatch:
        n = len(ids)
        v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
        numbers = [pa.array(a.astype(np.int32)) for a in (curve, np.full(n, number), np.full(n, side), np.arange(n))]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(ids), pa.nulls(n, pa.float64()), *numbers, v], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        curve, ids, x = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, dim))
        done, head, first = 0, 2 * w, True
        for batch in batches:
            curve = np.concatenate([curve, np.asarray(batch.column("curve"))])
            ids = np.concatenate([ids, np.asarray(batch.column("id"))])
            x = np.concatenate([x, _matrix(batch.column("v"), dim)])
            if first and len(ids) >= head:
                yield edge(curve[:head], ids[:head], x[:head], number - 1, 1)
                first = False
            ready = max(done, len(ids) - w)
            yield pairs(_pairs_in(curve, ids, x, np.arange(done, ready), every, k, w))
            cut = max(0, ready - w) if not first else 0
            curve, ids, x, done = curve[cut:], ids[cut:], x[cut:], ready - cut
        yield pairs(_pairs_in(curve, ids, x, np.arange(done, len(ids)), every, k, w))
        if first:
            yield edge(curve[:head], ids[:head], x[:head], number - 1, 1)
        yield edge(curve[-2 * w :], ids[-2 * w :], x[-2 * w :], number, 0)

    def meet(table: pa.Table) -> pa.Table:
        side, place = np.asarray(table.column("side")), np.asarray(table.column("place"))
        table = table.take(pa.array(np.lexsort((place, side)))).combine_chunks()
        batch = table.to_batches()[0]
        left = int((side == 0).sum())
        near = np.arange(max(0, left - w), min(len(side), left + w))
        found = _pairs_in(np.asarray(batch.column("curve")), np.asarray(batch.column("vec_id")), _matrix(batch.column("v"), dim), near, every, k, w)
        return pa.Table.from_arrays([pa.array(a) for a in found], names=["query_id", "vec_id", "score"])

    order = ["curve", "key", F.xxhash64("id")]
    found = store.table(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _FOUND), "curves")
    across = found.where("edge is not null").groupBy("edge").applyInArrow(meet, "query_id long, vec_id long, score double")
    return found.where("edge is null").select("query_id", "vec_id", "score").union(across)


_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct vectors of each query."""
    once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _inside(rows: DataFrame, dim: int, shared, k: int) -> DataFrame:
    """(query_id, vec_id, score) of vectors within the radius of these queries, at most k of a query from a stretch of rows.

    Products of centred vectors sift the pairs, with room for their rounding;
    distances come from differences of the original components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, qx, r, centre = shared.value
        room = 8 * (dim + 8) * np.finfo(float).eps
        qc = qx - centre
        qn, limit = (qc**2).sum(1), (r * (1 + 1e-9)) ** 2
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v, x = np.asarray(part.column("id")), _matrix(part.column("v"), dim)
                xc = x - centre
                xn = (xc**2).sum(1)
                q_out, v_out, d_out = [], [], []
                for a in range(0, len(qi), 2048):
                    norms = xn[None, :] + qn[a : a + 2048, None]
                    fits = norms - 2 * qc[a : a + 2048] @ xc.T <= limit[a : a + 2048, None] + room * norms
                    for i in np.flatnonzero(fits.any(1)).tolist():
                        own = np.flatnonzero(fits[i])
                        own = own[v[own] != qi[a + i]]
                        s = np.sqrt(((x[own] - qx[a + i]) ** 2).sum(1))
                        best = np.lexsort((v[own], s))[:k]
                        q_out.append(np.full(len(best), qi[a + i]))
                        v_out.append(v[own[best]])
                        d_out.append(s[best])
                if q_out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (q_out, v_out, d_out)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _of_length(rows: DataFrame, dim: int, k: int, every: int, c: Curves, exact: bool, store: Store) -> DataFrame:
    """(query_id, vec_id, score, rank) among vectors of one length."""
    frame = Frame.fit(rows, dim, c)
    found = store.table(_top(_windows(_keys(rows, dim, frame, c), dim, every, k, c, store), k), "windows")
    if not exact:
        return found
    asked = rows.where(F.col("id") % every == 0)
    radius = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("r"))
    asked = asked.join(radius, asked["id"] == radius["query_id"], "left")
    asked = asked.select("id", "v", F.when(F.col("n") >= k, F.col("r")).otherwise(float("inf")).alias("r"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = store.table(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    every_pair = found.select("query_id", "vec_id", "score")
    for b in range(blocks):
        q = asked.where(F.col("block") == b).toPandas()
        if len(q):
            block = (q["id"].to_numpy(np.int64), np.stack(q["v"].to_list()).astype(float), q["r"].to_numpy(float), frame.centre)
            shared = rows.sparkSession.sparkContext.broadcast(block)
            every_pair = every_pair.union(store.table(_inside(rows, dim, shared, k), "inside"))
            shared.destroy()
    return _top(every_pair, k)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, c: Curves = Curves(), exact: bool = True, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each vector whose id is divisible by `every`.

    Score is the Euclidean distance in double precision; ties go to the
    smaller id. Candidates are all rows but those with the query's own id;
    repeated rows count once. With `exact` the lists are the true ones, without
    it those of the windows. Vectors that `usable` leaves out take no part;
    vectors are near only to those of their own length. Fewer candidates than k
    give shorter lists; an empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "ann")
    rows, dims = usable(vectors, id, vector)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in dims:
        found = _of_length(rows.where(F.size("v") == dim), dim, k, every, c, exact, store)
        found = found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        out = found if dim == dims[0] else out.union(found)
    return out
