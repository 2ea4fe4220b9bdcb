"""Centroid clustering in exact integers, with Hamerly's two bounds a vector.

Every vector keeps an upper bound of the distance to its centroid and a lower
bound of that to any other, in a table that each round writes anew. A round
loosens both by the centroids' drift; only where they meet, and the exact
distance to the own centroid doesn't part them, all centroids are scanned.
Bounds are rounded outwards, so they never settle a tie. Centroids are exact
floors of sums over counts; a round adds up only the vectors that moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store

#: Components may be this large: squared distances of 64 components fit 63 bits.
MOST = 1 << 27
STATE = "vec_id long, v array<int>, was int, cluster int, upper double, lower double"
#: Vectors scanned at once.
ROWS = 4096


@dataclass(frozen=True)
class Clustering:
    clusters: int = 40
    rounds: int = 5
    seed: int = 2
    width: int = 64
    scale: int = 256


def whole_vectors(vectors: DataFrame, c: Clustering) -> DataFrame:
    """(vec_id, v): vectors of `width` finite components as floors of `scale` times each. Components beyond 2^27 are an error."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == c.width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    big = F.raise_error(F.lit(f"a component times {c.scale} is beyond {MOST}"))
    one = lambda e: F.when(F.abs(e * c.scale) < MOST, F.floor(e * c.scale)).otherwise(big).cast("int")
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, one).alias("v"))


def _squares(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = v - centre
    return np.einsum("...j,...j->...", d, d)


def _up(square: np.ndarray) -> np.ndarray:
    """Square roots, rounded up."""
    return np.nextafter(np.sqrt(np.nextafter(square.astype(float), np.inf)), np.inf)


def _down(square: np.ndarray) -> np.ndarray:
    """Square roots, rounded down."""
    return np.maximum(np.nextafter(np.sqrt(np.nextafter(square.astype(float), -np.inf).clip(0)), -np.inf), 0)


def _scan(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, its distance, distance of the second nearest) over all centroids, squared and exact; ties to the smaller number."""
    d = np.stack([_squares(v, c) for c in centres], axis=1)
    near = d.argmin(1)
    own = d[np.arange(len(v)), near]
    if d.shape[1] == 1:
        return near, own, np.full(len(v), np.inf)
    d[np.arange(len(v)), near] = np.iinfo(np.int64).max
    return near, own, d.min(1)


class Step:
    """What a round needs to know of the centroids."""

    def __init__(self, centres: np.ndarray, before: np.ndarray):
        self.centres = centres
        self.drift = _up(_squares(centres, before))
        # For each centroid, the largest drift of the others, and half the way to the nearest other.
        order = np.argsort(-self.drift, kind="stable")
        self.others = np.where(np.arange(len(centres)) == order[0], self.drift[order[1]] if len(order) > 1 else 0.0, self.drift[order[0]])
        self.half = np.full(len(centres), np.inf)
        for i, c in enumerate(centres):
            if len(centres) > 1:
                self.half[i] = _down(np.delete(_squares(centres, c), i).min()[None])[0] / 2

    def moved(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower, vectors scanned) for vectors of the round before; -1 is no cluster yet."""
        new = cluster < 0
        cluster = cluster.copy()
        upper = np.nextafter(upper + self.drift[cluster], np.inf)
        lower = np.nextafter(lower - self.others[cluster], -np.inf)
        lower = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(new | (upper >= lower))
        known = open_[~new[open_]]
        upper[known] = _up(_squares(v[known], self.centres[cluster[known]]))
        open_ = open_[new[open_] | (upper[open_] >= lower[open_])]
        for at in range(0, len(open_), ROWS):
            part = open_[at : at + ROWS]
            near, own, second = _scan(v[part], self.centres)
            cluster[part], upper[part], lower[part] = near, _up(own), _down(second)
        return cluster, upper, lower, len(open_)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def _round(state: DataFrame, step: Step, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            was = np.asarray(batch.column("cluster"), dtype=np.int64)
            cluster, upper, lower, _ = step.moved(v, was, np.asarray(batch.column("upper")), np.asarray(batch.column("lower")))
            own = [pa.array(was.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *own], names=["vec_id", "v", "was", "cluster", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame, clusters: int, width: int) -> list:
    """(cluster, place, sum) of the vectors that moved, taken from where they were; place -1 is their number. Bounded by clusters * width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((clusters, width + 1), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            one = np.concatenate([np.ones((len(v), 1), np.int64), v], axis=1)
            was = np.asarray(batch.column("was"), dtype=np.int64)
            np.add.at(out, np.asarray(batch.column("cluster"), dtype=np.int64), one)
            np.subtract.at(out, was[was >= 0], one[was >= 0])
        c, j = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((j - 1).astype(np.int32)), pa.array(out[c, j])], names=["cluster", "place", "sum"])

    moved = state.where("was <> cluster").select("v", "was", "cluster")
    return moved.mapInArrow(run, "cluster int, place int, sum long").groupBy("cluster", "place").agg(F.sum("sum").alias("sum")).collect()


def _starts(vectors: DataFrame, c: Clustering) -> np.ndarray:
    """The vectors of the smallest digests of their ids; null ids come last, repeated ones by their components."""
    digest = F.sha2(F.concat(F.lit(f"{c.seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(c.clusters).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), c.width)


def assign(vectors: DataFrame, c: Clustering = Clustering()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for vectors (vec_id, embedding).

    Vectors that are null, of another length or hold null or non-finite
    components take no part; repeated rows count again, null ids are kept.
    Fewer vectors than clusters give fewer centroids, none give no rows; an
    empty cluster keeps its centroid. Equal distances go to the smaller number.
    Further columns are not read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "centroids")
    rows = whole_vectors(vectors, c)
    state = store.table(rows.select("vec_id", "v", F.lit(-1).alias("was"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")), "state")
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centres = _starts(state, c)
    if not len(centres):
        return spark.createDataFrame([], out)
    before = centres
    sums = [[0] * (c.width + 1) for _ in centres]
    for k in range(c.rounds + 1):
        after = store.table(_round(state, Step(centres, before), c.width), "state")
        store.drop(state)
        state = after
        if k == c.rounds:
            break
        for r in _changes(state, len(centres), c.width):
            sums[r["cluster"]][r["place"] + 1] += r["sum"]
        before = centres
        centres = np.array([[x // s[0] for x in s[1:]] if s[0] else list(m) for s, m in zip(sums, before, strict=True)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = centres[np.asarray(batch.column("cluster"), dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(_squares(_matrix(batch.column("v"), c.width), own))], names=["vec_id", "cluster", "distance"])

    found = store.table(state.select("vec_id", "cluster", "v").mapInArrow(run, "vec_id long, cluster int, distance long"), "found")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centres.tolist()]
    facts = [(k, s, sum(inertia.values()), digest[k]) for k, s in inertia.items()]
    summary = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a cluster
    return found.join(F.broadcast(summary), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
