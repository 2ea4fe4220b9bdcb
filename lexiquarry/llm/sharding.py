"""Sharding by vector bin packing: bytes, tokens and rows of equal texts are placed jointly.

Groups of equal texts are vectors in units of a shard's capacity (a shard's
share of all bytes, tokens and rows). From the largest on, each goes where the
dot product with the residual capacity is highest. The few large ones, whose
number is bounded by the shards, are placed one after another by the driver.
The others are dealt to cells of a bounded size; each cell packs its own by the
same rule towards its share of what is left of every shard, so cells need not
know of each other and their errors are as small as their last groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import Store, grouped

DIMS = ["bytes", "tokens", "rows"]


@dataclass(frozen=True)
class Packing:
    shards: int = 40
    #: Of bytes, tokens and rows in the dot product; bytes are the law.
    weights: tuple[float, float, float] = (4.0, 1.0, 1.0)
    #: A group over a shard's capacity is cut to pieces of this share of it.
    piece: float = 1 / 8
    #: Groups of this share of a shard's capacity are large: 3 * shards / large at most.
    large: float = 1 / 256
    #: Groups of a cell, and rows of a block of slots, on average.
    cell: int = 8192


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, tokens, digest, uid): narrow rows. A null text is an empty one of the size 16."""
    told = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id),
        (F.octet_length(told) + 16).cast("long").alias("size"),
        F.crc32(told.cast("binary")).alias("text_crc32"),
        F.regexp_count(told, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.unhex(F.sha2(told, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("uid"),
    )


def place(vectors: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shard of each vector, taken in their order; equal products go to the smaller shard."""
    left = residual.copy()
    out = np.empty(len(vectors), np.int32)
    for i, v in enumerate(vectors):
        out[i] = s = (left @ (v * weights)).argmax()
        left[s] -= v
    return out


def _largest_first(table: pa.Table, unit: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The items and their vectors by their largest component; ties by digest and piece."""
    v = np.stack([table.column(c).to_numpy().astype(float) for c in DIMS], axis=1) / unit
    order = sorted(range(len(v)), key=lambda i, d=table.column("digest").to_pylist(), p=table.column("piece").to_pylist(): (-v[i].max(), d[i], p[i]))
    return table.take(pa.array(order, pa.int64())), v[order]


def _in_cells(items: DataFrame, cells: int, residual: np.ndarray, total: np.ndarray, unit: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(digest, piece, shard): each cell's items towards the cell's share of `residual`; `total` is that of all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["cell"]):
            table, v = _largest_first(table, unit)
            share = v.sum(0) / np.where(total > 0, total, 1)
            shard = place(v, residual * share, weights)
            yield from pa.table({"digest": table.column("digest"), "piece": table.column("piece"), "shard": pa.array(shard)}).to_batches()

    dealt = items.withColumn("cell", F.pmod(F.xxhash64("digest", "piece"), F.lit(cells)).cast("int"))
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "digest binary, piece int, shard int")


def _slots(rows: DataFrame, store: Store, block: int, count: int) -> DataFrame:
    """`rows` with `slot`: from 0 without gaps in every shard, by block and row.

    Blocks keep a shard's rows out of one task: rows are numbered within a
    block, and blocks by the rows before them.
    """
    blocks = max(1, count // block)
    placed = store.table(rows.withColumn("_block", F.pmod(F.xxhash64("uid"), F.lit(blocks))), "placed")
    sizes = placed.groupBy("shard", "_block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "_block", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("uid")).cast("long") - 1
    return placed.withColumn("_own", own).join(starts, ["shard", "_block"]).withColumn("slot", F.col("_own") + F.col("before")).drop("_own", "before", "_block")


def pack(docs: DataFrame, packing: Packing = Packing(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, tokens, shard, slot): every row of docs in one of the shards.

    size: UTF-8 bytes and 16; tokens: words between white space. Equal texts
    stay together unless they are more than a shard holds in bytes, tokens or
    rows; then their rows are dealt to pieces. Repeated rows and null ids take
    part as rows of their own; null texts are empty ones; no rows give none.
    With fewer groups than shards, shards stay empty. Further columns are not read.
    """
    spark, p = docs.sparkSession, packing
    store = Store(spark, "shards")
    rows = store.table(sized(docs, id, text), "rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    whole = rows.agg(*sums).first()
    total = np.array([float(whole[c] or 0) for c in DIMS])
    unit = np.maximum(total / p.shards, 1e-9)
    weights = np.array(p.weights)

    def share(*cols: str) -> Column:
        return F.greatest(*(F.col(c) / F.lit(float(u)) for c, u in zip(cols, unit, strict=True)))

    # At most 3 * shards texts fill more than a shard.
    wide = rows.groupBy("digest").agg(*sums).where((share(*DIMS) > 1) & (F.col("rows") > 1))
    wide = wide.select("digest", F.least(F.col("rows"), F.ceil(share(*DIMS) / p.piece)).cast("int").alias("pieces"))
    hot = spark.createDataFrame(wide.collect(), wide.schema)
    cut = rows.join(F.broadcast(hot), "digest", "left")
    cut = cut.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("uid"), F.col("pieces"))).cast("int")).drop("pieces")

    items = store.table(cut.groupBy("digest", "piece").agg(*sums), "items")
    large = items.where(share(*DIMS) >= p.large)
    first, v = _largest_first(large.toArrow(), unit)
    residual = np.ones((p.shards, 3))
    shard = place(v, residual, weights)
    np.subtract.at(residual, shard, v)
    told = [(d, k, int(s)) for d, k, s in zip(first.column("digest").to_pylist(), first.column("piece").to_pylist(), shard, strict=True)]
    fixed = spark.createDataFrame(told, "digest binary, piece int, large int")

    small = items.where(share(*DIMS) < p.large)
    cells = max(1, -(-small.count() // p.cell))
    dealt = _in_cells(small, cells, residual, total / unit - v.sum(0), unit, weights)
    # The large ones, bounded by the shards, are broadcast: a shard's share of all rows may have one digest.
    both = cut.join(F.broadcast(fixed), ["digest", "piece"], "left")
    known = both.where("large is not null").withColumnRenamed("large", "shard")
    rest = both.where("large is null").drop("large").join(dealt, ["digest", "piece"])
    names = ["uid", id, "size", "text_crc32", "tokens", "shard"]
    return _slots(known.select(*names).union(rest.select(*names)), store, p.cell * p.shards, int(whole["rows"])).drop("uid")
