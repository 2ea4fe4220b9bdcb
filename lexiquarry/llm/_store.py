"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where Spark is local and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        named = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
        spark.conf.set("spark.checkpoint.dir", named)
        return named
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class Store:
    """Tables of one run of an operator, each written once and read by later steps.

    A written table cuts lineage: the loss of an executor costs the running
    step's tasks only. `drop` removes a table that no later step reads; what
    is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.where: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            return

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.where[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.where.pop(id(t), ""):
                self._remove(path)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a stream of sorted batches, whole even across batches."""
    import numpy as np

    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [np.asarray(t.column(k)) for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_tables(held)
