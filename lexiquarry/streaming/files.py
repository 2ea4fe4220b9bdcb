"""The document pipelines as file streams: new files are processed once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import stem


def read_texts(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(stem, doc_id, text) of .txt files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", per_trigger)
    name = stem(F.col("path"))
    return reader.load(path).select(name.alias("stem"), name.try_cast("long").alias("doc_id"), F.col("content").cast("string").alias("text"))


def run(docs: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch of documents through a batch pipeline into Parquet; a batch that is repeated after a failure replaces its own files."""

    def batch(df: DataFrame, number: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
