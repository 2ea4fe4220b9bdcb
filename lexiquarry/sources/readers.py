"""Readers of documents, entities, examples and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENTITY_JSON

STEM = r"([^/]+)\.[^./]+$"


def stem(path: Column) -> Column:
    """A file's name without folder and extension, percent-encoding undone."""
    return F.url_decode(F.replace(F.regexp_extract(path, STEM, 1), F.lit("+"), F.lit("%2B")))


def numeric_stem(name: Column, other: int = 9999) -> Column:
    """The number that a stem is; `other` for stems that are none, which so come last."""
    return F.coalesce(name.try_cast("int"), F.lit(other))


def text_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(stem, doc_id, path, text): each .txt file is a document; doc_id is null for stems that are no number."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
    rows = (reader.option("recursiveFileLookup", True) if recursive else reader).load(path).select("path", F.col("content").cast("string").alias("text"))
    rows = rows.union(spark.createDataFrame([(p, "") for p in _empty_files(spark, path, ".txt", recursive)], "path string, text string"))
    return rows.select(stem(F.col("path")).alias("stem"), stem(F.col("path")).try_cast("long").alias("doc_id"), "path", "text")


def _empty_files(spark: SparkSession, path: str, suffix: str, recursive: bool) -> list[str]:
    """Files without content, which the binary reader passes over; found by listing names and lengths, as every scan does."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, recursive)
    out = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(suffix):
            out.append(f.getPath().toString())
    return sorted(out)


def in_order(docs: DataFrame) -> DataFrame:
    """Documents by the number of their stem."""
    return docs.orderBy(numeric_stem(F.col("stem")), "stem")


def text_files_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Like `text_files`: bytes that are no UTF-8 become U+FFFD, and a byte order mark goes."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "")
    rows = rows.select("path", text.alias("text")).union(spark.createDataFrame([(p, "") for p in _empty_files(spark, path, ".txt", False)], "path string, text string"))
    return rows.select(stem(F.col("path")).alias("stem"), stem(F.col("path")).try_cast("long").alias("doc_id"), "path", "text")


def entity_files(spark: SparkSession, path: str, docs: DataFrame | None = None) -> DataFrame:
    """Entity rows of files that each hold a JSON array; stats.json isn't read.

    An unreadable file and, with `docs`, a document without a file have no
    rows of their own. doc_id comes from the file's stem, ord is the place in the array.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    rows = rows.select(stem(F.col("path")).alias("stem"), F.from_json(F.col("content").cast("string"), ENTITY_JSON).alias("es")).where("stem <> 'stats'")
    flat = rows.select(F.col("stem").try_cast("long").alias("doc_id"), "stem", F.posexplode_outer("es").alias("ord", "e"))
    none = F.array().cast("array<string>")
    out = flat.where("e is not null").select(
        "doc_id", "stem", F.col("ord").cast("long").alias("ord"),
        F.get("e.position", F.lit(0)).alias("start"), F.get("e.position", F.lit(1)).alias("end"), "e.text", "e.type",
        F.coalesce("e.assertions", none).alias("assertions"), F.coalesce("e.candidates", none).alias("candidates"),
    )
    if docs is None:
        return out
    # Stems tell documents apart that have no number; tables that don't come from files have none.
    if "stem" in docs.columns:
        return docs.select("stem", "doc_id").join(out.drop("doc_id"), "stem", "left").select(out.columns)
    return docs.select("doc_id").join(out, "doc_id", "left")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of {conversations: [{from, value}]}."""
    return spark.read.option("multiLine", True).schema("conversations array<struct<from:string,value:string>>").json(path)


def dictionary(spark: SparkSession, path: str, code: str, name: str) -> DataFrame:
    """(name, code, ord) of a two-column table in Parquet; rows without a name go. `ord` is the row's own where the table has one."""
    rows = spark.read.parquet(path)
    order = F.col("ord") if "ord" in rows.columns else F.monotonically_increasing_id()
    return rows.select(F.col(name).alias("name"), F.col(code).cast("string").alias("code"), order.alias("ord")).where("name is not null and name <> ''")


def sqlite_dictionary(spark: SparkSession, file: str, table: str, code: str, name: str, limit_bytes: int = 256 << 20) -> DataFrame:
    """The same from a SQLite file on the driver, whose size is checked first: such dictionaries are small files."""
    import os
    import sqlite3

    if os.path.getsize(file) > limit_bytes:
        raise ValueError(f"{file} is larger than {limit_bytes} bytes: convert it to Parquet and use dictionary()")
    for word in (table, code, name):
        if not word.isidentifier():
            raise ValueError(f"not an identifier: {word}")
    with sqlite3.connect(file) as db:
        rows = [(n, str(c), i) for i, (c, n) in enumerate(db.execute(f"SELECT {code}, {name} FROM {table}")) if n]
    return spark.createDataFrame(rows, "name string, code string, ord long")


def pending(docs: DataFrame, done: DataFrame, id: str = "doc_id") -> DataFrame:
    """Documents that have no output yet."""
    return docs.join(done.select(id).distinct(), id, "left_anti")
