"""A corpus pipeline of five stages; each is a function (spark, docs, sf_dir) -> DataFrame.

`run` writes the result of every stage as Parquet and rereads it as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import bpe, decontam, minhash, quality, toxicity
from lexiquarry.llm._store import Store
from lexiquarry.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null, empty and blank texts have quality 0 and go. Every row is judged by
    its text alone, so repeated rows stay or go together, with or without an id.
    """
    return quality.score(docs, quality.train(docs)).where("good").select(*COLUMNS)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic.

    Labels of ids that the documents lack tell nothing; with several labels an
    id counts once for each. Null and empty texts have no toxic passage and
    stay; repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def _nodes(spark: SparkSession, docs: DataFrame, store: Store) -> DataFrame:
    """`docs` with `node`: the id, or where an id has several texts a 64-bit hash of id and text, above all ids under 2^62."""
    digest = F.xxhash64("text")
    clashes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    clashes = store.table(clashes.where("low <> high").select("doc_id", F.lit(True).alias("clash")), "clashes")
    own = F.col("doc_id").cast("long")
    if clashes.isEmpty():
        return docs.select(*COLUMNS, own.alias("node"))
    hashed = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1)
    rows = docs.select(*COLUMNS).join(clashes, "doc_id", "left")
    return store.table(rows.select(*COLUMNS, F.when(F.col("clash"), hashed).otherwise(own).alias("node")), "nodes")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, a similarity of 0.8 or more.

    The document with the smallest id stays. A document is an id with a text:
    where an id has several texts each is judged alone, after those whose id
    has one. Of rows that share id and text one stays, that with the least
    other columns. Texts without words are in no group and stay, as do rows
    without an id, which no group can name.
    """
    store = Store(spark, "pipeline")
    rows = _nodes(spark, docs, store)
    found = minhash.near_duplicates(rows, minhash.MinMax(shingle=5, percent=80, bands=45), id="node").withColumnRenamed("doc_id", "node")
    flags = found.where("node is not null").groupBy("node").agg(F.min("kept").alias("stays"), F.count("*").alias("rows"))
    flags = store.table(flags.where("not stays or rows > 1"), "copies")
    once = rows.join(flags.select("node"), "node", "left_anti").select(*COLUMNS)
    several = rows.join(flags.where("stays").select("node"), "node", "left_semi")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    several = several.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    return once.union(several.select("doc_id", "text", "rest.*").select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; one that holds any goes whole, with all rows of its id.

    Items of one or two words are common words, so only documents of just these
    words hold them. Rows without an id or text hold nothing and stay; so do all
    documents if the benchmark is empty.
    """
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=3)
    gone = Store(spark, "pipeline").table(found.select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    Null and empty texts have no ids and come back as the empty text. Rows are
    neither dropped nor joined; columns beyond those of documents are not read.
    """
    shared = bpe.vocabulary(spark, vocabulary_path())
    told = F.coalesce("text", F.lit(""))
    digest = F.sha2(told, 256).alias("digest")
    both = bpe.encode_decode(docs.select("doc_id", told.alias("text"), "lang", "source", digest), shared)
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("encode", encode),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    store = Store(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = store.table(stage(spark, docs, sf_dir), name)
        store.drop(docs)
        docs = after
    return docs
