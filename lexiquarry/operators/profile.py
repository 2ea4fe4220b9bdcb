"""Counts, statistics and audits of documents, entities and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.text import clean_codes, plain_words, strip


def share_by(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, share) of rows by key; the share is of all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))
    return counts.join(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("_total")).alias("share"))


def flag_counts(entities: DataFrame, known_only: bool = False) -> DataFrame:
    rows = entities.select(F.explode("assertions").alias("flag"))
    return (rows.where(F.col("flag").isin(*L.FLAGS)) if known_only else rows).groupBy("flag").agg(F.count("*").alias("n"))


def coverage(entities: DataFrame) -> DataFrame:
    """One row: linkable entities, those with codes and those without."""
    linkable = F.col("type").isin(*L.LINKED_TYPES)
    has = F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 0
    return entities.agg(F.count_if(linkable).alias("eligible"), F.count_if(linkable & has).alias("linked"), F.count_if(linkable & ~has).alias("empty"))


def word_stats(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, docs, mean, min, max) of white space separated words."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return docs.groupBy(*keys).agg(F.count("*").alias("docs"), F.avg(n).alias("mean_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"))


def histogram(df: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """(bin, low, n, density) of equal bins from the least to the greatest value; the last bin holds its upper end."""
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    both = rows.join(F.broadcast(ends)).withColumn("width", width)
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    out = both.withColumn("bin", bin_).groupBy("bin", "lo", "width", "total").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def entities_per_doc(docs: DataFrame, entities: DataFrame, id: str = "doc_id") -> DataFrame:
    """(mean, min, max) of entities by document; documents without any count as 0."""
    n = docs.select(id).join(entities.groupBy(id).agg(F.count("*").alias("n")), id, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))


def type_token_ratio(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, words, types, ratio) of lower-case words without punctuation.

    Words are counted once each in a first aggregation, so the distinct count
    needs no second pass over the text.
    """
    words = docs.select(*keys, F.explode(plain_words(F.col(text))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("n"))
    out = words.groupBy(*keys).agg(F.sum("n").alias("words"), F.count("*").alias("types"))
    return out.withColumn("ratio", F.when(F.col("words") > 0, F.col("types") / F.col("words")).otherwise(0.0))


def error_rate(audited: DataFrame, *keys: str) -> DataFrame:
    """(keys, checked, errors, rate) of rows with `bad`; 0 where nothing was checked."""
    out = audited.groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if("bad").alias("errors"))
    return out.withColumn("rate", F.when(F.col("checked") > 0, F.col("errors") / F.col("checked")).otherwise(0.0))


def discrepancies(entities: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of entities whose cleaned codes differ, as lists, from the linked ones."""
    both = entities.withColumn("own", clean_codes(F.coalesce("candidates", F.array().cast("array<string>")))).join(linked.withColumnRenamed("candidates", "expected"), keys)
    return both.where(~F.col("own").eqNullSafe(F.col("expected")))


def discrepancy_report(entities: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """One row: linkable entities, those without codes, those whose cleaned codes differ from the linked ones, and both shares in %."""
    eligible = entities.where(F.col("type").isin(*L.LINKED_TYPES))
    counts = coverage(eligible).select("eligible", "empty")
    wrong = discrepancies(eligible, linked, keys).agg(F.count("*").alias("wrong"))
    share = lambda c: F.when(F.col("eligible") > 0, F.col(c) / F.col("eligible") * 100).otherwise(0.0)
    return counts.join(F.broadcast(wrong)).select("eligible", "empty", "wrong", share("wrong").alias("wrong_pct"), share("empty").alias("empty_pct"))


def corrupted_symptoms(entities: DataFrame) -> DataFrame:
    """(text, n): how often each plain symptom term is a diagnosis, most often first; the total has a null text and comes first."""
    text = F.lower(strip(F.coalesce("text", F.lit(""))))
    rows = entities.where((F.col("type") == L.DIAGNOSIS) & text.isin(*L.PLAIN_SYMPTOMS)).select(text.alias("text"))
    return rows.rollup("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("text").asc_nulls_first())


def observed(entities: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that has after the first action on them: entities, documents (about), linked ones and the last document's id."""
    seen = Observation(name)
    has = F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 0
    return entities.observe(seen, F.count(F.lit(1)).alias("entities"), F.approx_count_distinct("doc_id").alias("documents"), F.count_if(has).alias("linked"), F.max("doc_id").alias("last_doc")), seen


def top_counts(df: DataFrame, key: str, order: str, n: int | None = None) -> DataFrame:
    """(key, n, first) by falling count, ties by first occurrence in `order`; the first n."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")
    return out if n is None else out.limit(n)


def label_counts(tags: DataFrame, tags_col: str = "ner_tags") -> DataFrame:
    return tags.select(F.explode(tags_col).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def entity_density(examples: DataFrame, tags_col: str = "ner_tags") -> DataFrame:
    """(lines, entities, per_line): entities are the odd tags, which begin one."""
    n = F.size(F.filter(tags_col, lambda x: x % 2 == 1))
    return examples.agg(F.count("*").alias("lines"), F.sum(n).alias("entities"), F.avg(n).alias("per_line"))


def curve_stats(log: DataFrame, order: str, value: str, *keys: str, alert: float = 5.0) -> DataFrame:
    """First, last, reduction in %, least and where, and mean, extremes and population deviation of a series by `order`."""
    rows = log.where(F.col(value).isNotNull())
    first, last = F.min_by(value, order), F.max_by(value, order)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("steps"),
        first.alias("first_value"),
        last.alias("last_value"),
        ((first - last) / first * 100).alias("reduction_pct"),
        F.min(value).alias("min_value"),
        F.min(F.struct(F.col(value), F.col(order)))[order].alias("min_at"),
        F.max(value).alias("max_value"),
        F.min(F.struct((-F.col(value)).alias("v"), F.col(order)))[order].alias("max_at"),
        F.avg(value).alias("mean_value"),
        F.stddev_pop(value).alias("std_value"),
        (F.max(value) > alert).alias("alert"),
    )
    return out


def moving_average(rows: DataFrame, order: list[str], value: str, window: int = 50, keys: list[str] | None = None) -> DataFrame:
    """`rows` with the mean of the last `window` values, only where there are that many.

    Without keys the series is one sequence, which one task must order; give
    keys where there are many series.
    """
    w = Window.partitionBy(*(keys or [])).orderBy(*order)
    mean = F.avg(value).over(w.rowsBetween(1 - window, 0))
    return rows.withColumn("moving_avg", mean).withColumn("_n", F.row_number().over(w)).where(F.col("_n") >= window).drop("_n")


def lines_with(docs: DataFrame, mentions: DataFrame, n: int = 10, id: str = "doc_id") -> DataFrame:
    """The first n lines, by document and line, that hold one of their document's mentions (text)."""
    lines = docs.select(id, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hit = lines.join(mentions.select(id, F.col("text").alias("mention")).distinct(), id).where(F.contains("line", "mention") & (F.col("mention") != ""))
    return hit.orderBy(id, "line_no", "mention").limit(n)


def preview(df: DataFrame, order: list[str], n: int = 40) -> DataFrame:
    return df.orderBy(*order).limit(n)
