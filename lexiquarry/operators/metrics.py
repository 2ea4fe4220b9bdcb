"""Evaluation: pairing of predicted and gold entities, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .spans import paired


def pairs(gold: DataFrame, pred: DataFrame, least: float = 0.5, id: str = "doc_id") -> DataFrame:
    """(doc_id, gold, pred): entities of one type paired greedily by IoU in gold's order; unpaired ones with a null."""
    return paired(gold, pred, least, id).select(id, F.col("a").alias("gold"), F.col("b").alias("pred"))


def word_errors(gold: Column, pred: Column) -> Column:
    """Edit distance in words: each distinct word becomes one character, then Levenshtein.

    Time and memory grow with the product of the lengths. Up to 90,000 distinct
    words have characters; more raise an error.
    """
    words = lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    # Words and their places are worked out once a pair, not for each word.
    let = lambda value, f: F.transform(F.array(value), f)[0]
    # U+10000 onwards, in UTF-32: no code is a surrogate.
    letter = lambda k: F.decode(F.unhex(F.lpad(F.hex(k + 0x10000), 8, "0")), "UTF-32")
    coded = lambda x, both: F.array_join(F.transform(x, lambda w: letter(F.array_position(both, w))), "")
    most = F.raise_error(F.lit("over 90,000 distinct words in one pair")).cast("int")

    def errors(x: Column) -> Column:
        return let(F.array_distinct(F.concat(x["g"], x["p"])), lambda both: F.when(F.size(both) > 90_000, most).otherwise(F.levenshtein(coded(x["g"], both), coded(x["p"], both))))

    return let(F.struct(words(gold).alias("g"), words(pred).alias("p")), errors)


def text_score(gold: Column, pred: Column, errors: Column | None = None) -> Column:
    """One less the word error rate, 0 at least; `errors` are the word errors where they are known."""
    n = F.size(F.filter(F.split(gold, r"(?U)\s+"), lambda w: w != ""))
    return F.greatest(F.lit(0.0), 1 - (word_errors(gold, pred) if errors is None else errors) / F.greatest(n, F.lit(1)))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def component_scores(gold: DataFrame, pred: DataFrame, denominator: str = "union", both_empty: float = 1.0, least: float = 0.5, id: str = "doc_id") -> DataFrame:
    """One row: text_score, assertions_score, candidates_score and final_score.

    denominator "union": unpaired entities of either side count as 0; "matched":
    means over pairs. Assertions count for symptoms, diagnoses and drugs,
    candidates for diagnoses and drugs.
    """
    return scores_of_pairs(pairs(gold, pred, least, id), denominator, both_empty)


def scores_of_pairs(rows: DataFrame, denominator: str = "union", both_empty: float = 1.0) -> DataFrame:
    """`component_scores` of rows (gold, pred)."""
    if denominator == "matched":
        rows = rows.where("gold is not null and pred is not null")
    matched = F.col("gold").isNotNull() & F.col("pred").isNotNull()
    kind = F.coalesce("gold.type", "pred.type")
    mean = lambda s, ok: F.avg(F.when(ok, F.when(matched, s).otherwise(0.0)))
    out = rows.agg(
        F.coalesce(mean(text_score(F.col("gold.text"), F.col("pred.text")), F.lit(True)), F.lit(0.0)).alias("text_score"),
        F.coalesce(mean(jaccard(F.col("gold.assertions"), F.col("pred.assertions"), both_empty), kind.isin(*L.ASSERTED_TYPES)), F.lit(0.0)).alias("assertions_score"),
        F.coalesce(mean(jaccard(F.col("gold.candidates"), F.col("pred.candidates"), both_empty), kind.isin(*L.LINKED_TYPES)), F.lit(0.0)).alias("candidates_score"),
    )
    return out.withColumn("final_score", final_score(F.col("text_score"), F.col("assertions_score"), F.col("candidates_score")))


def final_score(text: Column, assertions: Column, candidates: Column) -> Column:
    return 0.3 * text + 0.3 * assertions + 0.4 * candidates


def span_scores(gold: DataFrame, pred: DataFrame, id: str = "doc_id") -> DataFrame:
    """(type, gold, pred, correct, precision, recall, f1) of exact spans by type, and over all as type "all"."""
    key = [id, "start", "end", "type"]
    sides = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select(*key, F.lit(0), F.lit(1)))
    return scores_of_sides(sides, id)


def scores_of_sides(sides: DataFrame, id: str = "doc_id") -> DataFrame:
    """`span_scores` of rows (doc_id, start, end, type, g, p), where g and p are 1 if the span is gold, or predicted."""
    key = [id, "start", "end", "type"]
    spans = sides.groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counts = spans.rollup("type").agg(F.sum("g").alias("gold"), F.sum("p").alias("pred"), F.sum(F.col("g") * F.col("p")).alias("correct"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("correct"), F.col("pred")), safe(F.col("correct"), F.col("gold"))
    return counts.select(F.coalesce("type", F.lit("all")).alias("type"), "gold", "pred", "correct", p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"))


def token_accuracy(tags: DataFrame, gold: str = "gold", pred: str = "pred", ignored: int = -100) -> DataFrame:
    rows = tags.where(F.col(gold) != ignored)
    return rows.agg(F.count("*").alias("n"), F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"))


def side_by_side(a: DataFrame, b: DataFrame, key: str = "type", value: str = "f1") -> DataFrame:
    """(key, a, b, delta) over the keys of either table; what one lacks is 0."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    return both.select(key, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")).withColumn("delta", F.col("b") - F.col("a"))
