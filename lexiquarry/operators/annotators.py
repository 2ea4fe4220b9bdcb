"""Annotators: whatever turns texts into entity rows.

Models are pluggable: anything that maps a frame of texts to entity rows runs
through `annotate`, in Arrow batches, loaded once per task. Keyword
annotators are built of expressions and need no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from .settle import settled
from .spans import FIELDS

ENTITIES = "doc_id long, ord long, start int, end int, text string, type string, assertions array<string>, candidates array<string>"


class Annotator(Protocol):
    def __call__(self, texts: list[str]) -> list[list[dict]]:
        """For each text its entities: dicts of text, position, type and, where known, assertions and candidates."""


def _rows(key: int, found: list[dict]) -> list[tuple]:
    out = []
    for k, e in enumerate(found):
        place = [*(e.get("position") or []), None, None]
        out.append((key, k, place[0], place[1], e.get("text", ""), e.get("type", ""), list(e.get("assertions") or []), list(e.get("candidates") or []), None))
    return out


def annotate(docs: DataFrame, load: Callable[[], Annotator], batch: int = 16, id: str = "doc_id", text: str = "text", isolate: bool = False) -> DataFrame:
    """Entity rows of an annotator; `load` runs once in each task. Entities without a place get null positions.

    An error of the annotator ends the run. With `isolate` it doesn't: the
    texts of its batch are given again one by one, and one that fails alone
    gives a single row of its id with the error in a further column `error`
    (null in entity rows); `parted` takes the two apart.
    """

    def attempt(model: Annotator, keys: list[int], texts: list[str]) -> list[tuple]:
        try:
            return [r for key, found in zip(keys, model(texts), strict=True) for r in _rows(key, found)]
        except Exception as error:
            if not isolate:
                raise
            if len(texts) > 1:
                return [r for key, one in zip(keys, texts, strict=True) for r in attempt(model, [key], [one])]
            return [(keys[0], *[None] * 7, f"{type(error).__name__}: {error}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                rows = attempt(model, part["doc_id"].tolist(), part["text"].fillna("").tolist())
                out = pd.DataFrame(rows, columns=["doc_id", "ord", *FIELDS, "error"]).astype({"doc_id": "int64", "ord": "Int64", "start": "Int32", "end": "Int32"})
                yield out if isolate else out.drop(columns="error")

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, ENTITIES + ", error string" * isolate)


def parted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity rows, and (doc_id, error) of the documents that failed, from one run of an isolated annotator."""
    found = settled(found)
    return found.where("error is null").drop("error"), found.where("error is not null").select("doc_id", "error")


def keywords(docs: DataFrame, words: dict[str, str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Entity rows for whole-word hits, case ignored, of words (a word: its type); longer words first where they begin together.

    A text is cut into hits and what is between them; places are running sums
    in the document's own window, so the work follows the text's length.
    """
    found = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    hit = rf"(?<![\p{{L}}\p{{N}}_])(?:{found})(?![\p{{L}}\p{{N}}_])"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?iu)(?:{hit}|(?s:.)(?:(?!{hit})(?s:.))*+)"), F.lit(0))
    table = F.create_map(*(F.lit(v) for k, kind in words.items() for v in (k.lower(), kind)))
    rows = docs.select(F.col(id).alias("doc_id"), F.posexplode(pieces).alias("_k", "text"))
    w = Window.partitionBy("doc_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("text")).over(w).cast("int")).withColumn("type", F.element_at(table, F.lower("text"))).where("type is not null")
    none = F.array().cast("array<string>")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("_k")).cast("long") - 1
    return rows.select("doc_id", order.alias("ord"), (F.col("end") - F.length("text")).cast("int").alias("start"), "end", "text", "type", none.alias("assertions"), none.alias("candidates"))


class Mock:
    """Two fixed entities for every text, for tests of what comes after a model."""

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        fixed = [{"text": "tăng huyết áp", "position": [14, 27], "type": L.DIAGNOSIS}, {"text": "Aspirin", "position": [40, 47], "type": L.DRUG}]
        return [[dict(e) for e in fixed] for _ in texts]
