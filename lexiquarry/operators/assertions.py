"""Context flags of an entity from keywords in its sentence."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from .spans import _lists, _nested, _slice, packed

#: Contexts that are Python objects at once.
HELD = 1 << 15
_SENTENCE_END = re.compile(r"[.?!\n]")
_EDGE = r"[\s.,;:?!\-]"


def context(doc: Column, start: Column, end: Column, before: int = 40, after: int = 20) -> tuple[Column, Column]:
    """Lower-case text of the entity's sentence before and after it; sentences end at . ? ! and line ends."""
    # Only characters that can be in a window are cut out, so a long text costs no more than a short one.
    first = F.greatest(start - before, F.lit(0)).cast("int")
    # \z: a $ would also match before a line end, and the line before would count.
    left = F.regexp_extract(F.substring(doc, first + 1, (start - first).cast("int")), r"[^.?!\n]*\z", 0)
    right = F.regexp_extract(F.substring(doc, (end + 1).cast("int"), F.lit(after)), r"^[^.?!\n]*", 0)
    return F.lower(left), F.lower(right)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])))
def _around(doc: pa.Array, starts: pa.Array, ends: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
    parts, out, many, kinds = [], [], 0, {"left": pa.string(), "right": pa.string()}
    for d, b, a, (s, e) in zip(doc, before, after, _lists(starts, ends), strict=True):
        d, b, a = d.as_py(), b.as_py(), a.as_py()
        out.append([_sentence(d, x, y, b, a) for x, y in zip(s, e, strict=True)])
        many += len(s)
        if many >= HELD:
            parts.append(_nested(out, kinds))
            out, many = [], 0
    return pa.concat_arrays([*parts, _nested(out, kinds)])


def _sentence(doc: str | None, start: int | None, end: int | None, before: int, after: int) -> tuple[str | None, str | None]:
    """The characters of `context`, in their case, of a text that is read once for all of its entities."""
    left = right = None
    if doc is not None and start is not None:
        first = max(start - before, 0)
        left = _SENTENCE_END.split(_slice(doc, first, start))[-1]
    if doc is not None and end is not None:
        right = _SENTENCE_END.split(_slice(doc, end, end + after), maxsplit=1)[0]
    return left, right


def with_context(entities: DataFrame, docs: DataFrame, before: int = 40, after: int = 20, id: str = "doc_id") -> DataFrame:
    """Entities with _left and _right, the `context` of each; a document meets the lists of its entities."""
    spots = [F.col(f"mention.{c}").cast("array<bigint>") for c in ("start", "end")]
    rows = packed(entities, docs, id).select("mention", _around("doc", *spots, F.lit(before), F.lit(after)).alias("c"))
    each = rows.select(F.explode(F.arrays_zip("mention", "c")).alias("x"))
    return each.select(*(F.col(f"x.mention.`{c}`").alias(c) for c in entities.columns), F.lower("x.c.left").alias("_left"), F.lower("x.c.right").alias("_right"))


def has_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a keyword stands between space, marks or the text's ends."""
    return text.rlike(f"(?U)(?:^|{_EDGE})(?:{'|'.join(re.escape(k) for k in keywords)})(?:$|{_EDGE})")


def flags(left: Column, right: Column, own: Column, negation: tuple[str, ...] = L.NEGATION, history: tuple[str, ...] = L.HISTORY, family: tuple[str, ...] = L.FAMILY, look_after: bool = True) -> Column:
    """The entity's flags and those that its context adds, sorted."""
    negated = has_keyword(left, negation)
    if look_after:
        negated = negated | has_keyword(right, negation)
    flag = lambda on, name: F.when(on, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.coalesce(own, F.array().cast("array<string>")), flag(negated, "isNegated"), flag(has_keyword(left, history), "isHistorical"), flag(has_keyword(left, family), "isFamily"))
    return F.array_sort(F.array_distinct(every))


def with_flags(entities: DataFrame, docs: DataFrame, ensemble: bool = False, id: str = "doc_id") -> DataFrame:
    """Entities with context flags: of symptoms, diagnoses and drugs, or of all types with the shorter family list (`ensemble`, no look after)."""
    rows = with_context(entities, docs, id=id)
    found = flags(F.col("_left"), F.col("_right"), F.col("assertions"), family=L.FAMILY_ENSEMBLE if ensemble else L.FAMILY, look_after=not ensemble)
    value = found if ensemble else F.when(F.col("type").isin(*L.ASSERTED_TYPES), found).otherwise(F.col("assertions"))
    return rows.withColumn("assertions", value).drop("_left", "_right")
