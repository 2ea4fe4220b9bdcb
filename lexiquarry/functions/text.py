"""String operators as Column functions; Arrow UDFs only for Unicode normal forms, a block of texts at a time."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as L

ENTITY_JSON = "array<struct<text:string,position:array<int>,type:string,assertions:array<string>,candidates:array<string>>>"
#: Bytes of text that become Python strings at once.
BLOCK = 1 << 20


def strip(x: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lower_strip(x: Column) -> Column:
    return strip(F.lower(x))


def collapse_space(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def in_blocks(x: pa.Array, size: int = BLOCK) -> Iterator[pa.Array]:
    """The texts of an Arrow array, about `size` bytes at a time: as Python strings, with what is made of them, they take many times their bytes."""
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    cuts = sorted({0, *np.searchsorted(before, np.arange(size, before[-1], size)).tolist(), len(x)})
    return (x.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def _mapped(x: pa.Array, change: Callable[[str], str]) -> pa.Array:
    parts = [pa.array([None if s is None else s if s.isascii() else change(s) for s in part.to_pylist()], pa.string()) for part in in_blocks(x)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def nfc(x: pa.Array) -> pa.Array:
    """Canonical composition."""
    return _mapped(x, lambda s: unicodedata.normalize("NFC", s))


def _unmarked(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


@F.arrow_udf(T.StringType())
def strip_marks(x: pa.Array) -> pa.Array:
    """Without combining marks; letters like đ, which don't decompose, stay."""
    return _mapped(x, _unmarked)


def unify_variants(x: Column) -> Column:
    return F.regexp_replace(x, L.VARIANT_WORDS, "type")


def strip_parentheses(x: Column) -> Column:
    return strip(F.regexp_replace(x, L.PARENTHESES, " "))


def replace_whole(x: Column, table: dict[str, str]) -> Column:
    """The table's value for the whole string, the string itself where there is none."""
    pairs = F.create_map(*(F.lit(s) for kv in table.items() for s in kv))
    return F.coalesce(F.element_at(pairs, x), x)


def strip_dose(x: Column, pattern: str = L.DOSE_LONG) -> Column:
    return F.regexp_replace(x, pattern, "")


def strip_stars(x: Column) -> Column:
    return F.regexp_replace(x, r"\*+", "")


def strip_diagnosis_prefix(x: Column) -> Column:
    return F.regexp_replace(x, L.DIAGNOSIS_PREFIX, "")


def strip_trailing_qualifier(x: Column) -> Column:
    return F.regexp_replace(x, L.TRAILING_QUALIFIER, "")


def strip_key_prefix(x: Column) -> Column:
    return strip(F.regexp_replace(x, L.KEY_PREFIX, ""))


def normalize_mention(x: Column, kind: Column, full: bool = True) -> Column:
    """A mention as dictionaries spell it; `full` is the long rule set, else the short one."""
    base = lower_strip(x)
    if full:
        base = strip_parentheses(unify_variants(base))
    base = replace_whole(base, L.SYNONYMS_FULL if full else L.SYNONYMS_SHORT)
    drug = strip_dose(base, L.DOSE_LONG if full else L.DOSE_SHORT)
    diagnosis = strip_diagnosis_prefix(base)
    if full:
        drug, diagnosis = strip_stars(drug), strip_trailing_qualifier(diagnosis)
    return F.when(kind == L.DRUG, collapse_space(drug)).when(kind == L.DIAGNOSIS, collapse_space(diagnosis)).otherwise(base)


def clean_codes(codes: Column) -> Column:
    """Codes without footnote marks; empty ones go before that."""
    return F.transform(F.filter(codes, lambda c: c.isNotNull() & (c != "")), lambda c: strip(F.translate(c, "*†", "")))


def split_glued(x: Column, table: dict[str, str] | None = None) -> Column:
    for glued, parts in (table or L.GLUED_WORDS).items():
        x = F.regexp_replace(x, f"(?iu){re.escape(glued)}", parts)
    return x


def is_test_name(x: Column) -> Column:
    return any_of(F.contains(F.lower(x), F.lit(k)) for k in L.TEST_KEYWORDS)


def is_common_symptom(x: Column) -> Column:
    return F.lower(x).isin(*L.COMMON_SYMPTOMS)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_false_positive(x: Column) -> Column:
    text = lower_strip(x)
    return text.isin(*L.FALSE_EXACT) | any_of(text.rlike(f"(?U){p}") for p in L.FALSE_PATTERNS)


def parse_entities(raw: Column) -> Column:
    """The entity array of a model's answer, without its code fence; empty where it can't be read."""
    # A long answer is only searched for a fence, and for space at its ends, where there is one.
    trimmed = F.when(F.substring(raw, 1, 1).rlike(r"(?U)\s") | F.substring(raw, -1, 1).rlike(r"(?U)\s"), strip(raw)).otherwise(raw)
    bare = F.when(F.contains(trimmed, F.lit("```")), F.regexp_replace(trimmed, r"(?m)^```json\s*|```$", "")).otherwise(trimmed)
    return F.coalesce(F.from_json(bare, ENTITY_JSON), F.array().cast(ENTITY_JSON))


def parse_embedded_entities(raw: Column) -> Column:
    """The array between the first [ and the last ] of an answer; empty where there is none or it can't be read."""
    inner = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(F.nullif(inner, F.lit("")), ENTITY_JSON), F.array().cast(ENTITY_JSON))


def valid_entities(entities: Column, flags: tuple[str, ...] = L.PROMPT_FLAGS) -> Column:
    """Entities with a text and a known type; unknown flags go, codes are reset."""
    kept = F.filter(entities, lambda e: e.isNotNull() & (F.coalesce(strip(e["text"]), F.lit("")) != "") & e["type"].isin(*L.TYPES))
    none = F.array().cast("array<string>")
    return F.transform(
        kept,
        lambda e: F.struct(
            strip(e["text"]).alias("text"),
            e["position"].alias("position"),
            e["type"].alias("type"),
            F.filter(F.coalesce(e["assertions"], none), lambda a: a.isin(*flags)).alias("assertions"),
            none.alias("candidates"),
        ),
    )


def quoted_document(prompt: Column) -> Column:
    '''The text between the last pair of """ marks of a prompt; the prompt itself where there are fewer than two.'''
    parts = F.split(prompt, '"""', -1)
    return F.when(F.size(parts) >= 3, strip(F.element_at(parts, -2))).otherwise(prompt)


def plain_words(x: Column) -> Column:
    """Lower-case words without punctuation."""
    bare = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", "")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
