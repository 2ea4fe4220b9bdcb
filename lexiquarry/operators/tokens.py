"""Tokens with exact code point offsets, and overlapping windows over them.

Offsets are places among a text's code points, or running lengths of tokens
and gaps, never a regular expression's own positions (which count UTF-16
units). A document's tokens come from its row alone, so they need no shuffle. Token rows are narrow: the
document's text isn't repeated in them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import in_blocks

#: White space of any script, as a regular expression's class and as characters.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Runs of non-white space, with the space before them.
SPACED = rf"[{SPACE}]*[^{SPACE}]+"
#: Words (letters, digits, underscore; combining marks end a word) or single marks, with the space before them.
WORDS = rf"[{SPACE}]*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}])"
CHUNKS = "array<struct<text:string,start_offset:int>>"
TOKENS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: Bytes of text that are cut to tokens at once.
BLOCK = 1 << 20


def pieces(text: Column, pattern: str = SPACED) -> Column:
    """The tokens of a text, each with the space before it."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bare(piece: Column) -> Column:
    return F.ltrim(piece, F.lit(SPACE_CHARS))


@cache
def _kinds(pattern: str) -> np.ndarray:
    """For each code point 0 (space), 1 (runs are one token) or 2 (a token alone)."""
    kinds = np.full(0x110000, 1, np.uint8)
    if pattern == WORDS:
        kinds[:] = [1 if unicodedata.category(chr(c))[0] in "LN" else 2 for c in range(0x110000)]
        kinds[ord("_")] = 1
    kinds[[ord(c) for c in SPACE_CHARS]] = 0
    return kinds


def _cut(texts: pa.Array, kinds: np.ndarray) -> pa.Array:
    """TOKENS of some texts, worked out on all their code points at once."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pc.fill_null(texts, "")), "")[0].as_buffer()
    code = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    kind = np.concatenate([[0], kinds[code], [0]])
    edge = np.zeros(len(code) + 1, bool)  # whether a text ends before this place
    edge[bounds] = True
    here, change = kind[1:-1] > 0, (kind[1:] != kind[:-1]) | edge | (kind[1:] == 2)
    begin = np.flatnonzero(here & change[:-1])
    end = np.flatnonzero(here & (change[1:] | (kind[1:-1] == 2))) + 1
    row = np.searchsorted(bounds, begin, "right") - 1
    wide = np.concatenate([[0], np.cumsum(np.array([1, 2, 3, 4], np.int64)[np.searchsorted([0x80, 0x800, 0x10000], code, "right")])])
    inside = np.repeat(here, np.diff(wide))
    offsets = np.concatenate([[0], np.cumsum(wide[end] - wide[begin])]).astype(np.int32)
    word = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(data, np.uint8)[inside].tobytes()))
    rows = pa.StructArray.from_arrays([word, *(pa.array((x - bounds[row]).astype(np.int32)) for x in (begin, end))], ["word", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, bounds).astype(np.int32)), rows, mask=texts.is_null())


@F.arrow_udf(TOKENS)
def _spaced(texts: pa.Array) -> pa.Array:
    return _in_blocks(texts, _kinds(SPACED))


@F.arrow_udf(TOKENS)
def _words(texts: pa.Array) -> pa.Array:
    return _in_blocks(texts, _kinds(WORDS))


def _in_blocks(texts: pa.Array, kinds: np.ndarray) -> pa.Array:
    """`_cut` for about `BLOCK` bytes at a time: a text's code points take many times its bytes."""
    parts = [_cut(part, kinds) for part in in_blocks(texts, BLOCK)]
    return pa.concat_arrays(parts) if parts else _cut(texts, kinds)


def token_lists(docs: DataFrame, pattern: str = SPACED, id: str = "doc_id", text: str = "text", *kept: str) -> DataFrame:
    """(doc_id, kept, t): each text's tokens (TOKENS) in order by SPACED or WORDS; null for null. Nothing is shuffled."""
    return docs.select(id, *kept, {SPACED: _spaced, WORDS: _words}[pattern](F.col(text)).alias("t"))


def tokens(docs: DataFrame, pattern: str = SPACED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ord, word, start, end): one row for each token, ord from 0. Null and empty texts give no rows."""
    rows = token_lists(docs, pattern, id, text).select(id, F.posexplode("t").alias("ord", "x"))
    return rows.select(id, "ord", "x.word", "x.start", "x.end")


def word_windows(docs: DataFrame, size: int = 256, overlap: int = 60, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, start_offset, end_offset): windows of `size` words that overlap by `overlap`.

    The last window ends at the last word. A text without words is one window
    of the whole text at 0. Nothing is shuffled: a document's words are summed
    up by stride inside its row, in time linear in its length.
    """
    stride = max(size - overlap, 1)
    n = F.size("_p")
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")
    chars = lambda first, many: F.length(F.array_join(F.slice("_p", first + 1, many), ""))

    def one(k: Column) -> Column:
        head = F.get(F.col("_p"), k * stride)
        return F.struct(chars(k * stride, F.lit(stride)).alias("step"), chars(k * stride, F.lit(size)).alias("span"), (F.length(head) - F.length(bare(head))).alias("gap"))

    rows = docs.select(F.col(id), F.coalesce(F.length(text), F.lit(0)).alias("_n"), F.coalesce(pieces(F.col(text)), F.array().cast("array<string>")).alias("_p"))
    rows = rows.select(id, "_n", F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).alias("_c"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_offset:int,end_offset:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        window = F.struct((acc["at"] + c["gap"]).alias("start_offset"), (acc["at"] + c["span"]).alias("end_offset"))
        return F.struct((acc["at"] + c["step"]).alias("at"), F.concat(acc["out"], F.array(window)).alias("out"))

    whole = F.array(F.struct(F.lit(0).alias("start_offset"), F.col("_n").alias("end_offset")))
    found = F.when(F.col("_c").isNull(), whole).otherwise(F.aggregate("_c", begin, step)["out"])
    return rows.select(id, F.posexplode(found).alias("chunk_no", "w")).select(id, "chunk_no", "w.start_offset", "w.end_offset")


def with_chunk_text(docs: DataFrame, windows: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows with their text."""
    both = windows.join(docs.select(id, text), id)
    return both.withColumn("chunk", F.substring(F.col(text), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))).drop(text)


def bounded_windows(text: Column, words: int = 120, overlap: int = 30, chars: int = 450, pattern: str = r"\S+", cost: Callable[[str], int] | None = None, budget: int = 240, blank: int = 600) -> Column:
    """CHUNKS of a text: as many words as fit into both bounds, each window starting `overlap` words before the last one's end.

    A window's start depends on the one before it, so this is an Arrow UDF.
    With `cost` (subword tokens of a string) the bound is `budget` per window
    instead. A first word that is too long stands alone, cut to fit; a text
    without words gives its first `blank` characters.
    """
    import regex

    find = regex.compile(pattern).finditer

    def reach(doc: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word the number of the first word that no longer fits a window from it on."""
        if cost is None:
            return np.minimum(np.arange(len(begin)) + words, np.searchsorted(end, begin + chars, "right"))
        paid = np.cumsum([0, *(cost(doc[a:b]) for a, b in zip(begin, end, strict=True))])
        return np.searchsorted(paid, paid[:-1] + budget, "right") - 1

    def fitted(piece: str) -> str:
        if cost is None:
            return piece[:chars]
        sizes = range(len(piece), 0, -10)
        return piece[: next((n for n in sizes if n <= 10 or cost(piece[:n]) <= budget), 0)]

    def windows_of(doc: str) -> list[tuple[str, int]]:
        spans = np.array([m.span() for m in find(doc)], np.int64).reshape(-1, 2)
        if not len(spans):
            return [(doc[:blank], 0)]
        begin, end = spans.T
        following = np.arange(1, len(spans) + 1)
        stop = np.maximum(reach(doc, begin, end), following)
        onward = np.where(stop < len(spans), np.maximum(stop - overlap, following), -1)
        firsts, at = [], 0
        while at >= 0:
            firsts.append(at)
            at = int(onward[at])
        return [(fitted(doc[a:b]), int(a)) for a, b in zip(begin[firsts], end[stop[firsts] - 1], strict=True)]

    def chunks(texts: pa.Array) -> pa.Array:
        found = [windows_of(doc or "") for doc in texts.to_pylist()]
        sizes = np.cumsum([0, *map(len, found)])
        cells = [pa.array([c[k] for one in found for c in one], t) for k, t in enumerate((pa.string(), pa.int32()))]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(cells, ["text", "start_offset"]))

    @F.arrow_udf(CHUNKS)
    def run(x: pa.Array) -> pa.Array:
        return pa.concat_arrays([chunks(part) for part in in_blocks(x, BLOCK)] or [chunks(x)])

    return run(text)


def rebase(entities: DataFrame, offset: str = "start_offset") -> DataFrame:
    """Entities of chunks (start, end) in document positions; those without both positions go."""
    return entities.dropna(subset=["start", "end"]).withColumns({"start": F.col("start") + F.col(offset), "end": F.col("end") + F.col(offset)})


def prefix(text: Column, chars: int = 8000) -> Column:
    return F.substring(text, 1, chars)
