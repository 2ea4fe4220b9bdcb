"""Entity spans: alignment to the text, cleaning, merging, deduplication, repair.

Entity tables have doc_id, ord (position in the document's list), start, end,
text, type, assertions, candidates. Everything order-dependent goes by ord.
"""

from __future__ import annotations

import difflib
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.text import any_of, is_common_symptom, is_test_name, strip

FIELDS = ["start", "end", "text", "type", "assertions", "candidates"]


# --- alignment ---------------------------------------------------------------


def occurrences(doc: Column, needle: Column) -> Column:
    """Starts of the needle's non-overlapping occurrences in the doc, case ignored."""
    low = F.lower(needle)
    quoted = F.concat(F.lit("\\Q"), F.replace(low, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(F.lower(doc), quoted, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        here = acc["at"] + F.length(piece)
        return F.struct((here + F.length(low)).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    every = F.aggregate(pieces, begin, step)["out"]
    return F.when(low == "", F.array().cast("array<int>")).otherwise(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))))


def nearest(starts: Column, hint: Column) -> Column:
    """The start closest to the hint, the first of equals; null where there is none."""
    return F.array_min(F.transform(starts, lambda s: F.struct(F.abs(s - hint).alias("far"), s.alias("start"))))["start"]


def exact_offset_map(source: str, form: str = "NFC") -> list[int]:
    """For each index of the normalised text (its end included), the index in the source where that character begins."""
    out: list[int] = []
    at = 0
    while at < len(source):
        end = at + 1
        while end < len(source) and unicodedata.combining(source[end]):
            end += 1
        out += [at] * len(unicodedata.normalize(form, source[at:end]))
        at = end
    return [*out, len(source)]


def block_offset_map(source: str, target: str, near: bool = True) -> list[int]:
    """For each index of `source` (its end included) an index of `target` by longest matching blocks.

    An index outside all blocks goes to the nearest block's edge, or to itself
    without `near`.
    """
    found = difflib.SequenceMatcher(None, source, target).get_matching_blocks()

    def one(i: int) -> int:
        inside = next((b + i - a for a, b, n in found if a <= i <= a + n), None)
        if inside is not None or not near:
            return i if inside is None else inside
        edges = [(a - i, k, b) if i < a else (i - a - n, k, b + n) for k, (a, b, n) in enumerate(found)]
        return min(edges)[2]

    return [one(i) for i in range(len(source) + 1)]


def literal_hits(text: str, wanted: set[str]) -> dict[str, list[int]]:
    """Starts of each wanted string's occurrences in the text, from the left and without overlaps, in one pass over the text."""
    out: dict[str, list[int]] = {w: [] for w in wanted if w}
    if out:
        words = ahocorasick.Automaton()
        for w in out:
            words.add_word(w, w)
        words.make_automaton()
        for last, w in words.iter(text):
            at, found = last + 1 - len(w), out[w]
            if not found or at >= found[-1] + len(w):
                found.append(at)
    return out


def _closest(spots: list[int], hint: int) -> int:
    """The spot nearest to the hint, the first of equals."""
    k = bisect_left(spots, hint)
    return min(spots[max(0, k - 1) : k + 1], key=lambda s: abs(s - hint))


def most_similar(text: str, window: str, slack: int = 15, least: float = 0.70) -> tuple[int, int] | None:
    """(start, end) of the slice of `window` most similar to `text` by matching blocks: of equal ones the shortest, then the first.

    Slices are up to `slack` characters shorter or longer than the text and
    score `least` or more. Shared characters bound the similarity; they are
    counted for all slices at once, and slices are compared from the greatest
    bound down until no bound reaches the best score.
    """
    codes = np.frombuffer(window.encode("utf-32-le"), np.uint32)
    chars, own = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
    seen = np.zeros((len(codes) + 1, len(chars)), np.int32)
    np.cumsum(codes[:, None] == chars, axis=0, out=seen[1:])
    sizes, starts, bounds = [], [], []
    for n in range(max(1, len(text) - slack), min(len(codes), len(text) + slack) + 1):
        bound = 2.0 * np.minimum(seen[n:] - seen[:-n], own).sum(1) / (len(text) + n)
        at = np.flatnonzero(bound >= least)
        sizes.append(np.full(len(at), n))
        starts.append(at)
        bounds.append(bound[at])
    if not sizes:
        return None
    size, start, bound = (np.concatenate(x) for x in (sizes, starts, bounds))
    matcher = difflib.SequenceMatcher(None)
    matcher.set_seq1(text)
    best = None
    for k in np.argsort(-bound, kind="stable").tolist():
        if best and bound[k] < -best[0]:
            break
        s, n = int(start[k]), int(size[k])
        matcher.set_seq2(window[s : s + n])
        score = matcher.ratio()
        if score >= least and (best is None or (-score, n, s) < best):
            best = (-score, n, s)
    return (best[2], best[2] + best[1]) if best else None


def places(doc: str, texts: list[str], hints: list[int], fuzzy: bool, compat: bool) -> list[tuple[int, int] | None]:
    """A place for each mention: literal, else by composed form, else (`fuzzy`) the most similar window near the hint.

    The text is searched once for all literal forms and once for all composed
    ones; its offset map is made once, and only if a composed form was found.
    """
    out: list[tuple[int, int] | None] = [None] * len(texts)
    lows = [t.lower() for t in texts]
    hits = literal_hits(doc.lower(), set(lows))
    for k, low in enumerate(lows):
        if spots := hits.get(low):
            at = _closest(spots, hints[k])
            out[k] = (at, at + len(texts[k]))
    rest = [k for k, place in enumerate(out) if place is None]
    if not rest:
        return out
    composed = {k: unicodedata.normalize("NFC", texts[k]) for k in rest}
    hits = literal_hits(unicodedata.normalize("NFC", doc).lower(), {c.lower() for c in composed.values()})
    back: list[int] = []
    for k in rest:
        if spots := hits.get(composed[k].lower()):
            back = back or (block_offset_map(unicodedata.normalize("NFC", doc), doc, near=False) if compat else exact_offset_map(doc))
            at = _closest(spots, hints[k])
            last = len(back) - 1  # some characters grow in lower case
            out[k] = (back[min(at, last)], back[min(at + len(composed[k]), last)])
        elif fuzzy:
            begin = max(0, hints[k] - 80)
            found = most_similar(lows[k], doc[begin : hints[k] + len(texts[k]) + 80].lower())
            out[k] = (begin + found[0], begin + found[1]) if found else None
    return out


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in (("starts", T.IntegerType()), ("ends", T.IntegerType()), ("texts", T.StringType()))]))
def _placed(doc: pd.Series, texts: pd.Series, hints: pd.Series, fuzzy: pd.Series, compat: pd.Series) -> pd.DataFrame:
    rows = []
    for d, t, h, f, c in zip(doc, texts, hints, fuzzy, compat, strict=True):
        found = places(d, list(t), [int(x) for x in h], bool(f), bool(c))
        rows.append(([p and p[0] for p in found], [p and p[1] for p in found], [p and d[p[0] : p[1]] for p in found]))
    return pd.DataFrame(rows, columns=["starts", "ends", "texts"])


#: Characters of text whose mentions are placed together.
PASSAGE = 1 << 16


def closest_position(entities: DataFrame, docs: DataFrame, fuzzy: bool = True, offset_map: str = "exact", id: str = "doc_id") -> DataFrame:
    """Entities placed in their documents: literally (nearest to the old start), by composed form, or by similarity.

    `text` becomes the document's own; entities without a place, without text
    or without a type go, as do those of null and empty documents. A document
    meets its entities once for each passage that they say to be in, so its
    text doesn't travel with every entity. Repeated entities stay repeated.
    offset_map: "exact", or "compat" for the map by matching blocks.
    """
    rows = entities.withColumns({"text": strip(F.col("text")), "type": strip(F.col("type"))}).where("text <> '' and type <> ''")
    both = packed(rows.select(*entities.columns), docs.where("text <> ''"), id)
    texts = F.transform("mention", lambda m: m["text"])
    hints = F.transform("mention", lambda m: F.coalesce(m["start"], F.lit(0)))
    found = both.select("mention", _placed("doc", texts, hints, F.lit(fuzzy), F.lit(offset_map == "compat")).alias("place"))
    found = found.select("mention", "place.starts", "place.ends", "place.texts")
    each = found.select(F.explode(F.arrays_zip("mention", "starts", "ends", "texts")).alias("x")).where("x.starts is not null")
    new = {"start": "x.starts", "end": "x.ends", "text": "x.texts"}
    return each.select(*(F.col(new.get(c, f"x.mention.`{c}`")).alias(c) for c in entities.columns))


def packed(entities: DataFrame, docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """(key, doc, mention): documents with the list of their entities, for each passage that these say to be in; documents without any go.

    Entities are dealt by document once, and its text stands beside lists, not
    beside every entity.
    """
    passage = F.floor(F.coalesce(F.col("start"), F.lit(0)) / PASSAGE)
    lists = entities.repartition(F.col(id)).groupBy(F.col(id).alias("key"), passage.alias("passage")).agg(F.collect_list(F.struct(*entities.columns)).alias("mention"))
    # Texts never go through the driver, however small Spark takes them to be.
    return lists.join(docs.select(F.col(id).alias("key"), F.col("text").alias("doc")).hint("merge"), "key").drop("passage")


def _slice(doc: str, start: int | None, end: int | None) -> str | None:
    """What Spark's substring gives for the span: a negative start counts from the end, but for -1."""
    if start is None or end is None:
        return None
    size = max(end - start, 0)
    if start < -1:
        start += 1 + len(doc)
    elif start == -1:
        start = 0
    return doc[max(start, 0) : max(start + size, 0)]


def _spots(low: str, wanted: set[str], first: bool) -> dict[str, list[int]]:
    """`literal_hits`, or with `first` the first of each; few strings in a short text are looked for one by one."""
    if len(wanted) * len(low) > 1 << 22:
        return literal_hits(low, wanted) | ({"": [0]} if first else {})
    out = {}
    for w in wanted:
        out[w], at = [], low.find(w) if w or first else -1
        while at >= 0:
            out[w].append(at)
            at = -1 if first else low.find(w, at + len(w))
    return out


_LOOKED = T.ArrayType(T.StructType([T.StructField("here", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("moved", T.StringType())]))


def _lists(*columns: pa.Array) -> Iterator[list[list]]:
    """The rows of list columns, one at a time as Python lists; null lists are empty."""
    for i in range(len(columns[0])):
        yield [c[i].as_py() or [] for c in columns]


def _nested(rows: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.Array:
    """Lists of tuples as lists of structs."""
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(kinds)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds)))


@F.arrow_udf(_LOOKED)
def _looked(doc: pa.Array, low: pa.Array, texts: pa.Array, lows: pa.Array, starts: pa.Array, ends: pa.Array, mode: pa.Array) -> pa.Array:
    """For each mention its document's slice and, where that isn't its text, the text's nearest place (mode "near") or first one ("first")."""
    out = []
    for d, l, m, (t, w, s, e) in zip(doc, low, mode, _lists(texts, lows, starts, ends), strict=True):
        d, l, m = d.as_py(), l.as_py(), m.as_py()
        if d is None:
            out.append([(None, None, None)] * len(t))
            continue
        here = [_slice(d, x, y) for x, y in zip(s, e, strict=True)]
        row = [(h, None, None) for h in here]
        if m != "slice":
            rest = [k for k, h in enumerate(here) if w[k] is not None and (h != t[k] or not 0 <= s[k] < e[k] <= len(d))]
            hits = _spots(l, {w[k] for k in rest}, m == "first")
            for k in rest:
                if found := hits.get(w[k]):
                    at = found[0] if m == "first" or s[k] is None else _closest(found, s[k])
                    row[k] = (here[k], at, d[at : at + len(t[k])])
        out.append(row)
    return _nested(out, {"here": pa.string(), "at": pa.int32(), "moved": pa.string()})


def looked(entities: DataFrame, docs: DataFrame, mode: str, id: str = "doc_id") -> DataFrame:
    """Entities with _here, their document's slice, and with mode "near" or "first" _at and _moved, where their text is (case ignored) and how it is written there; null if it is nowhere or in _here already."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    texts, starts, ends = F.col("mention.text"), F.col("mention.start").cast("array<bigint>"), F.col("mention.end").cast("array<bigint>")
    whole = F.lower("doc") if mode != "slice" else F.lit(None).cast("string")
    lows = low(texts) if mode != "slice" else texts
    rows = packed(entities, docs, id).select("mention", _looked("doc", whole, texts, lows, starts, ends, F.lit(mode)).alias("found"))
    each = rows.select(F.explode(F.arrays_zip("mention", "found")).alias("x"))
    return each.select(*(F.col(f"x.mention.`{c}`").alias(c) for c in entities.columns), *(F.col(f"x.found.{c}").alias(f"_{c}") for c in ("here", "at", "moved")))


def check_then_search(entities: DataFrame, docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """Entities whose place holds their text (case and outer space ignored) stay; others move to the nearest hit or go."""
    rows = looked(entities.withColumn("text", strip(F.col("text"))).where("text <> ''"), docs, "near", id)
    rows = rows.withColumn("_here", strip(F.col("_here")))
    rows = rows.withColumn("_holds", F.coalesce(F.lower("_here") == F.lower("text"), F.lit(False))).where("_holds or _at is not null")
    return rows.select(
        *(c for c in entities.columns if c not in ("start", "end", "text")),
        F.when(F.col("_holds"), F.col("start")).otherwise(F.col("_at")).alias("start"),
        F.when(F.col("_holds"), F.col("end")).otherwise(F.col("_at") + F.length("text")).alias("end"),
        F.when(F.col("_holds"), F.col("_here")).otherwise(F.col("_moved")).alias("text"),
    )


def first_hit(entities: DataFrame, docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """Entities that don't hold their text move to its first occurrence (an empty one to the begin); without one they keep their place."""
    rows = looked(entities, docs, "first", id)
    good = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.length("_here") == F.col("end") - F.col("start")) & (F.lower("_here") == F.lower("text"))
    at = F.col("_at")
    move = ~F.coalesce(good, F.lit(False)) & at.isNotNull()
    return rows.withColumns({"start": F.when(move, at).otherwise(F.col("start")), "end": F.when(move, at + F.length("text")).otherwise(F.col("end"))}).select(*entities.columns)


def misaligned(entities: DataFrame, docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """Each entity with `bad`: whether its document's slice differs from its text."""
    return looked(entities, docs, "slice", id).withColumn("bad", ~F.col("_here").eqNullSafe(F.col("text"))).drop("_here", "_at", "_moved")


# --- cleaning ------------------------------------------------------------------


def _class(chars: str) -> str:
    return "".join("\\" + c for c in chars)


def clean(entities: DataFrame, docs: DataFrame, ensemble: bool = False, single_words: str = "strict", id: str = "doc_id") -> DataFrame:
    """Entities with trimmed edges, corrected types and without implausible ones.

    Marks and space at both ends go; grammatical prefixes go (a start moves by
    the prefixes' own length); then, but for `ensemble`, date suffixes are cut,
    test names get their type and drugs lose dose suffixes; common symptoms
    get theirs. Not for `ensemble`: texts of one character, bare numbers (but
    for results), blacklisted words, single words outside the type's list
    (with single_words="keep" none), and texts over 50 characters or 8 words go.
    """
    kept = [c for c in entities.columns if c not in ("start", "end", "text", "type")]

    def settle(df: DataFrame, **new: Column) -> DataFrame:
        """The four columns as one generated row: later filters don't get all of the expressions before them."""
        columns = [new.get(c, F.col(c)).alias(c) for c in ("start", "end", "text", "type")]
        return df.select(*(F.col(c) for c in kept), F.inline(F.array(F.struct(*columns))))

    rows = settle(looked(entities, docs, "slice", id), text=F.col("_here"))
    edge = f"(?U)[\\s{_class(L.EDGE_MARKS)}]+"
    lead, tail = F.regexp_extract("text", f"^{edge}", 0), F.regexp_extract("text", f"{edge}$", 0)
    bare = F.regexp_replace("text", f"^{edge}|{edge}$", "")
    rows = settle(rows, start=F.col("start") + F.length(lead), end=F.col("end") - F.length(tail), text=bare).where("text <> ''")
    prefixes = "|".join(L.both_forms(L.PREFIXES_ENSEMBLE if ensemble else L.PREFIXES))
    led = F.regexp_extract(F.lower("text"), f"(?U)^(?:(?:{prefixes})\\s*)+", 0)
    moved = F.length(F.regexp_replace(led, r"(?U)(\s)\s+", "$1"))
    rows = settle(rows, start=F.col("start") + moved, text=strip(F.substring("text", F.length(led) + 1, F.length("text"))))
    if not ensemble:
        # The first place where a suffix begins; everything from there on goes.
        dated = F.length(F.regexp_extract(F.lower("text"), f"(?U)(?:{'|'.join(L.DATE_SUFFIXES)})(?s:.*)$", 0))
        rows = settle(rows, end=F.col("end") - dated, text=strip(F.substring("text", F.lit(1), F.length("text") - dated)))
        rows = settle(rows, type=F.when(is_common_symptom(F.col("text")), L.SYMPTOM).when(is_test_name(F.col("text")), L.TEST).otherwise(F.col("type")))
        units = "|".join(L.both_forms(L.DOSE_UNITS))
        dose = F.length(F.regexp_extract("text", f"(?iU)(?:(?:^|\\s+)(?:{units}|x\\s+\\d+))+$", 0))
        dose = F.when(F.col("type") == L.DRUG, dose).otherwise(0)
        rows = settle(rows, end=F.col("end") - dose, text=strip(F.substring("text", F.lit(1), F.length("text") - dose)))
        words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
        low = F.lower("text")
        listed = F.when(F.col("type") == L.DIAGNOSIS, low.isin(*L.both_forms(L.SINGLE_DIAGNOSES))).when(F.col("type") == L.SYMPTOM, low.isin(*L.both_forms(L.SINGLE_SYMPTOMS)))
        listed = listed.otherwise(low.isin(*L.both_forms(L.SINGLE_OTHERS)))
        fine = (F.length("text") > 1) & ((F.col("type") == L.RESULT) | ~F.col("text").rlike(r"(?U)^\d+$")) & ~low.isin(*L.ENTITY_BLACKLIST)
        fine &= (F.length("text") <= 50) & (words <= 8)
        if single_words == "strict":
            fine &= (words > 1) | listed
        rows = rows.where(fine)
    else:
        rows = settle(rows, type=F.when(is_common_symptom(F.col("text")), L.SYMPTOM).otherwise(F.col("type")))
    return rows.where("text <> ''").select(*entities.columns)


# --- merging ---------------------------------------------------------------------


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over union of two spans, 0 without overlap."""
    inter = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    union = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(inter > 0, inter / union).otherwise(F.lit(0.0))


def with_lists(entities: DataFrame) -> DataFrame:
    """Entities with empty lists where an annotator gives no assertions or candidates."""
    for c in ("assertions", "candidates"):
        if c not in entities.columns:
            entities = entities.withColumn(c, F.array().cast("array<string>"))
    return entities


#: Characters of a stretch in which overlapping spans are looked for.
STRETCH = 64


def greedy(a: list[list], b: list[list], least: float) -> tuple[list[int | None], list[int]]:
    """For each span (start, end, type) of a, in order, the free one of b of its type with the largest IoU of at least `least`, the first of equals; and those of b that stay free.

    Spans are filed by stretch, so the work follows the overlaps there are.
    """
    filed: dict[tuple, list[int]] = {}
    for y, (start, end, kind) in enumerate(b):
        if None not in (start, end, kind) and end > start:
            for k in range(start // STRETCH, (end - 1) // STRETCH + 1):
                filed.setdefault((kind, k), []).append(y)
    used, out = set(), []
    for start, end, kind in a:
        best, top = None, least
        if None not in (start, end, kind) and end > start:
            for k in range(start // STRETCH, (end - 1) // STRETCH + 1):
                for y in filed.get((kind, k), ()):
                    s, e, _ = b[y]
                    inter = min(end, e) - max(start, s)
                    if inter > 0 and y not in used:
                        share = inter / (max(end, e) - min(start, s))
                        if share > top or (share == top and (best is None or y < best)):
                            best, top = y, share
        out.append(best)
        if best is not None:
            used.add(best)
    return out, [y for y in range(len(b)) if y not in used]


_PAIRS = T.StructType([T.StructField("partner", T.ArrayType(T.IntegerType())), T.StructField("free", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(_PAIRS)
def _greedy(a0: pa.Array, a1: pa.Array, a2: pa.Array, b0: pa.Array, b1: pa.Array, b2: pa.Array, least: pa.Array) -> pa.Array:
    out = []
    for x, y, share in zip(_lists(a0, a1, a2), _lists(b0, b1, b2), least, strict=True):
        out.append(greedy(list(zip(*x, strict=True)), list(zip(*y, strict=True)), share.as_py()))
    kind = pa.list_(pa.int32())
    return pa.StructArray.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], kind)], ["partner", "free"])


def paired(a: DataFrame, b: DataFrame, least: float, id: str = "doc_id") -> DataFrame:
    """(doc_id, x, y, a, b): entities of both lists, paired as `greedy` says; unpaired ones with a null on the other side.

    x and y are the entities' numbers in their document's list (by ord, then
    place, text and type). Each side is dealt by document once and meets the
    other as lists.
    """

    def lists(df: DataFrame, name: str) -> DataFrame:
        none = F.array().cast("array<string>")
        one = F.struct("ord", "start", "end", "text", "type", *(F.coalesce(c, none).alias(c) for c in ("assertions", "candidates")))
        return with_lists(df).repartition(F.col(id)).groupBy(id).agg(F.array_sort(F.collect_list(one)).alias(name))

    return paired_lists(lists(a, "_a").join(lists(b, "_b"), id, "full"), least, id)


def paired_lists(both: DataFrame, least: float, id: str = "doc_id") -> DataFrame:
    """`paired` of documents (doc_id, _a, _b) with the sorted lists of their entities; nothing is shuffled. Without an id none pair up."""
    met, every = _met(both, least, id)
    return met.select(id, F.explode(every).alias("r")).select(id, "r.x", "r.y", "r.a", "r.b")


def _met(both: DataFrame, least: float, id: str) -> tuple[DataFrame, Column]:
    """Documents, and the list of structs (x, y, a, b) that `paired_lists` explodes."""
    share = F.when(F.col(id).isNotNull(), F.lit(float(least))).otherwise(2.0)
    spot = lambda side: [F.col(f"{side}.{c}").cast(t) for c, t in (("start", "array<bigint>"), ("end", "array<bigint>"), ("type", "array<string>"))]
    met = both.select(id, "_a", "_b", _greedy(*spot("_a"), *spot("_b"), share).alias("m")).select(id, "_a", "_b", "m.partner", "m.free")
    left = F.transform(F.arrays_zip("_a", "partner"), lambda p, i: F.struct(i.alias("x"), p["partner"].alias("y"), p["_a"].alias("a"), F.get(F.col("_b"), p["partner"]).alias("b")))
    alone = F.transform("free", lambda y: F.struct(F.lit(None).cast("int").alias("x"), y.alias("y"), F.get(F.col("_a"), F.lit(None).cast("int")).alias("a"), F.get(F.col("_b"), y).alias("b")))
    every = F.when(F.col("_a").isNull(), alone).otherwise(F.concat(left, alone))
    return met, every


def merge(a: DataFrame, b: DataFrame, least: float = 0.5, reset_b: bool = False, id: str = "doc_id") -> DataFrame:
    """Two annotators' entities as one list: (doc_id, ord, FIELDS, origin).

    Entities pair up as `paired` says; a pair has b's span and text, a's
    assertions and candidates. Then come a's unmatched entities, then b's (with
    `reset_b` without assertions and candidates); the list is sorted by start,
    ties in that order.
    """
    return _merged(paired(a, b, least, id), reset_b, id)


def merge_lists(both: DataFrame, least: float = 0.5, reset_b: bool = False, id: str = "doc_id") -> DataFrame:
    """`merge` of documents (doc_id, _a, _b) with the sorted lists of their entities; they are put in order there, and nothing is shuffled."""
    met, every = _met(both, least, id)
    rows = F.array_sort(F.transform(every, lambda r: F.struct(*_fields(r.getItem, reset_b))))
    return met.select(id, F.posexplode(rows).alias("ord", "r")).select(id, F.col("ord").cast("long").alias("ord"), *(f"r.{c}" for c in FIELDS), "r.origin")


def _fields(r: Callable[[str], Column], reset_b: bool) -> list[Column]:
    """A merged entity of a pair (x, y, a, b), its order (start, _phase, _rank) first."""
    none, a, b = F.array().cast("array<string>"), r("a"), r("b")
    pair, only_a = a.isNotNull() & b.isNotNull(), b.isNull()

    def field(c: str) -> Column:
        if c in ("assertions", "candidates"):
            return F.when(a.isNotNull(), a[c]).otherwise(none if reset_b else b[c])
        return F.when(only_a, a[c]).otherwise(b[c])

    return [
        field("start").alias("start"), F.when(pair, 0).when(only_a, 1).otherwise(2).alias("_phase"), F.coalesce(r("x"), r("y")).alias("_rank"),
        *(field(c).alias(c) for c in FIELDS[1:]), F.when(pair, "both").when(only_a, "a").otherwise("b").alias("origin"),
    ]


def _merged(both: DataFrame, reset_b: bool, id: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(id).orderBy("start", "_phase", "_rank")).cast("long") - 1
    return both.select(id, *_fields(F.col, reset_b)).select(id, order.alias("ord"), *FIELDS, "origin")


def dedup_by_priority(entities: DataFrame, id: str = "doc_id") -> DataFrame:
    """One entity for each (start, end): the type of highest priority, then most candidates, then the first.

    The result is ordered by start, ties by where the span first occurred.
    """
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in L.TYPE_PRIORITY.items() for v in kv)), F.col("type")), F.lit(0))
    span = Window.partitionBy(id, "start", "end")
    best = span.orderBy(rank.desc(), F.size(F.coalesce("candidates", F.array().cast("array<string>"))).desc(), "ord")
    rows = entities.withColumn("_n", F.row_number().over(best)).withColumn("_first", F.min("ord").over(span)).where("_n = 1")
    again = F.row_number().over(Window.partitionBy(id).orderBy("start", "_first")) - 1
    return rows.withColumn("ord", again.cast("long")).drop("_n", "_first")


def dedup_by_text(entities: DataFrame, id: str = "doc_id") -> DataFrame:
    """The first entity for each (start, text)."""
    first = Window.partitionBy(id, "start", "text").orderBy("ord")
    return entities.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def coalesce_adjacent(entities: DataFrame, docs: DataFrame, gap: int = 3, longest: int = 50, id: str = "doc_id") -> DataFrame:
    """Neighbours of one type joined: at most `gap` characters apart, no line end between, no longer than `longest` together.

    The joined span runs from the first start to the next end. Whether a join
    is short enough depends on the joins before it, so each document's sorted
    spans are folded.
    """
    one = F.struct("start", "ord", "end", "type")
    lists = entities.repartition(F.col(id)).groupBy(id).agg(F.array_sort(F.collect_list(one)).alias("es")).join(docs.select(id, F.col("text").alias("_doc")), id)
    spots = [F.col(f"es.{c}").cast("array<bigint>") for c in ("start", "end")]
    out = lists.select(id, F.posexplode(_folded("_doc", *spots, F.col("es.type"), F.lit(gap), F.lit(longest))).alias("ord", "e"))
    return out.select(id, F.col("ord").cast("long"), "e.start", "e.end", "e.text", "e.type")


_FOLDED = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("start", T.LongType()), ("end", T.LongType()), ("text", T.StringType()), ("type", T.StringType()))]))


@F.arrow_udf(_FOLDED)
def _folded(doc: pa.Array, starts: pa.Array, ends: pa.Array, types: pa.Array, gap: pa.Array, longest: pa.Array) -> pa.Array:
    out = []
    for d, g, most, (s, e, k) in zip(doc, gap, longest, _lists(starts, ends, types), strict=True):
        d, g, most, spans = d.as_py(), g.as_py(), most.as_py(), []
        for start, end, kind in zip(s, e, k, strict=True):
            last = spans[-1] if spans else None
            known = last and None not in (*last, start, end, kind, d)
            if known and last[2] == kind and start - last[1] <= g and end - last[0] <= most and "\n" not in _slice(d, last[1], start):
                last[1] = end
            else:
                spans.append([start, end, kind])
        out.append([(a, b, None if d is None else _slice(d, a, b), k) for a, b, k in spans])
    return _nested(out, {"start": pa.int64(), "end": pa.int64(), "text": pa.string(), "type": pa.string()})


def restore_symptoms(entities: DataFrame) -> DataFrame:
    """Diagnoses that contain a symptom's name, or are part of one, become symptoms without codes."""
    low = F.lower(strip(F.col("text")))
    hit = any_of(F.contains(low, F.lit(s)) | F.contains(F.lit(s), low) for s in L.RESTORED_SYMPTOMS)
    change = hit & (F.col("type") == L.DIAGNOSIS) & ~low.isin(*L.KEPT_DIAGNOSES)
    return entities.withColumn("restored", change).withColumns(
        {"type": F.when(change, L.SYMPTOM).otherwise(F.col("type")), "candidates": F.when(change, F.array().cast("array<string>")).otherwise(F.col("candidates"))}
    )


def version_diff(old: DataFrame, new: DataFrame, id: str = "doc_id") -> DataFrame:
    """(doc_id, text, type, change): entities that are new, missing or modified (candidates or place); the last of equal keys counts."""
    # Both are dealt out by document, and what follows stays there.
    sides = [df.select(id, "ord", "start", "end", "text", "type", "candidates", F.lit(k).alias("side")).repartition(F.col(id)) for k, df in enumerate((old, new))]
    return changes(sides[0].union(sides[1]), id)


def changes(sides: DataFrame, id: str = "doc_id") -> DataFrame:
    """`version_diff` of the entities of both versions in one table, with side 0 (old) or 1 (new); nothing is shuffled if it is dealt out by document."""
    last = lambda k: F.max(F.when(F.col("side") == k, F.struct("ord", F.struct("start", "end", "candidates").alias("e"))))
    # A null is equal to no other.
    unlike = F.when(F.col(id).isNull() | F.col("text").isNull() | F.col("type").isNull(), F.col("side"))
    both = sides.withColumn("_unlike", unlike).groupBy(id, "text", "type", "_unlike").agg(last(0).alias("old"), last(1).alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(~F.col("old.e").eqNullSafe(F.col("new.e")), "modified")
    return both.select(id, "text", "type", change.alias("change")).where("change is not null")
