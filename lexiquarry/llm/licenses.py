"""Licence paragraphs: a trained classifier, confirmed by template comparison.

A paragraph is a line of words, or a run of lines that wrap: a line that
ends without a full stop goes on with the next. Both are classified by a
sparse logistic regression over hashed word n-grams, trained on pieces and
variants of the templates against a bounded sample of the corpus' own lines;
its temperature is fitted on held-out variants. The unknown class is
calibrated on families left out: models that lack a third of the families
meet their texts. How probable any licence is for those, against plain lines,
gives the bound from which a paragraph is a licence; how probable and how like
its templates a known family's text is, against those, gives the probability
that a paragraph's best family is its family at all.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._fit import drawn, logistic, sigmoid, sparse_logistic
from ._kernel import ALNUM, U, Words, blocks, buffers, byte_class, mix, windows

BITS = 16
#: Likeness from which a line at the edge of a wrapped paragraph belongs to it.
LINE_ALIKE = 0.2
NONE = "none"
UNKNOWN = "unknown"
#: Wording that public licences and their usual notices use, by family.
TEMPLATES = {
    "MIT": [
        "MIT License",
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "GNU General Public License Version 3",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License.",
    ],
    "BSD": [
        "BSD 3-Clause License",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal Public Domain Dedication.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Short names that tags and headers give.
NAMES = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL": ["GPL-3.0", "GPLv3", "GPLv2", "GPL"], "LGPL": ["LGPL-2.1", "LGPLv3", "LGPL"], "AGPL": ["AGPL-3.0", "AGPLv3", "AGPL"], "BSD": ["BSD-3-Clause", "BSD-2-Clause", "BSD"],
    "MPL": ["MPL-2.0", "MPL"], "CC-BY": ["CC-BY-4.0", "CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC0": ["CC0-1.0", "CC0"], "proprietary": ["Proprietary"],
}
TAGS = {f: [t for n in names for t in (f"SPDX-License-Identifier: {n}", f"License: {n}")] for f, names in NAMES.items()}
WORDING = {f: [*ts, *TAGS[f]] for f, ts in TEMPLATES.items()}
FAMILIES = [NONE, *TEMPLATES]
#: Words that tell nothing about a licence when they stand together.
_PLAIN = set("the of and to in a is that for it as this be by with without or not an on any all are at under you may which from its their no".split())

_NOTICE = re.compile("licen[cs]e|spdx", re.IGNORECASE)


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*buffers(pa.array([t.lower() for t in texts], pa.string())), ALNUM)
    return words.hashes(), words.bounds


def _grams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, paragraph) of the distinct 1- to 3-grams of each paragraph."""
    found, rows = [], []
    for size in (1, 2, 3):
        g, b = windows(h, bounds, size, short=False)
        found.append((mix(g + U(size)) >> U(64 - BITS)).astype(np.int64))
        rows.append(np.repeat(np.arange(len(bounds) - 1), np.diff(b)))
    key = np.unique((np.concatenate(rows) << BITS) | np.concatenate(found))
    return key & ((1 << BITS) - 1), key >> BITS


@dataclass
class Model:
    weights: np.ndarray  # (buckets, families)
    constant: np.ndarray
    temperature: float
    pairs: list[np.ndarray]  # sorted hashes of each family's word pairs
    known: np.ndarray  # sorted hashes of the word pairs of all families
    weight: np.ndarray  # of these: one over the number of families that have the pair
    notice: float = 0.5  # probability of any licence from which a paragraph is one
    calibration: tuple[float, ...] = (0.0, 12.0, -6.0)  # of a known family: by the best family's probability, by likeness, and one

    def probabilities(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        bucket, row = _grams(h, bounds)
        n = len(bounds) - 1
        size = np.maximum(np.bincount(row, minlength=n), 1)
        z = np.column_stack([np.bincount(row, self.weights[bucket, j], n) for j in range(len(FAMILIES))]) / np.sqrt(size)[:, None] + self.constant
        z = z / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def alike_to(self, own: np.ndarray, family: int) -> float:
        """The share of the pairs `own` that the family has; a pair that no family has weighs one."""
        if not len(own):
            return 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        weight = np.where(self.known[at] == own, self.weight[at], 1.0)
        return float(weight[np.isin(own, self.pairs[family])].sum() / weight.sum())


    def licence(self, texts: list[str]) -> np.ndarray:
        """The probability that a text is of any licence."""
        return 1 - self.probabilities(*_hashes(texts))[:, 0]

    def known_family(self, probability: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """The probability that the best family is the paragraph's own."""
        a, b, c = self.calibration
        return sigmoid(a * np.asarray(probability) + b * np.asarray(alike) + c)


def _pairs(h: np.ndarray, bounds: np.ndarray, numeric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by paragraph) of the word pairs without a number: versions tell no family."""
    g, b = windows(h, bounds, 2, short=False)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(b))
    first = bounds[row] + np.arange(len(g)) - b[row]
    keep = ~(numeric[first] | numeric[np.minimum(first + 1, len(numeric) - 1)]) if len(g) else np.zeros(0, bool)
    return g[keep], np.searchsorted(row[keep], np.arange(len(bounds)))


def _numeric(words: Words) -> np.ndarray:
    """Whether a word starts with a digit."""
    first = words.data[words.starts]
    return (first >= 0x30) & (first <= 0x39)


def _pairs_of(texts: list[str]) -> np.ndarray:
    words = Words(*buffers(pa.array([t.lower() for t in texts], pa.string())), ALNUM)
    return np.unique(_pairs(words.hashes(), words.bounds, _numeric(words))[0])


def _variants(text: str, rng: random.Random) -> str:
    """A piece of a template with some words lost and other words around."""
    words = text.split()
    if len(words) > 8 and rng.random() < 0.5:
        n = rng.randint(8, len(words))
        at = rng.randint(0, len(words) - n)
        words = words[at : at + n]
    words = [w for w in words if rng.random() > 0.05] or words
    if rng.random() < 0.3:
        words = [f"{rng.choice(['Copyright', 'Code', 'Data', 'Text', 'Notice:'])}", *words]
    return " ".join(words)


def _telling(texts: list[str]) -> np.ndarray:
    out = []
    for t in texts:
        words = re.findall(r"[^\W_]+", t.lower())
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not (a in _PLAIN and b in _PLAIN)]
        if pairs:
            h, b = _hashes(pairs)
            out.append(windows(h, b, 2, short=False)[0])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def _fit(examples: list[tuple[str, str]], families: set[str], steps: int = 60) -> tuple[Model, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(model of four fifths of the examples of these families, hashes and bounds of all examples, labels, first held-out example)."""
    own = [x for x in examples if x[0] == NONE or x[0] in families]
    cut = len(own) * 4 // 5
    y = np.zeros((len(own), len(FAMILIES)))
    y[np.arange(len(own)), [FAMILIES.index(f) for f, _ in own]] = 1
    h, b = _hashes([x for _, x in own])
    bucket, row = _grams(h, b)
    size = np.maximum(np.bincount(row, minlength=len(own)), 1)
    fit = row < cut
    w, c = sparse_logistic(row[fit], bucket[fit], 1 / np.sqrt(size[row[fit]]), y[:cut], 1 << BITS, ridge=1.0, steps=steps, rate=0.3)
    c[[i for i, f in enumerate(FAMILIES) if f != NONE and f not in families]] = -50.0
    pairs = [_pairs_of(ts) if f in families else np.zeros(0, U) for f, ts in WORDING.items()]
    known, times = np.unique(np.concatenate(pairs), return_counts=True)
    return Model(w, c, 1.0, [np.zeros(0, U), *pairs], known, 1 / times), h, b, y, cut


def _judged(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(probability, likeness) of the best family of each text."""
    words = Words(*buffers(pa.array([t.lower() for t in texts], pa.string())), ALNUM)
    h = words.hashes()
    p = m.probabilities(h, words.bounds)
    best = p[:, 1:].argmax(1) + 1
    g, b = _pairs(h, words.bounds, _numeric(words))
    return p[np.arange(len(texts)), best], np.array([m.alike_to(np.unique(g[b[i] : b[i + 1]]), int(best[i])) for i in range(len(texts))])


def _lines_of(docs: DataFrame, bound: int, id: str, text: str) -> list[str]:
    """About 5 * `bound` lines of about `bound` documents, both drawn by hashes; a line of over 400 characters counts as several."""
    some = docs.where(drawn(id, docs.count(), bound, 41)).select(F.explode(F.split(text, "\n")).alias("line"))
    some = some.select(F.explode(F.regexp_extract_all("line", F.lit("(?s).{1,400}"), F.lit(0))).alias("line")).where("trim(line) <> ''")
    rows = some.orderBy(F.xxhash64("line"), "line").limit(5 * bound)
    return [r["line"] for r in rows.collect()]


def train(docs: DataFrame, bound: int = 400, variants: int = 60, seed: int = 5, id: str = "doc_id", text: str = "text") -> Model:
    """Learn from variants of the templates and the lines of about `bound` documents drawn by a hash of their id.

    Drawn lines that share three telling pairs with a template, or half of
    their own, or one and speak of a licence, are not taken as examples of no
    licence. Rows with a
    null id or text teach nothing; an empty table leaves the templates and
    plain words.
    """
    rng = random.Random(seed)
    telling = _telling([t for ts in WORDING.values() for t in ts])
    lines = _lines_of(docs, bound, id, text)
    examples = [(f, _variants(t, rng)) for f, ts in TEMPLATES.items() for t in ts for _ in range(variants)]
    examples += [(f, _variants(t, rng)) for f, ts in TAGS.items() for t in ts for _ in range(variants // 6)]
    examples += [(f, t) for f, ts in WORDING.items() for t in ts]
    if lines:
        h, b = _hashes(lines)
        g, gb = windows(h, b, 2, short=False)
        hits = np.add.reduceat(np.append(np.isin(g, telling), False).astype(int), gb[:-1]) * (np.diff(gb) > 0)
        examples += [(NONE, x) for x, n, own in zip(lines, hits.tolist(), np.diff(gb).tolist(), strict=True) if n < 3 and not (n and (2 * n >= own or _NOTICE.search(x)))]
    examples += [(NONE, " ".join(rng.sample(sorted(_PLAIN), 8))) for _ in range(200)]
    rng.shuffle(examples)
    m, h, b, y, cut = _fit(examples, set(TEMPLATES))
    logits = np.log(np.maximum(m.probabilities(h, b)[cut:], 1e-12))

    def held_loss(temperature: float) -> float:
        z = logits / temperature
        z = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
        return -float((z * y[cut:]).sum())

    m.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=held_loss)
    few = examples[:: max(1, len(examples) // 2500)]
    told, known, unseen = [], [], []
    for k in range(3):
        left_out = set(list(TEMPLATES)[k::3])
        part, *_ = _fit(few, set(TEMPLATES) - left_out, steps=40)
        part.temperature = m.temperature
        fresh = [(f, _variants(t, rng)) for f, ts in TEMPLATES.items() for t in ts for _ in range(5)]
        told.append(np.column_stack(_judged(part, [t for _, t in fresh])))
        known.append(np.array([f not in left_out for f, _ in fresh], float))
        unseen.append(part.licence([t for f, t in fresh if f in left_out]))
    y = np.concatenate(known)  # of a family that the model has
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m.calibration = tuple(logistic(np.concatenate(told), y, ridge=1.0, weight=balance).tolist())
    plain = np.quantile(m.licence([t for f, t in examples[cut:] if f == NONE]), 0.999)
    m.notice = float(np.clip(np.sqrt(plain * np.quantile(np.concatenate(unseen), 0.1)), 0.05, 0.5))
    return m


FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("paragraph", T.LongType()),
            T.StructField("lines", T.LongType()),
            T.StructField("family", T.StringType()),
            T.StructField("probability", T.DoubleType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("text", T.StringType()),
        ]
    )
)
_FOUND = pa.list_(pa.struct([("paragraph", pa.int64()), ("lines", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("text", pa.string())]))
_LINE_END = byte_class((0x0A, 0x0A))
_FULL_STOP = byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))


def _wrapped(data: np.ndarray, words: Words, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of runs of two lines or more: all have words, and none but the last has a stop after its last word."""
    has = np.diff(words.bounds) > 0
    stops = np.concatenate([[0], np.cumsum(_FULL_STOP[data])])
    last = np.maximum(words.bounds[1:] - 1, 0)
    goes_on = np.zeros(len(has), bool)
    if len(words.ends):
        goes_on = has & (stops[words.offsets[1:]] == stops[words.ends[np.minimum(last, len(words.ends) - 1)]])
    joins = np.zeros(len(has), bool)  # with the line before
    joins[1:] = goes_on[:-1] & has[1:] & (doc[1:] == doc[:-1])
    edge = np.diff(np.concatenate([[0], joins.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)


def _taken(bounds: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds) of runs of lines, put in a row."""
    n = bounds[after] - bounds[first]
    ends = np.cumsum(n)
    return np.repeat(bounds[first] - (ends - n), n) + np.arange(n.sum()), np.concatenate([[0], ends]).astype(np.int64)


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `licenses`: the licence paragraphs of each text in order.

    A hit names its first line (from 0) and its number of lines. Wrapped lines
    that together are of a known family are one hit, from the first to the last
    of them that is like its templates; else each line of some licence is a
    hit, and wrapped lines are one of unknown licence if only together they
    are. A single word tells no licence. Null, empty and wordless texts
    have none; long ones are scanned whole. Repeated rows are scanned each; a
    column named licenses is replaced, all others kept.
    """
    kept = [c for c in docs.columns if c != "licenses"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def units(words: Words, h: np.ndarray, bounds: np.ndarray, numeric: np.ndarray, m: Model) -> list[tuple[int, str, float, float]]:
        """(unit, family, probability, likeness) of the units that are a licence."""
        p = m.probabilities(h, bounds)
        pg, pb = _pairs(h, bounds, numeric)
        out = []
        for i in np.flatnonzero((np.diff(bounds) > 1) & (p[:, 0] < 1 - m.notice)).tolist():
            best = int(p[i, 1:].argmax()) + 1
            alike = m.alike_to(np.unique(pg[pb[i] : pb[i + 1]]), best)
            out.append((i, FAMILIES[best] if m.known_family(p[i, best], alike) >= 0.5 else UNKNOWN, float(p[i, best]), alike))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in blocks(batch, text):
                data, offsets = buffers(pc.utf8_lower(pc.fill_null(part.column(text), "")))
                starts = np.unique(np.concatenate([offsets, np.flatnonzero(_LINE_END[data]) + 1]))
                words = Words(data, starts, ALNUM)
                doc = np.searchsorted(offsets, starts[:-1], "right") - 1
                ends = np.concatenate([[0], np.cumsum(_LINE_END[data])])
                number = ends[starts[:-1]] - ends[offsets[doc]]
                h, numeric = words.hashes(), _numeric(words)
                first, after = _wrapped(data, words, doc)
                at, bounds = _taken(words.bounds, first, after)
                together = [(int(first[i]), int(after[i]), *rest) for i, *rest in units(words, h[at], bounds, numeric[at], m)]
                covered = np.zeros(len(doc), bool)
                hits = []
                alone = units(words, h, words.bounds, numeric, m)
                pg, pb = _pairs(h, words.bounds, numeric)
                for a, b, family, *rest in together:
                    like = [m.alike_to(np.unique(pg[pb[i] : pb[i + 1]]), FAMILIES.index(family)) >= LINE_ALIKE for i in range(a, b)] if family != UNKNOWN else []
                    if sum(like) > 1:  # else one line says it all
                        a, b = a + like.index(True), b - like[::-1].index(True)
                        hits.append((a, b, family, *rest))
                        covered[a:b] = True
                for i, *rest in alone:
                    if not covered[i]:
                        hits.append((i, i + 1, *rest))
                        covered[i] = True
                hits += [x for x in together if x[2] == UNKNOWN and not covered[x[0] : x[1]].any()]
                out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                lines = {d: part.column(text)[d].as_py().split("\n") for d in {int(doc[x[0]]) for x in hits}}
                for a, b, family, probability, alike in sorted(hits):
                    d, k = int(doc[a]), int(number[a])
                    out[d].append({"paragraph": k, "lines": b - a, "family": family, "probability": probability, "similarity": alike, "text": "\n".join(lines[d][k : k + b - a])})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, _FOUND)], names=[*kept, "licenses"])

    plain = docs.select(*(F.col(f"`{c}`") for c in kept))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("licenses", FOUND)]))
