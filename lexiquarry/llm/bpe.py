"""Exact byte-level BPE by backtracking, and its inverse.

Texts are cut into words by the classes of their code points. A word is
encoded in linear time: an Aho-Corasick automaton gives the longest vocabulary
entry that starts at each byte; the encoder takes it if it may stand after the
entry before (pair compatibility), tries the next shorter prefix otherwise,
and steps back where none fits. Two adjacent entries are compatible if
byte-pair merging of their joined bytes gives back exactly these two; a table
remembers the answers. Decoding gathers bytes through a table of offsets into
one blob that holds all entries.

All words of a block that a worker has not seen yet step forward together, as
numpy arrays; what it has seen is in flat arrays, found by a hash. Every block
is checked: its entries' bytes must be its texts' bytes, word by word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernel import Words, blocks, buffers, mix, release

#: Words that a worker remembers in each of two generations; the older one goes when the newer is full.
REMEMBERED = 400_000
#: Places of the table of pairs.
PAIRS = 1 << 18
#: Words of more bytes are stepped one by one.
LONG = 64
_LETTER, _NUMBER, _SPACE = 1, 2, 3
_FAR = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the letters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


#: What a vocabulary file must say, for its ids to be those of this encoder.
_NEEDED = {"dropout": (None, 0, 0.0), "unk_token": (None,), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "fuse_unk": (None, False), "byte_fallback": (None, False), "ignore_merges": (None, False)}


def _supported(file: dict) -> None:
    """Raises ValueError for a vocabulary file with settings that this encoder does not follow."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    wrong = [k for k, fine in _NEEDED.items() if model.get(k) not in fine]
    wrong += [k for k in ("normalizer",) if file.get(k)]
    wrong += ["pre_tokenizer"] * (cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space")) or not cut.get("use_regex", True))
    wrong += ["added_tokens"] * any(t.get(k) for t in file.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip"))
    if model.get("type") not in (None, "BPE") or wrong:
        raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(wrong) or model.get('type')}")


@dataclass
class Tables:
    """A vocabulary as arrays by id; a few megabytes, whatever the data."""

    blob: np.ndarray  # the bytes of all entries
    offsets: np.ndarray  # entry i is blob[offsets[i] : offsets[i + 1]]
    rank: np.ndarray  # of the merge that makes an entry, -1 for single bytes and added tokens
    left: np.ndarray  # the two entries which that merge joins
    right: np.ndarray
    shorter: np.ndarray  # the longest other entry that an entry begins with, -1 if none
    pairs: np.ndarray  # sorted left << 32 | right of all merges
    pair_ranks: np.ndarray
    usable: np.ndarray  # whether merging an entry's bytes gives that entry
    added: dict[bytes, int]

    @classmethod
    def of(cls, spec: str) -> Tables:
        """From the text of a `tokenizers` library file; ValueError if it asks for more than plain byte-level BPE."""
        file = json.loads(spec)
        _supported(file)
        raw = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        named = file["model"]["vocab"]
        entries = {i: b"".join(raw[c] for c in entry) for entry, i in named.items()}
        added = {t["content"].encode(): t["id"] for t in file.get("added_tokens") or []}
        whole = entries | {i: b for b, i in added.items()}
        size = max(whole) + 1
        texts = [whole.get(i, b"") for i in range(size)]
        rank, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        joined: dict[int, int] = {}
        for r, m in enumerate(file["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = named[a], named[b], named[a + b]
            joined.setdefault(x << 32 | y, r)
            if rank[z] < 0:
                rank[z], left[z], right[z] = r, x, y
        ids = {b: i for i, b in entries.items()}
        shorter = np.full(size, -1, np.int64)
        for i, b in entries.items():
            shorter[i] = next((ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ids), -1)
        pairs = np.array(sorted(joined), np.int64)
        out = cls(
            np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in texts])]), rank, left, right, shorter,
            pairs, np.array([joined[p] for p in pairs.tolist()], np.int64), np.array([i in entries and len(texts[i]) == 1 for i in range(size)]), added,
        )
        made = np.flatnonzero(rank >= 0)
        made = made[np.argsort(rank[made])]
        holds = out.seam(left[made], right[made], rank[made])
        for z, fine in zip(made.tolist(), holds.tolist(), strict=True):  # parts are made before what they make
            out.usable[z] = fine and out.usable[left[z]] and out.usable[right[z]]
        return out

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], _FAR) if len(self.pairs) else np.full(len(key), _FAR)

    def seam(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of adjacent entries leaves the seam between them, or leaves it before the merge `until`.

        The merges of both sides are undone from the latest on. At every stage
        the two entries at the seam stand side by side until the merge undone
        last; if the merge that joins them has a lower rank (or the same on the
        left side, which comes first in a left-to-right pass), it would have
        gone first.
        """
        fine = np.zeros(len(left), bool)
        at = np.arange(len(left))
        strict = np.ones(len(left), bool)
        until = np.full(len(left), _FAR) if until is None else until.copy()
        while len(at):
            joins = self._joins(left, right)
            stays = (joins > until) | ((joins == until) & (strict | (joins == _FAR)))
            a, b = self.rank[left], self.rank[right]
            bytes_only = (a < 0) & (b < 0)
            fine[at[stays & bytes_only]] = True
            on = stays & ~bytes_only
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            strict = a > b
            until = np.where(strict, a, b)
            left, right = np.where(strict, self.right[left], left), np.where(strict, right, self.left[right])
        return fine


def _classes() -> np.ndarray:
    """A class for each code point: letter, number, white space or none of them."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800), m.end())):
                shift = 0x800 * (a >= 0xD800)
                out[a + shift : max(a, b) + shift] = kind
    return out


class Splitter:
    """The words of byte-level vocabularies.

    A word is a run of letters, of numbers or of other signs, with the space
    before it; or an English contraction after no space; or white space. Of
    white space before a word the last character stands alone, or goes with the
    word if it is a space.
    """

    def __init__(self):
        self.classes = _classes()

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The bytes at which words start, for texts data[bounds[i] : bounds[i + 1]] that are cut one by one."""
        if not len(data):
            return np.zeros(0, np.int64)
        point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)  # the byte of each code point
        n = len(point)
        kind = self.classes[point]
        opens = np.zeros(n + 1, bool)  # first code point of a text, and the end
        opens[np.searchsorted(place, bounds)] = True
        cut = opens[:-1].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~opens[1:-1])  # last of white space before a word
        cut[last] = True
        cut[last[point[last] == 0x20] + 1] = False
        quote = np.flatnonzero((point[:-1] == 0x27) & cut[:-1] & (kind[1:] == _LETTER) & ~opens[1:-1])
        if len(quote):
            one = point[quote + 1]
            two = np.where((quote + 2 < n) & ~opens[np.minimum(quote + 2, n)], point[np.minimum(quote + 2, n - 1)], 0)
            width = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
            for a, b in ("re", "ve", "ll"):
                width[(one == ord(a)) & (two == ord(b))] = 3
            quote, width = quote[width > 0], width[width > 0]
            cut[quote + 1] = False
            end = quote + width
            cut[end[end < n]] = True
        return place[cut]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] places, one run after the other."""
    ends = np.cumsum(count)
    out = np.repeat(first - (ends - count), count)
    out += np.arange(len(out))
    return out


@dataclass
class _Seen:
    """Words by their hash: how many bytes they have and which ids."""

    keys: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls) -> _Seen:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, whether) the keys are."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def with_(self, other: _Seen) -> _Seen:
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        both = [np.concatenate([a, b])[order] for a, b in ((self.sizes, other.sizes), (self.first, other.first + len(self.ids)), (self.count, other.count))]
        return _Seen(keys[order], *both, np.concatenate([self.ids, other.ids]))

    def taken(self, at: np.ndarray) -> _Seen:
        count = self.count[at]
        return _Seen(self.keys[at], self.sizes[at], np.cumsum(count, dtype=np.int64) - count, count, self.ids[_spread(self.first[at], count)])


class Codec:
    """Encoder and decoder of one vocabulary, with what they remember."""

    def __init__(self, t: Tables):
        import ahocorasick
        import regex

        self.t = t
        self.size = t.lengths
        raw, ends = t.blob.tobytes().decode("latin-1"), t.offsets.tolist()
        self.find = ahocorasick.Automaton()
        for i in np.flatnonzero(t.usable).tolist():
            self.find.add_word(raw[ends[i] : ends[i + 1]], i)
        self.find.make_automaton()
        self.split = Splitter()
        self.special = regex.compile(b"|".join(map(regex.escape, sorted(t.added, key=len, reverse=True)))) if t.added else None
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.seen, self.older = _Seen.none(), _Seen.none()

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether entries may stand side by side, from the table of pairs or worked out."""
        key = left << 32 | right
        place = (mix(key.view(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        out = self.pair_fits[place]
        new = np.flatnonzero(self.pair_keys[place] != key)
        if len(new):
            out[new] = self.t.seam(left[new], right[new])
            self.pair_keys[place[new]], self.pair_fits[place[new]] = key[new], out[new]  # of several pairs for one place the last stays
        return out

    def _longest(self, text: bytes) -> np.ndarray:
        """The longest entry that starts at each byte, -1 if none; and one place more."""
        out = np.full(len(text) + 1, -1, np.int64)
        hits = np.fromiter(chain.from_iterable(self.find.iter(text.decode("latin-1"))), np.int64)
        end, entry = hits[::2], hits[1::2]
        out[end - self.size[entry] + 1] = entry  # ends only grow, so the last is the longest
        return out

    def _step(self, joined: bytes, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry that is chosen to start at each byte or -1, longest entries) for words joined[at[i] : end[i]] with a byte between them."""
        longest = self._longest(joined)
        shorter, size = self.t.shorter, self.size
        usable = self.t.usable
        open_ = np.ones(len(joined) + 1, bool)
        before = np.full(len(joined) + 1, -1, np.int64)  # the entry that ends at a byte
        at, entry = at.copy(), longest[at]
        while len(at):
            some = entry >= 0
            to = np.where(some, at + size[entry], at)
            good = some & usable[entry] & open_[to]
            ask = np.flatnonzero(good & (before[at] >= 0))
            if len(ask):
                good[ask] = self._fits(before[at[ask]], entry[ask])
            none = np.flatnonzero(~some)
            if len(none):  # nothing fits here: no encoding reaches this place
                open_[at[none]] = False
                last = before[at[none]]
                if (last < 0).any():
                    raise ValueError("the vocabulary lacks a byte")
                at[none] -= size[last]
            before[to[good]] = entry[good]
            following = np.where(good, longest[to], shorter[entry])
            if len(none):
                following[none] = last
            at = np.where(good, to, at)
            more = at < end
            at, end, entry = at[more], end[more], following[more]
        return before

    def _back(self, before: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of words, walked from their ends."""
        steps, rows, place = [], [], end.copy()
        row = np.arange(len(at))
        while len(row):
            entry = before[place]
            steps.append(entry)
            rows.append(row)
            place = place - self.size[entry]
            more = place > at[row]
            row, place = row[more], place[more]
        row, ids = np.concatenate(rows), np.concatenate(steps)
        order = np.lexsort((-np.arange(len(row)), row))
        return ids[order].astype(np.int32), np.bincount(row, minlength=len(at)).astype(np.int32)

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of one word, stepped with a stack."""
        longest, shorter, size, usable = self._longest(word).tolist(), self.t.shorter, self.size, self.t.usable
        open_ = bytearray(b"\1") * (len(word) + 1)
        known: dict[tuple[int, int], bool] = {}
        out: list[int] = []
        at, entry = 0, longest[0]
        while at < len(word):
            while entry >= 0:
                end = at + int(size[entry])
                if open_[end] and usable[entry]:
                    if not out:
                        break
                    pair = out[-1], entry
                    if pair not in known:
                        known[pair] = bool(self.t.seam(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if known[pair]:
                        break
                entry = int(shorter[entry])
            if entry >= 0:
                out.append(entry)
                at, entry = end, longest[end]
            else:
                open_[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                entry = out.pop()
                at -= int(size[entry])
        return np.array(out, np.int32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> _Seen:
        """The ids of distinct words that are not remembered."""
        size = end - start
        found: list[np.ndarray | None] = [None] * len(keys)
        count = np.zeros(len(keys), np.int32)
        short = np.flatnonzero(size <= LONG)
        ids = np.zeros(0, np.int32)
        if len(short):
            # A byte 0xFF, which no text has, stands after each word.
            n = size[short]
            joined = np.full(int(n.sum()) + len(short), 0xFF, np.uint8)
            stop = np.cumsum(n + 1) - 1
            joined[_spread(stop - n, n)] = data[_spread(start[short], n)]
            ids, count[short] = self._back(self._step(joined.tobytes(), stop - n, stop), stop - n, stop)
        if len(short) == len(keys):
            return _Seen(keys, size.astype(np.int32), np.cumsum(count, dtype=np.int64) - count, count, ids)
        ends = np.cumsum(count[short])
        for i, a, b in zip(short.tolist(), (ends - count[short]).tolist(), ends.tolist(), strict=True):
            found[i] = ids[a:b]
        for i in np.flatnonzero(size > LONG).tolist():
            found[i] = self._long(data[start[i] : end[i]].tobytes())
            count[i] = len(found[i])
        return _Seen(keys, size.astype(np.int32), np.cumsum(count, dtype=np.int64) - count, count, np.concatenate(found))

    def block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each text) of the texts data[bounds[i] : bounds[i + 1]], UTF-8."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        cuts, special = bounds, []
        raw = data.tobytes()
        if self.special is not None and any(s in raw for s in self.t.added):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                special += [(a + m.start(), a + m.end(), self.t.added[m[0]]) for m in self.special.finditer(raw[a:b])]
            cuts = np.unique(np.concatenate([bounds, [x[0] for x in special], [x[1] for x in special]]).astype(np.int64))
        start = self.split.starts(data, cuts)
        added = np.zeros(len(start), np.int64)
        if special:
            a, b, entry = (np.array(x) for x in zip(*special, strict=True))
            inside = np.searchsorted(a, start, "right") - 1
            within = (inside >= 0) & (start < b[inside])
            keep = ~within | (start == a[inside])
            added = np.where(within, entry[inside] + 1, 0)[keep]
            start = start[keep]
        end = np.append(start[1:], len(data))
        h = Words.of(data, start, end).hashes()
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.seen.keys) + len(keys) > REMEMBERED:
            self.older, self.seen = self.seen, _Seen.none()
        where, known = self.seen.find(keys)
        missing = np.flatnonzero(~known)
        if len(missing):
            old, had = self.older.find(keys[missing])
            new = at[missing[~had]]
            more = self.older.taken(old[had]).with_(self._learn(data, keys[missing[~had]], start[new], end[new]))
            self.seen = self.seen.with_(more)
            where, _ = self.seen.find(keys)
        where = where[inverse]
        count = self.seen.count[where].astype(np.int64)
        ids = self.seen.ids[_spread(self.seen.first[where], count)]
        if special:
            one = added > 0
            first = (np.cumsum(count) - count)[one]
            drop = np.ones(len(ids), bool)
            drop[_spread(first + 1, count[one] - 1)] = False
            ids[first] = added[one] - 1
            ids, count = ids[drop], np.where(one, 1, count)
        # Two words of one hash can't pass: sizes and bytes are compared.
        told, _ = gather(self.t, ids)
        size = np.where(added > 0, end - start, self.seen.sizes[where])
        if not (np.array_equal(size, end - start) and np.array_equal(told, data)):
            word = [np.array([a - 1], np.int32) if a else self._long(raw[x:y]) for a, x, y in zip(added.tolist(), start.tolist(), end.tolist(), strict=True)]
            ids, count = np.concatenate(word), np.array([len(x) for x in word])
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(start, bounds)])

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.block(raw, np.array([0, len(raw)]))[0].tolist()


def gather(t: Tables, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all entries in a row, where each entry ends)."""
    n = t.lengths[ids]
    return t.blob[_spread(t.offsets[:-1][ids], n)], np.cumsum(n)


def _texts(t: Tables, ids: np.ndarray, count: np.ndarray) -> list[str]:
    data, ends = gather(t, ids)
    last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])].tolist()
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(last[:-1], last[1:], strict=True)]


_made: tuple[int, Codec] | None = None


def _codec(shared) -> Codec:
    """The worker process' own codec of a broadcast vocabulary."""
    global _made
    if _made is None or _made[0] != id(shared.value):
        _made = (id(shared.value), Codec(shared.value))
    return _made[1]


def vocabulary(spark: SparkSession, path: str):
    """The tables of a vocabulary file as a broadcast value; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Tables.of(f.read()))


def _list(ids: np.ndarray, count: np.ndarray) -> pa.ListArray:
    ends = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))


def _plain(df: DataFrame, without: tuple[str, ...]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in without))


def encode(docs: DataFrame, shared, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column of token ids, array<int>.

    Null and empty texts have no ids. A long text is encoded whole. A column
    named `ids` is replaced; all others are kept as they are, repeated rows too.
    """
    plain = _plain(docs, (ids,))
    kept = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part in blocks(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, _list(*codec.block(*buffers(part.column(text))))], names=[*kept, ids])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, shared, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text that the ids stand for; bytes that are no UTF-8 become U+FFFD, no or null ids the empty text."""
    plain = _plain(df, (out,))
    kept = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(batch.num_rows * (1 << 20) / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                column = part.column(ids)
                texts = _texts(shared.value, np.asarray(column.flatten(), np.int64), np.asarray(column.value_lengths().fill_null(0), np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, out])
            release()

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(out, T.StringType())]))


def encode_decode(docs: DataFrame, shared, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`decode(encode(docs))` without the texts, in one step: each core has one worker, and ids do not travel twice."""
    plain = _plain(docs, (ids, out))
    kept = [c for c in plain.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part in blocks(batch, text):
                found, count = codec.block(*buffers(part.column(text)))
                told = pa.array(_texts(codec.t, found, count), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _list(found, count), told], names=[*kept, ids, out])

    fields = [f for f in plain.schema.fields if f.name != text]
    return plain.mapInArrow(run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())]))
