"""Chat transcripts from event logs.

A log holds, for each conversation, numbered events: a message is opened,
grows by deltas, may be edited (its text is replaced) or regenerated (its text
starts afresh and all later messages opened before go). `fold` partitions the
log by conversation, orders by sequence number and folds the events into the
final messages; `render` writes them in a template with control strings, and
`read_back` parses that output. All of it stays in one partitioning by
conversation and takes time in proportion to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The control strings of the template.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
EVENTS = "conv_id long, seq long, kind string, msg long, role string, text string"


def escape(text: str, role: bool = False) -> str:
    r"""No control string is left inside: `\` becomes `\b` and `<|` becomes `\c`; in a role a newline becomes `\d`."""
    out = text.replace("\\", "\\b").replace("<|", "\\c")
    return out.replace("\n", "\\d") if role else out


def unescape(text: str) -> str:
    """The inverse: after escaping, every backslash starts one of the three codes."""
    return text.replace("\\d", "\n").replace("\\c", "<|").replace("\\b", "\\")


def events_of(rows: DataFrame, piece: int = 256, reworked: bool = False) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text): each row is opened and streamed in pieces.

    Rows are numbered by turn; rows of the same turn by role and text, so
    repeated rows stay as messages of their own. With `reworked` the log has,
    by a hash of the text, drafts that are regenerated, drafts that an edit
    replaces, and events that are delivered twice; it folds to the same rows.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn"), F.col("role"), F.col("text"))
    numbered = rows.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("msg"))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))

    nothing = F.lit(None)
    opened, deltas = F.array(event("open", nothing)), F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda t: event("delta", t))
    events, times = F.concat(opened, deltas), F.lit(1)
    if reworked:
        draft = F.array(event("delta", F.reverse("text")))
        way = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(4))
        again = F.concat(opened, draft, F.array(event("regenerate", nothing)), deltas)
        edited = F.concat(opened, draft, F.array(event("edit", F.col("text"))))
        events, times = F.when(way == 1, again).when(way == 2, edited).otherwise(events), F.when(way == 3, 2).otherwise(1)
    out = numbered.select("conv_id", "msg", "role", times.alias("times"), F.posexplode(events).alias("k", "e"))
    out = out.select("conv_id", (F.col("msg") * (1 << 31) + F.col("k")).alias("seq"), "e.kind", "msg", "role", "e.text", "times")
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times") if reworked else out.drop("times")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns: array<struct<msg, role, text>>, the final messages in order.

    Events apply in the order of (seq, kind, role, text, msg), and exact
    repeats of an event once, so a log that is delivered twice folds alike. A
    delta adds to its message's text, an edit replaces it, a regenerate empties
    it and takes away all messages of greater msg as they are then; one that is
    opened later stands again, without what it said before. The last open gives
    a message its role; a message that is never opened is by its first event.
    Events of other kinds say nothing more. Null texts are empty, a null role
    is the empty role, a null msg is a message before all others. Null conv_ids
    form one conversation.
    """
    one = F.struct("seq", "kind", "role", "text", "msg")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    dealt = events.select("conv_id", "msg", "seq", "kind", *blank).repartition("conv_id").distinct()
    at = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), one))
    # What the filter below compares with is aggregated, not an expression that it would work out anew for each event.
    messages = dealt.groupBy("conv_id", "msg").agg(
        F.array_sort(F.collect_list(one)).alias("ev"),
        at("edit", "regenerate").alias("reset"),
        F.coalesce(at("open"), F.min(one)).alias("first"),
        F.when(F.col("msg").isNotNull(), at("regenerate")).alias("regenerated"),
    )
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    standing = messages.withColumn("cut", F.max("regenerated").over(before)).where("cut is null or first > cut").withColumn("from", F.greatest("reset", "cut"))
    spoken = F.filter("ev", lambda e: e["kind"].isin("delta", "edit") & (F.col("from").isNull() | (e >= F.col("from"))))
    said = standing.select("conv_id", "msg", "first.role", F.array_join(F.transform(spoken, lambda e: e["text"]), "").alias("text"))
    return said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "role", "text"))).alias("turns"))


#: Characters of conversations that are given out together.
_BATCH = 4 << 20
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _dealt(found: Iterator[tuple[int, tuple]], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their sizes."""
    rows, held = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))
    for size, row in found:
        rows.append(row)
        held += size
        if held > _BATCH:
            yield make()
            rows, held = [], 0
    if rows:
        yield make()


def render(folded: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the template's text and the [start, end) code points of the assistant texts in it.

    An empty text is a turn like others, with an empty span if it is the
    assistant's; no conversations give no rows. Other columns are not read.
    """

    def one(turns: list[dict]) -> tuple[str, list[dict]]:
        parts, spans, at = [], [], 0
        for t in turns:
            head, text = f"{TURN_START}{escape(t['role'], True)}\n", escape(t["text"])
            if t["role"] == "assistant":
                spans.append({"start": at + len(head), "end": at + len(head) + len(text)})
            parts += [head, text, TURN_END, "\n"]
            at += len(head) + len(text) + len(TURN_END) + 1
        return "".join(parts), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    text, spans = one(batch.column(1)[i].as_py())
                    yield len(text), (batch.column(0)[i].as_py(), text, spans)

        yield from _dealt(rows(), {"conv_id": pa.int64(), "formatted": pa.string(), "loss": _SPANS})

    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return folded.select(F.col("conv_id").cast("long").alias("conv_id"), turns.alias("turns")).mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:bigint,end:bigint>>")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted) parsed from the rendered text and its loss spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for conv_id, formatted, loss in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss")), strict=True):
                    text, turns = formatted.as_py(), []
                    for piece in text.split(f"{TURN_END}\n")[:-1]:
                        role, _, said = piece.removeprefix(TURN_START).partition("\n")
                        turns.append({"role": unescape(role), "text": unescape(said)})
                    yield 2 * len(text), (conv_id.as_py(), turns, [unescape(text[s["start"] : s["end"]]) for s in loss.as_py()], text)

        yield from _dealt(rows(), {"conv_id": pa.int64(), "turns": _TURNS, "loss_texts": pa.list_(pa.string()), "formatted": pa.string()})

    return rendered.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_texts array<string>, formatted string")
