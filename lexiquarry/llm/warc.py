r"""Web archives: writing, reading, and reassembly of segmented records.

`write` turns pages into WARC 1.1 files with Spark's own text writer (a record
is a row; the last line end of a record is the writer's line separator), so
archives go to any store that Spark writes to. Pages with equal payloads of
some size share one response; the others are revisits. Long records are cut
into a first segment and continuation records.

`read` parses the files by content length, a record at a time. `reassemble`
groups continuation records by the identifier of their first segment, orders
them by segment number, and verifies that numbers are whole and lengths add up
to the total. `payload` decodes the HTTP message, chunked transfer framing
included. `resolve` looks up the responses that revisits refer to.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records of an archive file at most; with the length of a segment this bounds what a reader holds.
RECORDS_PER_FILE = 2000
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = (
    "uri string, record_id string, type string, date string, payload_digest string, refers_to string, payload_length long, "
    "segment long, origin_id string, total_length long, block binary"
)


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The body without its framing; None if a chunk is cut off or its size can't be read."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        m = re.match(rb"[0-9A-Fa-f]+", body[at : max(end, at)])
        if end < 0 or not m:
            return None
        size = int(m[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The body of an HTTP message, unframed; None if the message is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")):
        return dechunked(body)
    return body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its last line end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n"])


def _uri(url: str | None) -> str:
    """A URL fit for a header line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def page_urn(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str, nonce: str) -> Iterator[bytes]:
    """The record of one page, in segments where it is long."""
    own = f"<{page_urn(page_id)}:{nonce}>"
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", sha1)]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{page_urn(refers)}>"), ("X-Payload-Length", str(len(payload)))]
        yield record(fields, b"")
        return
    fields.append(("Content-Type", "application/http;msgtype=response"))
    block = _HTTP + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield record(fields, block)
        return
    yield record([*fields, ("WARC-Segment-Number", "1")], block[:SEGMENT_BYTES])
    last = -(-len(block) // SEGMENT_BYTES)
    for k in range(2, last + 1):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
        if k == last:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(more, block[(k - 1) * SEGMENT_BYTES : k * SEGMENT_BYTES])


def write(pages: DataFrame, path: str, duplicates: DataFrame, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html) as archives under `path`.

    duplicates: (payload_digest, response) from `shared_payloads`. A null html
    is an empty payload, a null url an empty one. Rows with a null page_id are
    written under an empty identifier. Repeated rows are written as often as
    they occur; of rows that share the largest page_id, each is a response.
    Rows whose payload has fewer than `least` bytes are responses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page_id, url, html, digest, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                out += records_of(page_id, url, html, digest, response, response is not None and response != page_id, date, f"{task:x}-{n:x}")
                held += len(html)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body).alias("payload_digest"))
    rows = rows.join(duplicates, "payload_digest", "left").select(
        F.col("page_id").cast("long"), "url", "html", "payload_digest", F.when(F.length("html") >= least, F.col("response")).cast("long").alias("response")
    )
    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def shared_payloads(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(payload_digest, response) of payloads of at least `least` bytes that several pages have: the largest page_id responds."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.length(body).alias("size"), F.sha1(body).alias("payload_digest")).where(F.col("size") >= least)
    return rows.groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes in pieces; a gzip file may hold a member for each record."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    at, z = 0, zlib.decompressobj(31)
    while at < len(data):
        left = data[at : at + step]
        at += len(left)
        while left:
            yield z.decompress(left, step)
            left = z.unconsumed_tail
            if z.eof:
                left, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of an archive that comes in pieces, as RECORD's fields; raises ValueError where no record begins. Holds one record."""
    pieces = iter(pieces)
    held, at, passed = bytearray(), 0, 0

    def until(found) -> int:
        """Takes in pieces until `found` gives a place of what is held, or the end comes (-1)."""
        nonlocal held, at, passed
        while (place := found()) < 0:
            piece = next(pieces, None)
            if piece is None:
                return -1
            if at > 1 << 20:
                passed += at
                del held[:at]
                at = 0
            held += piece
        return place

    while until(lambda: at if len(held) > at else -1) >= 0:
        seen = 0

        def head_ends() -> int:
            nonlocal seen
            place = held.find(b"\r\n\r\n", at + max(0, seen - 3))
            seen = len(held) - at
            return place

        end = until(head_ends)
        if not held.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {passed + at}")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size, head = int(f["content-length"]), end + 4 - at
        if until(lambda: at if len(held) >= at + head + size else -1) < 0:  # noqa: B023
            raise ValueError(f"the record at byte {passed + at} is cut off")
        block = bytes(held[at + head : at + head + size])
        until(lambda: at if len(held) >= at + head + size + 4 else -1)  # noqa: B023
        at = min(len(held), at + head + size + 4)
        digest = f.get("warc-payload-digest", "")
        digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
        number = {k: int(f[k]) if k in f else None for k in ("x-payload-length", "warc-segment-number", "warc-segment-total-length")}
        bare = lambda k: f[k].strip("<>") if k in f else None  # noqa: B023, E731
        yield (
            f.get("warc-target-uri"), bare("warc-record-id"), f.get("warc-type"), f.get("warc-date"), digest, bare("warc-refers-to"), number["x-payload-length"],
            number["warc-segment-number"], bare("warc-segment-origin-id"), number["warc-segment-total-length"], block,
        )


def read(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """RECORD rows of the archives under `path`, gzipped or plain; `segmented` keeps only segments, or only whole records.

    A task holds a file as it is stored, and of what is in it one record at a time.
    """
    kinds = [pa.int64() if c.split()[1] == "long" else pa.binary() if c.split()[1] == "binary" else pa.string() for c in RECORD.split(", ")]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for r in parse(unpacked(batch.column(0)[i].as_py())):
                    if segmented is None or segmented == (r[7] is not None):
                        rows.append(r)
                        held += len(r[-1])
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records from their segments, with `complete`.

    A record is complete if its segments are numbered 1 .. n without gaps or
    repeats and their lengths add up to the total that the last one states.
    Segments without a first one give a record without type and URI, not
    complete. Memory is bounded by one record.
    """
    origin = F.when(F.col("segment") == 1, F.col("record_id")).otherwise(F.col("origin_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    whole = segments.groupBy(origin.alias("record_id")).agg(
        *(first(c) for c in ("uri", "type", "date", "payload_digest", "refers_to", "payload_length")),
        F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    # One copy of all bytes; a join of strings leaves them as they are.
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    numbers = F.transform("parts", lambda p: p["segment"])
    return whole.withColumn("block", block).select(
        "uri", "record_id", "type", "date", "payload_digest", "refers_to", "payload_length", "block",
        F.coalesce((F.length("block") == F.col("total_length")) & (numbers == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))), F.lit(False)).alias("complete"),
    )


def payload(records: DataFrame, block: str = "block") -> DataFrame:
    """`records` with `payload` instead of the block; null for a broken HTTP message."""

    kept = [c for c in records.columns if c != block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if b is None else http_payload(b) for b in batch.column(block).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], names=[*kept, "payload"])

    plain = records.select(*kept, block)
    return plain.mapInArrow(run, records.select(*kept).schema.add("payload", T.BinaryType()))


def resolve(facts: DataFrame) -> DataFrame:
    """`facts` with size and digest of revisits taken from the responses that they refer to, and `verified`.

    facts: page, type, told_bytes, told_digest, refers, size, digest; the last
    two are a response's own, null if it is broken or incomplete. A response is
    verified if its payload has the digest that its record tells, a revisit if
    a response of the page that it refers to has the digest and length that it
    tells; size and digest are null otherwise, and no record is left out.
    """
    own = facts.where("type <> 'revisit' and digest is not null").groupBy(F.col("page").alias("refers"), F.col("digest").alias("told_digest")).agg(F.max("size").alias("found"))
    both = facts.join(own, ["refers", "told_digest"], "left")
    revisit = F.col("type") == "revisit"
    fine = F.when(revisit, F.col("found") == F.col("told_bytes")).otherwise(F.col("digest") == F.col("told_digest"))
    return both.select(
        "page", "type", "refers",
        F.when(revisit, F.col("found")).otherwise(F.col("size")).alias("size"),
        F.when(revisit, F.when(F.col("found").isNotNull(), F.col("told_digest"))).otherwise(F.col("digest")).alias("digest"),
        F.coalesce(fine, F.lit(False)).alias("verified"),
    )


def urn_page(column: str) -> Column:
    """The page_id in an identifier, null where there is none."""
    return F.nullif(F.regexp_extract(column, "^urn:x-page:(-?[0-9]*)", 1), F.lit("")).cast("long")
