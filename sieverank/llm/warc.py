"""WARC archives: written from pages, with revisits and segments, and read back.

A record whose payload equals that of another with a larger id becomes a revisit of it. Blocks longer
than a segment are written as a first record and continuation records. Reading groups continuations by
the origin's identifier, orders them by segment number, verifies the total length and decodes the
chunked transfer framing. Files are written by Spark's text writer, the records' closing CRLF CRLF being
its line end, compressed with gzip, and read whole as binary files; segments and records per file bound
a file's size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieverank.llm import texts
from sieverank.session import cut, shared_folder

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 65_536, 8_192, 1_024
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, refers_to long, origin string, number int, total long, digest string, data binary"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _named(number) -> str:
    return "null" if number is None else str(number)


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{name}: {str(value).translate(_BREAKS)}" for name, value in fields if value is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode("utf-8", "surrogatepass") + END


_BREAKS = {10: " ", 13: " "}


def records_of(page_id, url, payload: bytes, digest: str, refers_to, date: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The WARC records of one page, without their closing CRLF CRLF."""
    name = f"<urn:page:{_named(page_id)}:{uuid.uuid4()}>"
    head = [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        yield _header([("WARC-Type", "revisit"), *head, *more, kind, ("Content-Length", len(http))]) + http
        return
    block = http + chunked(payload, chunk)
    if len(block) <= segment:
        yield _header([("WARC-Type", "response"), *head, kind, ("Content-Length", len(block))]) + block
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _header([("WARC-Type", "response"), *head, ("WARC-Segment-Number", 1), kind, ("Content-Length", segment)]) + parts[0]
    for number, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", url)]
        own += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number)]
        own += [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        yield _header([*own, ("Content-Length", len(part))]) + part


def write(
    pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Writes archives below ``path``, one or more records per row.

    Of rows whose payloads are equal and hold at least ``min_bytes``, those with the largest page_id
    are responses and the others revisit it; rows without id revisit those with one. A null html is
    an empty payload.
    """
    texts.prepare(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    longest = F.octet_length("payload") >= min_bytes
    holders = rows.filter(longest).groupBy(F.col("sha").alias("same")).agg(F.max("page_id").alias("holder"))
    other = longest & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    marked = rows.join(holders, F.col("sha") == F.col("same"), "left").select(
        "page_id", "url", F.when(other, F.col("holder")).alias("refers_to"), "payload"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches, "payload", 1 << 20):
            found = []
            for row in batch.to_pylist():
                payload = row["payload"]
                found += records_of(
                    row["page_id"], row["url"], payload, digest_of(payload), row["refers_to"], date, segment_bytes, chunk_bytes
                )
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["record"])

    records = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parsed(content: bytes) -> Iterator[dict]:
    """The records of one archive, by their stated lengths."""
    at = 0
    while at < len(content):
        end = content.index(END, at)
        lines = content[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record starts where the last one ended")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + len(END)
        stop = start + int(fields["Content-Length"])
        if content[stop : stop + len(END)] != END:
            raise ValueError("a record does not end where its length says")
        yield fields | {"block": content[start:stop]}
        at = stop + len(END)


def _number(name: str | None) -> int | None:
    """The page id in <urn:page:ID...>."""
    part = name.strip("<>").split(":")[2] if name else "null"
    return None if part == "null" else int(part)


def _row(fields: dict) -> dict:
    kind = fields["WARC-Type"]
    own = kind != "continuation"
    return {
        "page_id": _number(fields["WARC-Record-ID"]) if own else None,
        "record_type": kind,
        "refers_to": _number(fields.get("WARC-Refers-To")),
        "origin": fields["WARC-Record-ID"] if own else fields["WARC-Segment-Origin-ID"],
        "number": int(fields.get("WARC-Segment-Number", 0)),
        "total": int(fields.get("WARC-Segment-Total-Length", 0)) or None,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if own else None,
        "data": fields["block"] if kind != "revisit" else None,
    }


def payload_of(block: bytes, digest: str) -> bytes:
    """The payload of a whole HTTP block, checked against the record's digest."""
    head, _, body = block.partition(END)
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest_of(payload) != digest:
        raise ValueError("a payload does not have the digest its record states")
    return payload


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload) of every response and revisit below ``path``.

    ``payload`` is null for revisits. Raises if a segment is missing, a total length is not met, or
    framing or digest are broken.
    """
    texts.prepare(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()),
                          ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("data", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields in parsed(gzip.decompress(content.as_py())):
                    rows.append(_row(fields))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kind)

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, RECORD)
    parts = records.filter("number > 0").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("number", "data"))).alias("parts"),
    )
    broken = (F.size("parts") != F.element_at("parts", -1)["number"]) | F.col("total").isNull()
    block = F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")
    joined = parts.select(
        "page_id", "digest",
        F.when(broken, F.raise_error(F.concat(F.lit("segments are missing of "), "origin")))
        .when(F.length(block) != 2 * F.col("total"), F.raise_error(F.concat(F.lit("the total length is not met of "), "origin")))
        .otherwise(F.unhex(block)).alias("data"),
    )
    whole = records.filter("record_type = 'response' and number = 0").select("page_id", "digest", "data").union(joined)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches, "data"):
            found = [payload_of(b.as_py(), d.as_py()) for b, d in zip(batch.column("data"), batch.column("digest"), strict=True)]
            columns = [batch.column("page_id"), batch.column("digest"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "digest", "payload"])

    responses = whole.mapInArrow(decode, "page_id long, digest string, payload binary")
    first = responses.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest", "payload")
    revisits = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest", F.lit(None).cast("binary").alias("payload"))
    return first.union(revisits)


def round_trip(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page, from written archives.

    A revisit's bytes are those of the response it names, found by its id and digest. Null and empty
    pages are payloads of no bytes, which revisit each other too. Rows that repeat id and payload are
    responses each if the id is the largest; rows without id become revisits where a row with an id
    has the payload. An empty table gives no rows; other columns take no part.
    """
    path = shared_folder(pages.sparkSession, "archives")
    write(pages, path, min_bytes, segment_bytes, chunk_bytes)
    found = read(pages.sparkSession, path).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
    found = cut(found, "payloads")
    responses = found.filter("record_type = 'response'")
    sizes = responses.groupBy(F.col("page_id").alias("target"), F.col("digest").alias("same")).agg(F.max("payload_bytes").alias("bytes"))
    revisits = found.filter("record_type = 'revisit'")
    resolved = revisits.join(sizes, (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("same")), "left")
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return responses.select(*columns).union(resolved.withColumn("payload_bytes", F.col("bytes")).select(*columns))
