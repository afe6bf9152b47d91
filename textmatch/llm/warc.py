"""WARC archives without repeated payloads.

Writing. Records with equal payloads (by SHA-1 of the payload) form a group; the one with
the largest id is written as a response, the others as revisits that name it and carry no
payload. Only headers are shuffled to find that out: digest, length and largest id, summed
before the shuffle, so a payload that a third of all pages share is no crowded key. The
table of repeated payloads is written, so its size is known: a small one is broadcast, for
a large one pages are shuffled by digest, where adaptive execution splits a crowded one. Archives are gzip files written by Spark's text writer, so a lost task is
written again by the usual commit.

Reading. A task reads whole archive files one after the other and parses records by their
length header, piece by piece as the gzip stream unfolds. Revisits are resolved by a join
with the responses on the record id they refer to.

Defined results: a null html is an empty payload; empty payloads are equal to each other.
Rows with the same id are records of their own; rows of equal payload that share the
largest id are all responses. A null id is smaller than any id. Other columns are
ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path, written

FILE_BYTES = 32 << 20  # payload bytes aimed at per archive file
MIN_PAYLOAD = 0  # smaller payloads are always responses
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_ID = "<urn:page:"


def digest(payload: Column) -> Column:
    """Base32 SHA-1 of a text: eight groups of five hex digits, each four base-32 digits."""
    sha = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """Pages with payload, payload_bytes and payload_digest."""
    return pages.withColumn("payload", F.coalesce(F.col("html"), F.lit(""))).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest(F.col("payload")),
    })


def resolve(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Pages with record_type and refers_to. ``pages``: page_id, url, html."""
    rows = headers(pages.select("page_id", "url", "html")).drop("html")
    keep = ["payload_digest", "payload_bytes"]
    first = rows.filter(F.col("payload_bytes") >= min_payload).groupBy(*keep).agg(
        F.max("page_id").alias("response_id"), F.count("*").alias("n")
    )
    first = written(first.filter("n > 1").drop("n"), "repeated-payloads")
    joined = rows.join(first, keep, "left")
    is_first = F.col("response_id").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.withColumns({
        "record_type": F.when(is_first, F.lit("response")).otherwise(F.lit("revisit")),
        "refers_to": F.when(is_first, F.lit(None)).otherwise(F.col("response_id")).cast("long"),
    }).drop("response_id")


def record(row_type: Column) -> Column:
    """One WARC record as text, without the blank lines that end it."""
    is_revisit = row_type == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    known = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    block = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", row_type),
        line("WARC-Record-ID", F.concat(F.lit(_ID), known, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(is_revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit(_ID), F.col("refers_to").cast("string"), F.lit(">"))),
            line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block,
    )


def write(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, file_bytes: int = FILE_BYTES) -> None:
    """Write deduplicated archives with fresh headers."""
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    per_file = max(1, int(n * file_bytes / max(size or 0, n, 1)))
    records = resolve(pages, min_payload).select(record(F.col("record_type")).alias("value"))
    writer = records.write.option("compression", "gzip").option("lineSep", _END)
    writer.option("maxRecordsPerFile", per_file).text(path)


# ---- reading ---------------------------------------------------------------------

_STEP = 1 << 20


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of bytes."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        part = next(chunks, None)
        if part is None:
            return False
        held.extend(part)
        return True

    while True:
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's headers")
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        while len(held) < end + 8 + size:
            if not more():
                raise ValueError("the archive ends inside a record")
        block = bytes(held[end + 4 : end + 4 + size])
        if held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        del held[: end + 8 + size]
        yield fields, block


def unzip(data: bytes) -> Iterator[bytes]:
    """A gzip file, of one or several members, piece by piece."""
    stream = zlib.decompressobj(31)
    for at in range(0, len(data), _STEP):
        part = data[at : at + _STEP]
        while part:
            out = stream.decompress(part, 4 * _STEP)
            if out:
                yield out
            if stream.eof:
                part, stream = stream.unused_data, zlib.decompressobj(31)
            else:
                part = stream.unconsumed_tail
    yield stream.flush()


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _page(text: str | None) -> int | None:
    value = text.removeprefix(_ID).removesuffix(">") if text else "none"
    return None if value == "none" else int(value)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives below ``path``; a response's digest and length are its block's."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(unzip(content.as_py())):
                    is_response = fields["WARC-Type"] == "response"
                    claimed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if is_response:
                        sha = base64.b32encode(hashlib.sha1(block).digest()).decode()
                        if sha != claimed:
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
                    rows.append({
                        "page_id": _page(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
                        "url": fields["WARC-Target-URI"],
                        "payload_bytes": len(block) if is_response else int(fields["X-Payload-Length"]),
                        "payload_digest": claimed, "refers_to": _page(fields.get("WARC-Refers-To")),
                        "payload": block if payloads and is_response else None,
                    })
                    size += len(block) if payloads else 0
                    if len(rows) >= 10_000 or size > _STEP * 8:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInArrow(
        run, "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    )


def originals(records: DataFrame, *columns: str) -> DataFrame:
    """Records with ``columns`` of the response that a revisit refers to in place of their own.

    A revisit whose response is missing fails.
    """
    responses = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.lit(True).alias("_found"),
        *[F.col(c).alias(f"_{c}") for c in columns],
    ).dropDuplicates(["refers_to", "payload_digest"])
    joined = records.join(responses, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    is_response = F.col("record_type") == "response"
    return joined.select(
        "page_id", "record_type", "url", "payload_digest", "refers_to",
        *[F.when(is_response, F.col(c)).when(F.col("_found"), F.col(f"_{c}")).otherwise(lost).alias(c) for c in columns],
    )


def archive(pages: DataFrame) -> str:
    """Write the archives of ``pages`` to the shared folder; returns their path."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path)
    return path
