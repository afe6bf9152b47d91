"""Archives read back as they were written."""

import base64
import gzip
import hashlib

import pytest

from textmatch.llm import warc
from textmatch.session import fresh_path

from .cases import with_clashes

ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""),
    (5, "http://a/5", "é漢\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "http://a/\r\nX: 6", "x" * 3_000_000), (7, "u", " "), (7, "u", " "),
    (None, "u", "only here"), (None, "v", "<p>one</p>"), (8, "w", "\r\n\r\n"),
]


def plain(rows, least=0):
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        best = max(same, default=None)
        revisit = len(data) >= least and page_id != best
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = with_clashes(spark.createDataFrame(ROWS, "page_id long, url string, html string")).repartition(3)
    path = fresh_path(spark, "warc-test")
    warc.write(pages, path, least)
    records = warc.read(spark, path)
    got = [tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == plain(ROWS, least)
    resolved = warc.originals(records, "payload", "payload_bytes").collect()
    html = {(r[0], r[1] or ""): (r[2] or "").encode() for r in ROWS}
    assert sorted(bytes(r["payload"]) for r in resolved) == sorted((r[2] or "").encode() for r in ROWS)
    for r in resolved:
        if r["page_id"] is not None and r["page_id"] != 6:
            assert bytes(r["payload"]) == html[r["page_id"], r["url"]]


def test_files_are_split_and_empty_tables_work(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " + "y" * 500) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    path = fresh_path(spark, "warc-test")
    warc.write(pages, path, file_bytes=20_000)
    assert spark.read.format("binaryFile").load(path + "/*.gz").count() > 3 and warc.read(spark, path).count() == 200
    path = fresh_path(spark, "warc-test")
    warc.write(pages.limit(0), path)
    assert warc.originals(warc.read(spark, path), "payload_bytes").count() == 0


def test_parser():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\n\r\r\n\r\n"
    many = gzip.compress(one) + gzip.compress(one * 3)
    assert [b for _, b in warc.parse(warc.unzip(many))] == [b"ab\r\n\r"] * 4
    assert [b for _, b in warc.parse(iter([one[i : i + 1] for i in range(len(one))]))] == [b"ab\r\n\r"]
    for bad in (one[:-2], one[:20], b"x" + one, one.replace(b"5", b"4")):
        with pytest.raises(ValueError):
            list(warc.parse(iter([bad])))


def test_missing_response_fails(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    warc.write(pages, path)
    records = warc.read(spark, path).filter("NOT (page_id <=> 9 AND record_type = 'response')")
    with pytest.raises(Exception, match="no response for page"):
        warc.originals(records, "payload_bytes").collect()
