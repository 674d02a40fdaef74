import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sieverank.llm import warc
from sieverank.session import shared_folder

LONG = "".join(f"line {i} é\r\n\r\nWARC/1.1\r\n" for i in range(900))
PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a/3\r\nX: y", "<p>same</p>"), (4, "http://a/4", None),
    (5, "http://a/5", ""), (6, "http://a/6", LONG), (7, "http://a/7", LONG + "x"), (8, "", "0\r\n\r\n"), (9, "u", "<p>own</p>"),
    (9, "u", "<p>own</p>"), (None, "u", "<p>same</p>"), (None, "u", "<p>nobody</p>"),
]


def expected(pages, least):
    largest = {}
    for page, _, html in pages:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            largest[data] = max(largest.get(data, page), page)
    rows = []
    for page, _, html in pages:
        data = (html or "").encode()
        holder = largest.get(data)
        other = holder is not None and page != holder
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rows.append((page, len(data), digest, "revisit" if other else "response", holder if other else None))
    return sorted(rows, key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha", F.lit(2))
    found = warc.round_trip(pages, min_bytes=least, segment_bytes=1_000, chunk_bytes=300)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(PAGES, least)
    assert warc.round_trip(pages.filter(F.lit(False))).count() == 0


def test_payloads_come_back_from_segments(spark):
    pages = spark.createDataFrame(PAGES[5:7], "page_id long, url string, html string")
    path = shared_folder(spark, "test")
    warc.write(pages, path, segment_bytes=1_000)
    found = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path).collect()}
    assert found == {6: LONG, 7: LONG + "x"}


def records(**changes):
    made = list(warc.records_of(1, "u", b"x" * 100, warc.digest_of(b"x" * 100), None, "d", 60, 30))
    return made[: changes.get("upto", len(made))]


def test_framing_and_segments_are_checked(spark, tmp_path):
    assert warc.unchunked(warc.chunked(b"abc" * 50, 7)) == b"abc" * 50 and warc.unchunked(b"0\r\n\r\n") == b""
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nabc", "WRONG")
    for name, chosen in (("lost", records(upto=2)), ("gap", [records()[0], *records()[2:]])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.gz").write_bytes(gzip.compress(b"".join(r + warc.END for r in chosen)))
        with pytest.raises(Exception, match="segments are missing"):
            warc.read(spark, str(folder)).collect()
