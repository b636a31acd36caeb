import base64
import hashlib

import pytest

from quorumlens.llm import warc
from quorumlens.session import scratch_path

SCHEMA = "page_id bigint, url string, html string, extra int"


def record(kind, number, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{number}>\r\nContent-Type: application/http\r\n"
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def expected(rows):
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        own = first.get(html or "")
        revisit = own is not None and page != own
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", own if revisit else None, True))
    return sorted(out, key=str)


INNER = record("response", 77, b"inside").decode()
ROWS = [
    (1, "http://a/", "<p>one</p>", 0),
    (2, "http://a/\r\nWARC/1.1", "<p>one</p>", 0),
    (2, "http://a/", "<p>one</p>", 0),
    (3, None, None, 0),
    (4, "", "", 0),
    (5, "http://b/", "x\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 0),
    (6, "http://b/", INNER, 0),
    (7, "http://b/", "\r\n\r\n" + INNER + INNER + "tail", 0),
    (8, "http://b/", "\r\n\r\n\n\nWARC/1.", 0),
    (9, "http://b/", "ünï \U0001f600 \x00 " * 5000, 0),
    (None, "http://c/", "nobody", 0),
    (12, "http://c/", "late", 0),
    (11, "http://c/", "late", 0),
]


@pytest.mark.parametrize("split", ["128m", "700"])
def test_round_trip(spark, split):
    """Magic inside payloads, empty, null and repeated pages, also when a record spans many splits."""
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.page_records(warc.read_records(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((tuple(r) for r in found), key=str) == expected(ROWS)


def test_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.page_records(warc.read_records(spark, path)).count() == 0


def test_reachable_follows_the_chain_only(spark):
    links = [("a", 0, 10), ("a", 4, 10), ("a", 10, 30), ("a", 20, 30), ("a", 30, None), ("b", 0, 7), ("c", 3, 9)]
    found = warc.reachable(spark.createDataFrame(links, "file string, at bigint, to bigint")).collect()
    assert sorted(map(tuple, found)) == [("a", 0), ("a", 10), ("a", 30), ("b", 0)]
