import base64
import gzip
import hashlib
import random

import pytest

from dossierspark.llm import warc as W
from dossierspark.llm.common import scratch

SCHEMA = "page_id long, url string, html string, time string"
PAGES = [
    (5, "https://www.Example.com:443/a?b#frag", "<p>same</p>", "x"),
    (3, "http://example.com/a", "<p>same</p>", "x"),
    (9, "http://user@b.example.com", "<p>same</p>", "x"),
    (1, None, None, "x"),
    (2, "odd url\r\nX: y", "", "x"),
    (7, "http://c.org/", "é😀\r\n\r\nWARC/1.1\r\n\r\n", "x"),
    (7, "http://c.org/", "é😀\r\n\r\nWARC/1.1\r\n\r\n", "x"),
    (None, "http://d.org/", "no id", "x"),
    (8, "http://d.org/", "x" * 300_000 + "\r\n\r\n", "x"),
]


def brute(pages):
    first = {}
    for p, _, h, _ in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    copies = {}
    for _, _, h, _ in pages:
        copies[h or ""] = copies.get(h or "", 0) + 1
    out = []
    for p, _, h, _ in pages:
        data = (h or "").encode()
        again = copies[h or ""] > 1 and first.get(h or "") is not None and p != first[h or ""]
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip_and_order(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    rows = W.archive_pages(df).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute(PAGES)
    keys = [(r["url_key"], r["time"], r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys)
    assert any(r["url_key"] == "com,example)/a?b" for r in rows)


def test_many_files(spark):
    rng = random.Random(0)
    pages = [(i, f"http://h{rng.randrange(9)}.org/{rng.randrange(50)}", f"page {rng.randrange(60)}", "x") for i in range(300)]
    path = scratch(spark, "test-warc")
    W.write_archives(spark.createDataFrame(pages, SCHEMA), path, archive_bytes=60)
    runs = W.read_runs(spark, path)
    assert runs.select("run").distinct().count() > 20
    rows = W.merge_runs(runs, range_captures=40).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows], key=str) == brute(pages)
    keys = [(r["url_key"], r["time"], r["page_id"]) for r in rows]
    assert keys == sorted(keys)


def test_one_payload_of_thousands(spark):
    pages = [(i, f"http://h.org/{i}", "the error page" if i % 3 else f"own {i}", "x") for i in range(4000)]
    rows = W.archive_pages(spark.createDataFrame(pages, SCHEMA)).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute(pages)


def test_archives_are_inflated_in_pieces():
    one, two = gzip.compress(b"ab" * 300_000), gzip.compress(b"c")
    pieces = list(W._inflated(one + two, step=1000))
    assert b"".join(pieces) == b"ab" * 300_000 + b"c" and max(map(len, pieces)) <= 1000
    head = b"WARC/1.1\r\nContent-Length: "
    whole = gzip.compress(head + b"3\r\n\r\nabc\r\n\r\n") + gzip.compress(head + b"0\r\n\r\n\r\n\r\n")
    assert [b for _, b in W.records(whole)] == [b"abc", b""]
    for broken in (head + b"3\r\n\r\nab\r\n\r\n", head + b"3\r\n"):
        with pytest.raises(ValueError):
            list(W.records(gzip.compress(broken)))


def test_least_bytes(spark):
    path = scratch(spark, "test-warc")
    W.write_archives(spark.createDataFrame(PAGES, SCHEMA), path, least_bytes=12)
    kinds = {(r["page_id"], r["record_type"]) for r in W.read_runs(spark, path).collect()}
    assert (5, "response") in kinds and (9, "response") in kinds


def test_no_pages(spark):
    assert W.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 30))) for _ in range(k)]
        assert [runs[r][i] for r, i in W.LoserTree(runs)] == sorted(x for r in runs for x in r)
