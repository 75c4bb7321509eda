"""Operator 10: WARC archives with an external merge of their capture index.

Writing: payload digests find equal payloads; the page of smallest id is a response, the others are
revisits that name it. Which pages are revisits is worked out over ids and digests alone; html is shuffled
once, by page. Records are written as text files with a separator of two line ends, which is just how
WARC records end, by Spark's own writer (gzip, about ARCHIVE_BYTES of payload a file, by the sum of all
payloads), so any file system will do and a lost task is written again.

Reading back: each archive is inflated as a stream and parsed by its Content-Length fields, payloads are
digested again and compared with the record, and the captures of one archive leave as a locally sorted
run. Runs are dealt to key ranges of about RANGE_CAPTURES captures (by count), and within a range a loser
tree merges them by URL key, time and page id: the ranges in turn are the globally ordered capture
histories. A task thus holds one record of an archive and the captures of one range, whatever the size of
the whole.

Null html is the empty payload, a null url an empty one; very long payloads stay whole. A repeated page_id
with the payload's smallest id is a response each time; a null id is a revisit where the payload has
others, else a response. Equal captures are ordered by run. The capture time is a function of the id
(pages carry none). An empty table gives no archives and no rows. Other columns are left aside, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

ARCHIVE_BYTES, RANGE_CAPTURES = 16 << 20, 100_000
#: A payload that very many pages share is looked up in so many parts.
SALT = 16
CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 20 bytes given in hex: 8 letters from each 10 hex digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(4):
        value = F.conv(F.substring(hex_digest, 10 * i + 1, 10), 16, 10).cast("long")
        for k in range(8):
            at = F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1
            parts.append(F.substring(letters, at, F.lit(1)))
    return F.concat(*parts)


def revisits(payloads: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, sha, first: of pages whose payload stands under a smaller id (one row for each id and payload)."""
    able = payloads.where(F.col("bytes") >= least_bytes).select("page_id", "sha")
    equal = able.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    salted = equal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = able.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(salted, ["sha", "salt"])
    return met.where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha", "first")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages (page_id, url, html) as .gz archives under path. Payloads below least_bytes stay responses."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    payloads = written(rows.select("page_id", "sha", "bytes"), "payloads")
    total = payloads.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # fewer files than the join's own parts would only make it shuffle html again
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // archive_bytes))
    # one name for id and payload, null ids too: both sides are dealt to the archives by it
    named = lambda d: d.withColumn("place", F.xxhash64("page_id", "sha")).repartition(files, "place", "sha")
    joined = named(rows).join(named(revisits(payloads, least_bytes)).drop("page_id"), ["place", "sha"], "left")
    revisit = F.col("first").isNotNull()
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    when = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(CRLF * 2), F.when(revisit, "").otherwise(F.col("html")))
    kind = F.when(
        revisit,
        F.concat(
            F.lit("revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("first").cast("string"),
            F.lit(">"),
        ),
    ).otherwise(F.lit("response"))
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]+", "%20")),
        ("WARC-Date", when),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(body).cast("string")),
    ]
    lines = [x for name, value in head for x in (F.lit(f"{name}: "), value, F.lit(CRLF))]
    record = F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit(CRLF), body)
    joined.select(record.alias("record")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort-friendly key: host parts reversed, scheme, port 80/443, leading www and fragment dropped."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower().removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def _inflated(archive: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of at most `step` bytes."""
    member = zlib.decompressobj(31)
    for lo in range(0, len(archive), 1 << 16):
        data = archive[lo : lo + (1 << 16)]
        while data:
            yield member.decompress(data, step)
            data = member.unconsumed_tail
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(31)
    yield member.flush()


def records(archive: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record of an archive, by Content-Length; one record is held at a time."""
    pieces, held = _inflated(archive), bytearray()

    def reaches(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while reaches(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not reaches(seen + 1):
                raise ValueError("an archive ends within a record's header")
        lines = held[:end].decode("utf-8", "surrogateescape").split(CRLF)
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if not reaches(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} does not end where its length says")
        yield fields, bytes(held[start:stop])
        del held[: stop + 4]


CAPTURE = "url_key string, time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run long, place long"
_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
_KINDS = [pa.string() if c.split()[1] == "string" else pa.int64() for c in CAPTURE.split(", ")]


def _number(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return None if value == "none" else int(value)


def capture(fields: dict, block: bytes) -> tuple:
    """url_key, time, page_id, payload_bytes, payload_digest, record_type, refers_to; checks the digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rsplit(b": ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']}: payload and digest differ")
    refers = _number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return (url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], _number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers)


def read_runs(spark, path: str) -> DataFrame:
    """The captures of all archives under path; those of one archive are a sorted run."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, content in zip(batch["run"], batch["content"]):
                rows = [(*capture(f, b), run.as_py(), i) for i, (f, b) in enumerate(records(content.as_py()))]
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
                columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.xxhash64("path").alias("run"), "content").mapInArrow(parse, CAPTURE)


class LoserTree:
    """k-way merge of sorted key lists: each inner node keeps the loser of its match, the top the winner."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.k, self.tree = k, [-1] * k
        winner = list(range(-k, 0)) + list(range(k))  # by place 0..2k-1; leaves are k..2k-1
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winner[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def __iter__(self):
        """(run, number within it) in merged order."""
        while self.k and self.at[self.top] < len(self.runs[self.top]):
            now = self.top
            yield now, self.at[now]
            self.at[now] += 1
            node = (now + self.k) // 2
            while node:
                if self._before(self.tree[node], now):
                    now, self.tree[node] = self.tree[node], now
                node //= 2
            self.top = now


def merge_runs(runs: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """Globally ordered captures: parts by key range, runs merged within each."""
    key = ["url_key", "time", "page_id"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = [(u, t, p is not None, p or 0) for u, t, p in zip(*(whole[c].to_pylist() for c in key))]
        run = whole["run"].to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)]
        tree = LoserTree([keys[s:e] for s, e in zip(starts, starts[1:])])
        order = np.fromiter((starts[r] + i for r, i in tree), np.int64, len(keys))
        for lo in range(0, len(order), 20_000):
            yield from whole.take(order[lo : lo + 20_000]).to_batches()

    ranges = max(1, -(-runs.count() // range_captures))
    return runs.repartitionByRange(ranges, *key).sortWithinPartitions("run", *key).select(*_NAMES).mapInArrow(merge, CAPTURE)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, read back, merge: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, time."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    runs = written(read_runs(pages.sparkSession, path), "runs")
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "time")
