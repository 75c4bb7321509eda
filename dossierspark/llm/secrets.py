"""Operator 1: secret scan over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a table of
(blob, rule_version, findings); only pairs it has not seen are scanned, the new findings are appended,
and findings are joined back to all paths that hold the blob. The rule version is a hash of the rules,
so a changed rule scans everything anew and an unchanged one scans nothing twice.

Offsets are code points, end exclusive. Null texts count as empty; empty texts have no findings.
Repeated rows and paths each get their row. Extra columns of the input are left aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, written

#: Kinds in the order in which equal starts are listed, with pattern, the group whose
#: length counts, the least length, and whether the kind belongs to the base report.
RULES = [
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        True,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", r"[0-9a-f]+", 0, 24, True),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
]
KINDS = [r[0] for r in RULES]
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Scanner:
    """Leftmost non-overlapping matches of each kind; those whose counted group is too short are dropped."""

    def __init__(self):
        self.rules = [(k, re.compile(p), g, least, base) for k, p, g, least, base in RULES]
        # a run of hex digits below the least length is dropped anyway: one pattern for the long runs
        self.long_hex = re.compile(r"[0-9a-f]{24,}")
        self.names = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of kind, end), in order."""
        found = []
        for n, (kind, pattern, group, least, _) in enumerate(self.rules):
            if kind == "assign" and not self.names.search(text):
                continue
            if kind == "access" and "AKIA" not in text or kind == "pem" and "-----BEGIN " not in text:
                continue
            matches = self.long_hex.finditer(text) if kind == "hex" else pattern.finditer(text)
            found += [(m.start(), n, m.end()) for m in matches if m.end(group) - m.start(group) >= least]
        return sorted(found)


def spelled(found: list[tuple[int, int, int]], base_only: bool) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if RULES[k][4] or not base_only)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        rows = []
        for blob, text in zip(batch["blob"].to_pylist(), batch["text"]):
            found = scanner(text.as_py() or "")
            n = [sum(k == i for _, k, _ in found) for i in range(3)]
            base = spelled(found, True)
            rows.append((blob, RULE_VERSION, *n, hashlib.sha256(base.encode()).hexdigest(), spelled(found, False)))
        names = [c.split()[0] for c in FINDINGS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def scan_versions(versions: DataFrame, ledger: str | None = None) -> DataFrame:
    """Findings of every row of versions (path, text), by way of the ledger table at the path `ledger`.

    Without a path the ledger starts empty in a scratch folder. Blobs the ledger knows under the
    present rule version are not scanned. Returns path and the columns of FINDINGS but rule_version.
    """
    spark = versions.sparkSession
    bounded_batches(spark)
    rows = versions.select("path", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn(
        "blob", F.sha2(F.col("text").cast("binary"), 256)
    )
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        known, ledger = None, scratch(spark, "ledger")
    else:
        known = _existing(spark, ledger)
    if known is not None:
        unseen = rows.select("blob").distinct().join(known.where(F.col("rule_version") == RULE_VERSION), "blob", "left_anti")
        blobs = blobs.join(written(unseen, "unseen"), "blob", "left_semi")
    blobs.mapInArrow(_scan, FINDINGS).write.mode("append").parquet(ledger)
    findings = (
        spark.read.schema(FINDINGS)
        .parquet(ledger)
        .where((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != ""))
        .drop("rule_version")
        .dropDuplicates(["blob"])  # two runs at once may both append a blob
    )
    none = {"n_assign": F.lit(0), "n_access": F.lit(0), "n_hex": F.lit(0), "base_sha256": F.lit(EMPTY_SHA), "spans": F.lit("")}
    return rows.select("path", "blob").join(findings, "blob", "left").select(
        "path", *[F.coalesce(F.col(c), v.cast("long") if c[:2] == "n_" else v).alias(c) for c, v in none.items()], "blob"
    )


def _existing(spark, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(FINDINGS).parquet(path) if there else None


def document_secrets(docs: DataFrame) -> DataFrame:
    found = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
