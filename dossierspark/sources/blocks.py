"""Files to blocks (see operators.sections): HTML, docx, xlsx by small readers, text by Spark itself."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sections import BLOCK, text_blocks

_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


class _Html(HTMLParser):
    """Headings, paragraphs and table rows in order; scripts, styles and navigation are passed over.

    A head without an end tag ends at the body's first tag, other open elements with the one around them.
    """

    SKIP = {"script", "style", "nav", "head", "noscript"}
    HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    BREAK = {"p", "div", "li", "section", "article", "br", "ul", "ol", "td", "th", "body", "footer", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.open, self.level = [], [], [], 0
        self.tables, self.row, self.row_number = 0, None, 0

    @property
    def skip(self):
        return not self.SKIP.isdisjoint(self.open)

    def flush(self):
        text, self.text = re.sub(r"\s+", " ", "".join(self.text)).strip(), []
        if text:
            self.blocks.append({"kind": "heading", "level": self.level, "text": text} if self.level else {"kind": "paragraph", "text": text})

    def handle_starttag(self, tag, attrs):
        if "head" in self.open and tag not in self.HEAD and (tag == "body" or "noscript" not in self.open):
            del self.open[self.open.index("head") :]
        while tag == "nav" and self.open and self.open[-1] == "p":  # a paragraph holds no nav
            self.open.pop()
        if tag not in self.VOID and not (tag in ("p", "li", "tr", "td", "th") and self.open[-1:] == [tag]):  # it ends the one before
            self.open.append(tag)
        if tag in self.SKIP:
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = int(tag[1])
        elif tag == "table":
            self.flush()
            self.tables, self.row_number = self.tables + 1, 0
        elif tag == "tr":
            self.row, self.row_number = [], self.row_number + 1
        elif tag in ("td", "th") and self.row is not None:
            self.text = []
        elif tag in self.BREAK and self.row is None:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag in self.SKIP:
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = 0
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("".join(self.text).strip())
            self.text = []
        elif tag == "tr" and self.row is not None:
            self.blocks.append({"kind": "row", "table_index": self.tables, "row_number": self.row_number, "cells": self.row})
            self.row = None
        elif tag in self.BREAK and self.row is None:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_blocks_of(html: str | None) -> list[dict]:
    parser = _Html()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_blocks_of(data: bytes) -> list[dict]:
    """Body order: headings by style (Heading n, Title) or outline level, paragraphs, table rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, tables = [], 0
    said = lambda e: "".join("\n" if t.tag == f"{_W}br" else t.text or "" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}br"))
    for e in body:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            outline = e.find(f"{_W}pPr/{_W}outlineLvl")
            name = style.get(f"{_W}val", "") if style is not None else ""
            m = re.fullmatch(r"[Hh]eading ?(\d)", name)
            level = int(m[1]) if m else 1 if name == "Title" else int(outline.get(f"{_W}val")) + 1 if outline is not None else 0
            out.append({"kind": "heading", "level": level, "text": said(e)} if 0 < level < 10 else {"kind": "paragraph", "text": said(e)})
        elif e.tag == f"{_W}tbl":
            tables += 1
            for i, row in enumerate(e.findall(f"{_W}tr"), 1):
                cells = ["\n".join(said(p) for p in c.findall(f"{_W}p")) for c in row.findall(f"{_W}tc") if c.find(f"{_W}tcPr/{_W}vMerge") is None or c.find(f"{_W}tcPr/{_W}vMerge").get(f"{_W}val") == "restart"]
                out.append({"kind": "row", "table_index": tables, "row_number": i, "cells": cells})
    return out


def xlsx_blocks_of(data: bytes) -> list[dict]:
    """A heading for each sheet, then its rows; whole numbers without a fraction."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        out = []
        for k, title in enumerate(sheets, 1):
            out.append({"kind": "sheet", "level": 1, "text": title})
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row"):
                cells = []
                for c in row.findall(f"{_S}c"):
                    letters = re.match("[A-Z]+", c.get("r", "")) or re.match("A", "A")
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v = c.find(f"{_S}v")
                    value = shared[int(v.text)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells.append(re.sub(r"^(-?\d+)\.0+$", r"\1", value) if c.get("t") in (None, "n") else value)
                n = int(row.get("r") or len(cells))
                out.append({"kind": "row", "table_index": k, "row_number": n, "cells": cells, "cell_ref": f"{title}!{n}"})
    return out


READERS = {"docx": docx_blocks_of, "xlsx": xlsx_blocks_of, "xlsm": xlsx_blocks_of}


#: Blocks of a batch that leaves a task at once, more or less.
ROWS = 4096
_KINDS = {"document_id": pa.int64(), "cells": pa.list_(pa.string()), **dict.fromkeys(("pos", "level", "table_index", "row_number"), pa.int32())}
_SCHEMA = pa.schema([(c, _KINDS.get(c, pa.string())) for c in [*_NAMES, "problem"]])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], f.type) for c, f in zip(_SCHEMA.names, _SCHEMA)], schema=_SCHEMA)


def _parsed(files: Iterator[tuple[int, Callable[[], list[dict]]]]) -> Iterator[pa.RecordBatch]:
    """Blocks of files (id and reader), many files a batch; one row with a problem for a file that can't be read."""
    rows: list[dict] = []
    for document_id, read in files:
        try:
            rows += [{"document_id": document_id, "pos": i, **b} for i, b in enumerate(read())]
        except Exception as e:  # noqa: BLE001  a file may be broken in any way; the others go on
            rows.append({"document_id": document_id, "problem": f"unreadable: {type(e).__name__}"})
        if len(rows) >= ROWS:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages (document_id, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = ((i, partial(html_blocks_of, h)) for b in batches for i, h in zip(b["document_id"].to_pylist(), b["html"].to_pylist()))
        yield from _parsed(pages)

    return pages.select("document_id", "html").mapInArrow(read, f"{BLOCK}, problem string").where("problem is null").drop("problem")


def office_blocks(files: DataFrame) -> DataFrame:
    """Blocks of docx and xlsx files (document_id, suffix, content), and problem; a broken file has one row, with its problem alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, k) for b in batches for k in range(len(b)))
        yield from _parsed((b["document_id"][k].as_py(), partial(READERS[b["suffix"][k].as_py()], b["content"][k].as_py())) for b, k in rows)

    return files.select("document_id", "suffix", "content").mapInArrow(read, f"{BLOCK}, problem string")


#: Suffixes that are read as plain text.
TEXTS = ("txt", "md")


def read_files(spark: SparkSession, path: str, most_bytes: int = 25 << 20) -> DataFrame:
    """document_id (hash of the path), path, suffix, content, sha256 and problem of every file.

    Files of more than `most_bytes` and unknown suffixes keep no content (the scan does not open them), empty ones
    have none; their problem says why. Spark's scans pass empty files over, so these are what is in the scan's
    own list of files, which the driver holds anyway, and not among its rows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = [F.xxhash64("path").alias("document_id"), "path", suffix.alias("suffix")]
    known = suffix.isin(*READERS, *TEXTS)
    problem = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large").when(~known, "unknown_type")
    good = found.where(f"length > 0 and length <= {most_bytes}").where(known)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in found.inputFiles()], "path string")
    empty = listed.join(found.select("path"), "path", "left_anti").withColumn("length", F.lit(0).cast("long"))
    bad = found.select("path", "length").where(problem.isNotNull()).union(empty)
    none = F.lit(None)
    return good.select(*named, "content", F.sha2("content", 256).alias("sha256"), none.cast("string").alias("problem")).union(
        bad.select(*named, none.cast("binary"), none.cast("string"), problem)
    )


def parsed_files(files: DataFrame) -> DataFrame:
    """Blocks of all known kinds (docx, xlsx, xlsm, txt, md), and one row with a problem for each file without any."""
    good = files.where("problem is null")
    texts = good.where(F.col("suffix").isin(*TEXTS)).select("document_id", F.decode("content", "UTF-8").alias("text"))
    bad = files.where("problem is not null").select("document_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in BLOCK.split(", ")[1:])], "problem")
    none = F.lit(None).cast("string").alias("problem")
    return office_blocks(good.where(F.col("suffix").isin(*READERS))).unionByName(text_blocks(texts).withColumn("problem", none)).unionByName(bad)


def file_blocks(files: DataFrame) -> DataFrame:
    """The blocks of parsed_files() alone."""
    return parsed_files(files).where("problem is null").drop("problem")


def file_problems(files: DataFrame) -> DataFrame:
    """document_id, problem: empty, too_large, unknown_type, or unreadable with the kind of error."""
    return parsed_files(files).where("problem is not null").select("document_id", "problem")


def read_json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows that could not be read (kept as problems)."""
    # parsed from text: the corrupt column alone can't be read straight from a JSON file
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r")
    rows = spark.read.text(path).where("trim(value) <> ''").select(row).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")
