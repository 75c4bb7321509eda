"""Blocks of documents to ordered sections, by windows and aggregation alone.

A block is a row: document_id, pos, kind (heading, sheet, paragraph, row), level, text, table_index,
row_number, cells. Headings nest by level: one stands above a block if it is the last of its level and
no heading of a lower level has come since. A sheet's name heads its rows and is no prose. Prose under one heading is one section, tables or not
between its paragraphs; each data row of a table is a section of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_lines, collapse

LEVELS = 9
BLOCK = "document_id long, pos int, kind string, level int, text string, table_index int, row_number int, cells array<string>, cell_ref string"


def text_blocks(files: DataFrame) -> DataFrame:
    """Plain text or Markdown (document_id, text): # headings, paragraphs parted by blank lines."""
    lines = files.select("document_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))
    heading = F.regexp_extract("line", r"^(#{1,6})\s+(.*?)\s*#*\s*$", 1)
    lines = lines.withColumn("level", F.length(heading)).withColumn("blank", F.trim("line") == "")
    w = Window.partitionBy("document_id").orderBy("pos")
    cuts = F.sum(((F.col("level") > 0) | F.col("blank") | (F.coalesce(F.lag("level").over(w), F.lit(0)) > 0)).cast("int")).over(w)
    kept = lines.withColumn("part", cuts).where("not blank")
    text = F.when(F.first("level") > 0, F.regexp_extract(F.first("line"), r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)).otherwise(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: F.rtrim(x["line"])), "\n")
    )
    grouped = kept.groupBy("document_id", "part").agg(F.min("pos").alias("pos"), F.first("level").alias("level"), text.alias("text"))
    none = lambda t: F.lit(None).cast(t)
    return grouped.select(
        "document_id",
        "pos",
        F.when(F.col("level") > 0, "heading").otherwise("paragraph").alias("kind"),
        F.nullif("level", F.lit(0)).alias("level"),
        "text",
        none("int").alias("table_index"),
        none("int").alias("row_number"),
        none("array<string>").alias("cells"),
        none("string").alias("cell_ref"),
    )


def sections(blocks: DataFrame) -> DataFrame:
    """document_id, order_index, heading_path, table_index, cell_ref, text."""
    w = Window.partitionBy("document_id").orderBy("pos")
    heading = F.col("kind").isin("heading", "sheet")
    b = blocks.withColumn("text", F.when(heading, collapse(F.col("text"))).otherwise(F.trim(clean_lines(F.col("text")))))
    b = b.where((F.col("kind") == "row") | (F.coalesce("text", F.lit("")) != ""))
    last = {k: F.last(F.when(heading & (F.col("level") == k), F.struct("pos", "text")), True).over(w) for k in range(1, LEVELS + 1)}
    b = b.withColumns({f"_h{k}": c for k, c in last.items()} | {"heading_no": F.sum(heading.cast("int")).over(w)})
    stack = []
    for k in range(1, LEVELS + 1):
        lower = [F.col(f"_h{j}.pos") for j in range(1, k)]
        floor = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(x, F.lit(-1)) for x in lower])
        stack.append(F.when(F.col(f"_h{k}.pos") > floor, F.col(f"_h{k}.text")))
    b = b.withColumn("path", F.array_compact(F.array(*stack))).drop(*[f"_h{k}" for k in last])

    prose = (
        b.where("kind not in ('row', 'sheet')")
        .groupBy("document_id", "heading_no")
        .agg(F.min("pos").alias("pos"), F.min_by("path", "pos").alias("heading_path"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("lines"))
        .select("document_id", "pos", "heading_path", F.lit(None).cast("int").alias("table_index"), F.lit(None).cast("string").alias("cell_ref"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
    )
    cells = F.transform("cells", lambda c: F.replace(F.trim(clean_lines(F.coalesce(c, F.lit("")))), F.lit("\n"), F.lit(" ")))
    filled = F.size(F.filter(F.transform(cells, lambda c, i: F.when(c != "", i + 1)), lambda i: i.isNotNull()))
    rows = b.where("kind = 'row'").withColumn("cells", cells).where(filled > 0)
    ends = F.array_max(F.transform("cells", lambda c, i: F.when(c != "", i + 1)))
    rows = rows.withColumn("cells", F.slice("cells", 1, ends))
    t = Window.partitionBy("document_id", "table_index")
    rows = rows.withColumn("first", F.min("row_number").over(t)).withColumn("n", F.count("*").over(t))
    head = F.first("cells").over(t.orderBy("row_number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("head", F.when(F.col("n") > 1, head).otherwise(F.array().cast("array<string>"))).where("n = 1 or row_number > first")
    ref = F.coalesce("cell_ref", F.concat(F.lit("T"), F.col("table_index").cast("string"), F.lit(":R"), F.col("row_number").cast("string")))
    data = rows.select("document_id", "pos", F.concat("path", "head").alias("heading_path"), "table_index", ref.alias("cell_ref"), F.array_join("cells", " | ").alias("text"))
    both = prose.unionByName(data).where("trim(text) <> ''")
    return both.withColumn("order_index", F.row_number().over(w) - 1).select("document_id", "order_index", "heading_path", "table_index", "cell_ref", "text")
