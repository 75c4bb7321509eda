"""Merkle manifest of a table of documents: levels by windows, proofs, checks against tampering.

A leaf hashes one row; leaves of a language stand in order of doc_id, every two nodes have a parent, and the
languages' roots are the leaves of a last tree over them. `manifest` numbers the leaves over a range-partitioned
table (no language is ever in one task) and builds levels in tiers: a tier puts blocks of 2**TIER neighbours
together in one shuffle, and each of its levels is a window by group, block and parent index whose ordered
full-frame ``collect_list`` is both the parent's preimage and the list of siblings. A parent's hash stays in the
first row of its run alone (the list skips the others' nulls), so parents are met once on the next level; between
tiers, one row for each block is left.

Nulls: a null column is ``-`` in the leaf; a null lang is a language of its own, the first; null doc_ids come first
and are never tampered with. Empty texts are ``0:``, unlike null ones; texts of any length are hashed as wholes.
Ties: rows of equal doc_id stand in order of their leaves. Repeated rows are leaves of their own. An empty
table has no rows and no root. Other columns of documents, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Levels of one tier: a block of 2**TIER neighbours is built without a shuffle between its levels.
TIER = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with idx, the place within the group by `order` from 0, and n, the group's size.

    Rows are cut into ranges of (group, order, file place), so equal rows are spread as well; each range's
    count by group gives the places of its first rows. rows is a written table, as its places must not change.
    """
    placed = written(
        rows.withColumn("at", F.monotonically_increasing_id())
        .repartitionByRange(group, *order, "at")
        .sortWithinPartitions(group, *order, "at")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33)),
        "merkle-order",
    )
    parts = placed.groupBy("part", group).agg(F.min("at").alias("low"), F.count("*").alias("size"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part", group, (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("size").over(whole).alias("n")
    )
    return placed.join(parts, ["part", group]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _halved(n: Column, k: int) -> Column:
    """ceil(n / 2**k): nodes that a group has on level k."""
    return F.shiftright(n + ((1 << k) - 1), k)


def _tier(nodes: DataFrame) -> DataFrame:
    """nodes (grp, idx, n, node) with path, the siblings of TIER levels at most, and top, the block's node (first row alone).

    A path has one entry for each level that the group has, '' where a node is alone in its run.
    """
    kept = [*nodes.columns, "block"]
    now = nodes.selectExpr("*", f"shiftright(idx, {TIER}) as block", "node as top").repartition("grp", "block")
    for k in range(TIER):
        there, odd, first = f"shiftright(n + {(1 << k) - 1}, {k}) > 1", f"(shiftright(idx, {k}) & 1) = 1", f"(idx & {(2 << k) - 1}) = 0"
        frame = f"partition by grp, block, shiftright(idx, {k + 1}) order by idx rows between unbounded preceding and unbounded following"
        now = now.selectExpr(*kept, f"collect_list(top) over ({frame}) as run").selectExpr(
            *kept,
            f"case when {there} then case when {odd} then run[0] else coalesce(get(run, 1), '') end end as p{k}",
            f"case when {first} then case when {there} then sha2(concat_ws('', run), 256) else run[0] end end as top",
        )
        kept.append(f"p{k}")
    return now.select(*nodes.columns, "block", F.expr(f"array_compact(array({', '.join(kept[-TIER:])}))").alias("path"), "top")


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with path, roots (grp, root)) of leaves (grp, idx, n, node, ...); one written table for each tier."""
    tiers, nodes, roots = [], leaves, None
    while True:
        done = written(_tier(nodes), "merkle-tier")
        tiers.append(done)
        heads = done.where(F.col("top").isNotNull()).select("grp", F.col("block").alias("idx"), _halved(F.col("n"), TIER).alias("n"), F.col("top").alias("node"))
        ended = heads.where("n = 1").select("grp", F.col("node").alias("root"))
        roots = ended if roots is None else roots.union(ended)
        nodes = heads.where("n > 1")
        if nodes.isEmpty():
            break
    above = None
    for done in reversed(tiers):
        if above is not None:
            upper = above.select("grp", F.col("idx").alias("block"), F.col("path").alias("rest"))
            done = done.join(upper, ["grp", "block"], "left").withColumn("path", F.concat("path", F.coalesce("rest", F.array().cast("array<string>")))).drop("rest")
        above = done
    return above.drop("block", "top"), roots


def folded(node: Column, path: Column, idx: Column) -> Column:
    """The root that a node and the siblings of its path give."""
    steps = F.transform(path, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    return F.aggregate(
        steps,
        node,
        lambda acc, x: F.sha2(
            F.when(F.call_function("shiftright", idx, x["k"]).bitwiseAND(F.lit(1)) == 1, F.concat(x["s"], acc)).otherwise(F.concat(acc, x["s"])), 256
        ),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and lang, leaf_number, n_leaves."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    leaves = written(
        docs.select(*FIELDS).select(
            "doc_id",
            F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("grp"),
            leaf(F.col("n_chars")).alias("node"),
            F.when(crc % 7 == 0, leaf(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("forged"),
        ),
        "merkle-leaves",
    )
    below, subroots = tree(numbered(leaves, "grp", "doc_id", "node"))
    tops = written(subroots.select(F.lit("").alias("all"), "grp", "root"), "merkle-subroots")
    tops = numbered(tops, "all", "grp").select(F.col("all").alias("grp"), F.col("grp").alias("lang"), "idx", "n", F.col("root").alias("node"))
    upper, root = tree(tops)
    upper = upper.join(root, "grp").select(F.col("lang").alias("grp"), F.col("node").alias("subroot"), F.col("idx").alias("lang_idx"), F.col("path").alias("lang_path"), "root")
    found = below.join(upper, "grp").withColumn("again", folded(folded(F.coalesce("forged", "node"), F.col("path"), F.col("idx")), F.col("lang_path"), F.col("lang_idx")))
    return found.select(
        "doc_id",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.concat(F.array_join("path", ""), F.array_join("lang_path", "")), 256).alias("proof_sha256"),
        F.col("again").alias("folded_root"),
        (F.col("again") == F.col("root")).alias("verified"),
        F.when(F.col("grp") != "0", F.expr("substring(grp, 2)")).alias("lang"),
        F.col("idx").alias("leaf_number"),
        F.col("n").alias("n_leaves"),
    )
