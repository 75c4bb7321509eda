"""Upserts and unions over keys: whole-table recomputation in place of row locks and MERGE."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import interval_share
from ..settings import DEFAULTS
from .components import in_order, written


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Rows of either side; `updated` columns from the new row where there is one, all others stay.

    Columns that only one side has are null where that side has no row. Of new rows with equal keys the
    greatest by its other columns, in their order, counts.
    """
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else new.select(*keys).distinct()
    seen = one.withColumn("_new", F.lit(True))
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(seen.alias("n"), keys, "full_outer")

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c not in old.columns:
            return F.col(f"n.{c}")
        taken = F.col("_new").isNotNull() & (F.lit(c in updated) | F.col("_old").isNull())
        return F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    state = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return joined.select(*keys, *[pick(c).alias(c) for c in names], state.alias("state"))


def missing_and_unexpected(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    a, b = expected.select(*keys).distinct(), found.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def ordered_union(lists: list[DataFrame], keys: list[str], position: str) -> DataFrame:
    """Union of lists; each key once, at the place of its first list and position."""
    rows = None
    for i, part in enumerate(lists):
        part = part.withColumn("_list", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_list", position)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_list")


def union_sources(a: Column, b: Column) -> Column:
    """Sources of both arrays in order, one for each type and id."""
    both = F.concat(a, b)
    key = lambda s: F.struct(s["source_type"], s["source_id"])
    return F.filter(both, lambda s, i: F.array_position(F.transform(both, key), key(s)) == i + 1)


def unique_numbers(rows: DataFrame, keys: list[str], number: str, *order: Column) -> DataFrame:
    """Repeated numbers of a section get ' (2)', ' (3)' in order."""
    n = F.row_number().over(Window.partitionBy(*keys, number).orderBy(*order))
    return rows.withColumn(number, F.when(n > 1, F.concat(F.col(number), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(number)))


def overlap_join(a: DataFrame, b: DataFrame, least: float = DEFAULTS.span_overlap_min) -> DataFrame:
    """For each span of a the span of b in the same section with the largest share of the hull, at `least` or more.

    a: id, section_id, start, end; b likewise. Spans that can reach the share start within a length of
    each other, so spans meet by section and coarse start cells of their own length class, not by section alone.
    """
    def keyed(x: DataFrame, name: str, reach: int) -> DataFrame:
        size = F.greatest(F.lit(1), F.col("end") - F.col("start"))
        level = F.floor(F.log2(size)).cast("int")
        cell = F.floor(F.col("start") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
        x = x.select(F.col("id").alias(name), "section_id", F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), "start", "end")
        if not reach:
            return x.withColumn("level", level).withColumn("cell", cell)
        levels = F.sequence(F.greatest(F.lit(0), level - reach), level + reach)
        x = x.withColumn("level", F.explode(levels)).withColumn("c", cell)
        return x.withColumn("cell", F.explode(F.sequence(F.col("c") - 2, F.col("c") + 2))).drop("c")

    left, right = keyed(a, "a_id", 1).drop("start", "end"), keyed(b, "b_id", 0).drop("start", "end")
    share = interval_share(F.col("a_id_start"), F.col("a_id_end"), F.col("b_id_start"), F.col("b_id_end"))
    met = left.join(right, ["section_id", "level", "cell"]).withColumn("share", share).where(F.col("share") >= least)
    return met.groupBy("a_id").agg(F.max_by(F.struct("b_id", "share"), F.struct("share", (-F.col("b_id")).alias("i"))).alias("m")).select(
        "a_id", F.col("m.b_id").alias("b_id"), F.col("m.share").alias("share")
    )


# Columns of a requirement that people fill; a row with any of them is never deleted.
HUMAN = ["compliance_class", "compliant_by", "owner", "rated_at", "comment"]


def _matched(least: float):
    """The pairs of rows that come sorted by section, stored ones before found ones; the rows of one section that are still free are held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, by_key, free, written = None, {}, {}, set()
        for batch in batches:
            new, old, names = [], [], batch["section_id"].dictionary_encode()
            sections, last = names.dictionary.to_pylist(), -1
            columns = (pc.fill_null(names.indices, len(sections)), *(batch[c] for c in ("kind", "id", "key", "start", "end")))
            for section, kind, i, key, start, end in zip(*(c.to_pylist() for c in columns)):
                if section != last:
                    last, name = section, sections[section] if section < len(sections) else None
                    if name != now:
                        now = name
                        by_key.clear(), free.clear(), written.clear()
                if kind == 0:
                    free[i] = (start, end, key)
                    by_key[key] = i
                    continue
                if key in written:
                    continue
                written.add(key)
                fits = by_key.get(key)
                if fits is None and free and start is not None and end is not None:
                    fits = _nearest(free, start, end, least)
                if fits is not None:
                    by_key.pop(free.pop(fits)[2], None)
                new.append(i)
                old.append(fits)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array(old, pa.int64())], ["new_id", "old_id"])

    return fold


def _nearest(free: dict[int, tuple], start: int, end: int, least: float) -> int | None:
    """The free row with the largest share of the hull, at `least` or more (ties: the smaller id)."""
    best, at = 0.0, None
    for i, (a, b, _) in free.items():
        if a is not None and b is not None:
            share = _share(a, b, start, end)
            if at is None or share > best or share == best and i < at:
                best, at = share, i
    return at if best >= least else None


def _share(a: int, b: int, c: int, d: int) -> float:
    hull = max(b, d) - min(a, c)
    return max(0, min(b, d) - max(a, c)) / hull if hull > 0 else 0.0


def match_requirements(old: DataFrame, new: DataFrame, least: float = DEFAULTS.span_overlap_min) -> DataFrame:
    """new_id, old_id (null: none fits) of what a run found; what repeats a key of this run is left out.

    In the order of `position` each takes the stored row of its key, else the free one of its section with the
    largest share of the hull, at `least` or more (ties: the smaller id). A row taken by another is no longer found by
    its key. Keys begin with their section, so sections are independent; their rows are sorted
    and folded by batches. old: old_id, section_id, key, start, end; new: new_id likewise plus position.
    """
    rows = old.select("section_id", F.lit(0).alias("kind"), F.col("old_id").alias("position"), F.col("old_id").alias("id"), "key", "start", "end").union(
        new.select("section_id", F.lit(1), "position", "new_id", "key", "start", "end")
    )
    return in_order(rows, ["section_id"], "kind", "position").mapInArrow(_matched(least), "new_id long, old_id long")


def merge_requirements(stored: DataFrame, found: DataFrame, covered: DataFrame) -> DataFrame:
    """The requirements after a run, with state (created, updated, kept, deleted) and order_index.

    stored: requirement_id, tender_id, section_id, key, start, end, the columns of HUMAN and any others. found:
    new_id, tender_id, position, section_id, key, start, end and any others; its columns replace those of the row it
    fits, requirement_id and the human ones stay. Rows that nothing fits are deleted where their section is in
    covered (section_id) and no person has worked on them, else kept. order_index numbers what the run wrote, in its
    order. Created rows have no requirement_id yet.
    """
    spans = ["section_id", "key", "start", "end"]
    pairs = written(match_requirements(stored.select(F.col("requirement_id").alias("old_id"), *spans), found.select("new_id", "position", *spans)), "requirement-pairs")
    rest = [c for c in found.columns if c not in ("new_id", "position", *HUMAN)]
    human = stored.select(F.col("requirement_id").alias("old_id"), *HUMAN)
    at = F.row_number().over(Window.partitionBy("tender_id").orderBy("position", "new_id")) - 1
    wrote = pairs.join(found.drop(*HUMAN), "new_id").join(human, "old_id", "left").select(
        F.col("old_id").alias("requirement_id"), *rest, *HUMAN, at.alias("order_index"), F.when(F.col("old_id").isNull(), "created").otherwise("updated").alias("state")
    )
    touched = F.lit(False)
    for c in HUMAN:
        touched = touched | (F.col(c).isNotNull() if c != "comment" else F.coalesce(F.col(c), F.lit("")) != "")
    left = stored.join(pairs.where("old_id is not null").select(F.col("old_id").alias("requirement_id")), "requirement_id", "left_anti")
    left = left.join(covered.select("section_id").distinct().withColumn("_covered", F.lit(True)), "section_id", "left")
    gone = F.coalesce("_covered", F.lit(False)) & ~touched
    others = left.withColumn("state", F.when(gone, "deleted").otherwise("kept")).drop("_covered")
    return wrote.unionByName(others, allowMissingColumns=True)


def write_once(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of documents that have none stored yet."""
    return new.join(stored.select(key).distinct(), key, "left_anti")
