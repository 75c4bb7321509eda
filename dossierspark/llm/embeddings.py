"""Operator 8: near-duplicate embeddings within cells of a spherical k-means.

1. Equal vectors of one label are one class with a count, so a vector that millions share is one row.
2. Centroids are fitted on a bounded sample of classes (SAMPLE_ROWS, smallest hash of the vector).
   Their number follows the number of classes: one for about CELL_ROWS, CENTROIDS at most.
3. A class is owned by the cell of its nearest centroid and visits every cell whose centroid is within a
   margin of it. The margin is measured on the sample for these centroids: it covers the share COVERED of
   partners that lie as far off as a link allows, in directions that the data take.
4. In a cell owners are compared with owners and visitors; a pair that two cells see counts in the one of
   smaller number. Every row is indexed; pairs that meet in no cell are the method's only loss (recall is
   measured against brute force in the tests, by number of cells).
5. Cells are split into blocks of BLOCK_ROWS; each pair of blocks with owners is a matrix product of its
   own, in double precision. What leaves a task is a count of links by class and a spanning star of each
   part; counts, components and smallest ids are worked out by class before rows are joined to them.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do
rows without a label. Vectors of different lengths never link. Components of any finite size count: a
vector is scaled by its largest one first. Repeated vec_ids are rows of their own, and a null one never is
the smallest of others. An empty table gives an empty one; other columns are left aside, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, bounded_batches, connected_components, sorted_groups, written

SAMPLE_ROWS, CELL_ROWS, CENTROIDS, ROUNDS = 20_000, 4096, 1024, 8
COVERED, PROBES = 0.98, 4096
BLOCK_ROWS = 2048


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever the size of their components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit rows; an empty cell takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        cos = x @ c.T
        near = cos.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        far = np.argsort(cos[np.arange(len(x)), near])
        for i, j in zip(np.flatnonzero(norm < 1e-9), far):
            sums[i], norm[i] = x[j], 1.0
        c = sums / norm[:, None]
    return c


def fit_margin(x: np.ndarray, c: np.ndarray, least: float, seed: int = 5) -> float:
    """How far behind its nearest centroid a visited one may lie, so that COVERED of the farthest partners meet.

    Partners are made of sample rows at the cosine `least`, off in the direction of another row or of
    noise, whichever asks for more.
    """
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:PROBES]]
    rows, out = np.arange(len(x)), 0.0
    for off in (x[rng.permutation(len(x))], rng.normal(size=x.shape)):
        off = off - (off * x).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(off, axis=1, keepdims=True)
        y = least * x + np.sqrt(1 - least * least) * off / np.where(norm > 1e-9, norm, 1.0)
        a, b = x @ c.T, y @ c.T
        gap = np.minimum(b.max(axis=1) - b[rows, a.argmax(axis=1)], a.max(axis=1) - a[rows, b.argmax(axis=1)])
        out = max(out, float(np.quantile(gap, COVERED)))
    return out


def _prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, grp (label and length), v as stored, and whether the row may link."""
    kind = "float" if embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: (x + 0.0).cast(kind)).alias("v")
    )
    rows = rows.withColumn("grp", F.concat(F.size("v").cast("string"), F.lit(":"), "label"))
    return rows.withColumn("good", F.coalesce(F.col("grp").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def near_duplicates(embeddings: DataFrame, least: float = 0.93, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept. margin: None to measure it on the sample."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = _prepared(embeddings)
    # a class: one vector of one label; its name is a hash of both, its row the smallest vec_id
    named = rows.where("good").select("vec_id", F.xxhash64("grp", "v").alias("name"), "grp", "v")
    classes = written(
        named.groupBy("name").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("grp").alias("grp"), F.first("v").alias("v")), "classes"
    )
    n = classes.count()
    sample = classes.orderBy("name").limit(SAMPLE_ROWS).select("v").toArrow()["v"].to_pylist() if n else []
    width = max(map(len, sample), default=0)
    sample = [v for v in sample if len(v) == width]
    k = min(CENTROIDS, max(1, -(-n // CELL_ROWS)))
    centroids = np.zeros((1, width))
    if sample:
        x = unit(np.array(sample, np.float64).reshape(len(sample), width))
        centroids = fit_centroids(x, k)
        margin = fit_margin(x, centroids, least) if margin is None else margin
    shared = spark.sparkContext.broadcast((centroids, margin or 0.0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The owner and the visited cells of each class; vectors of another length than the sample's go to cell 0."""
        c, within = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                batch = whole.slice(lo, 2048)
                values = batch["v"].flatten().to_numpy(zero_copy_only=False)
                stops = np.r_[0, np.cumsum(batch["v"].value_lengths().to_numpy())]
                data = [values[s:e].tobytes() for s, e in zip(stops, stops[1:])]
                fits = np.flatnonzero(np.diff(stops) == c.shape[1])
                owner, cells = np.zeros(len(batch), np.int32), [[0]] * len(batch)
                if len(fits):
                    cos = unit(np.array([values[stops[i] : stops[i + 1]] for i in fits], np.float64)) @ c.T
                    owner[fits] = cos.argmax(axis=1)
                    for i, near in zip(fits.tolist(), cos >= cos.max(axis=1, keepdims=True) - within):
                        cells[i] = np.flatnonzero(near).tolist()
                columns = [batch["name"], batch["m"], batch["grp"], pa.array(data, pa.binary()), pa.array(owner), pa.array(cells, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "m", "grp", "v", "owner", "cells"])

    placed = classes.select("name", "m", "grp", "v").mapInArrow(assign, "name long, m long, grp string, v binary, owner int, cells array<int>")
    in_cell = placed.withColumn("cell", F.explode("cells"))
    sizes = in_cell.groupBy("grp", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    work = (
        in_cell.join(F.broadcast(sizes) if k == 1 else sizes, ["grp", "cell"])
        .withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .repartition("grp", "cell", "lo", "hi")
        .sortWithinPartitions("grp", "cell", "lo", "hi", "block", "name")
        .select("grp", "cell", "lo", "hi", "block", "name", "m", "v", "owner", "cells")
    )
    kind = np.dtype(np.float32 if dict(classes.dtypes)["v"] == "array<float>" else np.float64)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in sorted_groups(batches, ["grp", "cell", "lo", "hi"]):
            out = _compare(cell, kind, least)
            if len(out):
                yield out

    pairs = written(work.mapInPandas(compare, "a long, b long, links long"), "pairs")
    counted = pairs.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))
    parts = connected_components(pairs.where("b is not null").select("a", "b"), "cells").select(F.col("node").alias("name"), "root")
    by_root = classes.select("name", "least").join(parts, "name")
    roots = by_root.groupBy("root").agg(F.min("least").alias("smallest"))
    smallest = by_root.select("name", "root").join(roots, "root").select("name", "smallest")
    by_class = (
        classes.select("name", "m", "least")
        .join(counted, "name", "left")
        .join(smallest, "name", "left")
        .select("name", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    )
    linked = named.select("vec_id", "name").join(by_class, "name").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(work: pd.DataFrame, kind: np.dtype, least: float) -> pd.DataFrame:
    """Links of one cell of work: rows (a, null, links) count, rows (a, b, null) connect."""
    names, m, cell = work["name"].to_numpy(), work["m"].to_numpy(), int(work["cell"].iloc[0])
    owner, block = work["owner"].to_numpy(), work["block"].to_numpy()
    x = unit(np.frombuffer(b"".join(work["v"]), kind).reshape(len(work), -1).astype(np.float64))
    across = work["lo"].iloc[0] != work["hi"].iloc[0]
    forest, links = Forest(len(x)), np.zeros(len(x), np.int64)
    # which cells each row visits, as sorted codes
    n_cells = 1 + max(map(max, work["cells"]))
    visits = np.sort(np.concatenate([i * n_cells + np.asarray(c, np.int64) for i, c in enumerate(work["cells"])]))
    own = np.flatnonzero(owner == cell)
    for lo in range(0, len(own), 512):
        rows = own[lo : lo + 512]
        p, q = np.nonzero(x[rows] @ x.T >= least)
        p = rows[p]
        # owners meet each other once, in order; blocks meet the other block only
        keep = (block[p] != block[q]) if across else (p != q)
        keep &= (owner[q] != cell) | (p < q)
        p, q = p[keep], q[keep]
        # a visitor's own cell sees the pair as well if the owner visits it: the smaller cell counts it
        code = p * n_cells + owner[q]
        seen = visits[np.minimum(np.searchsorted(visits, code), len(visits) - 1)] == code
        keep = (owner[q] == cell) | (owner[q] > cell) | ~seen
        p, q = p[keep], q[keep]
        np.add.at(links, p, m[q])
        np.add.at(links, q, m[p])
        for i in np.unique(p):
            forest.join(int(i), q[p == i])
    at, tree = np.flatnonzero(links), forest.tree()
    return pd.DataFrame(
        {
            "a": np.r_[names[at], names[tree[:, 0]]],
            "b": pd.array([None] * len(at) + names[tree[:, 1]].tolist(), "Int64"),
            "links": pd.array(links[at].tolist() + [None] * len(tree), "Int64"),
        }
    )
