"""Connected components of an edge table, in alternating star rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only by one JVM on one machine (tests) whose session names no shared folder.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared checkpoint folder of the session, else under its warehouse."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        one_machine = conf.get("spark.master", "").split("[")[0] == "local"
        base = LOCAL_SCRATCH if one_machine else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in shared storage and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return spark.read.schema(nullable).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least; a table of that many splits stays as it is.

    For tables of long texts before work on each row: a file of one row group would be the work of one task.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def in_order(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """df with the rows of equal keys in one partition, side by side and in order: for functions over batches that carry state."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node it reaches.

    Columns a and b are longs; loops and null ends are ignored. Each round is one written table, so a
    lost executor costs one round; rounds end when the edges no longer change.
    """
    spark = edges.sparkSession
    now = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    path, old, before = scratch(spark, tag), None, None
    now.write.parquet(path)
    while True:
        now = spark.read.schema("u long, v long").parquet(path)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if old is not None:
            remove(spark, old)
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        before, old, path = mark, path, scratch(spark, tag)
        _small_star(_large_star(now)).write.parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
