"""What several operators of this subpackage share: written intermediates and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.session import new_path, shared_dir  # noqa: F401  the operators of this subpackage take both from here

#: White space as the word rules of this subpackage see it: space, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a batch that goes to Python where the rows hold whole texts.
TEXT_ROWS = 1000


def written(df: DataFrame, name: str = "step", rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that lost executors cost no recomputation.

    rows: number of rows of a batch that goes to Python, while df is written; it bounds the memory of whole texts.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = new_path(spark, name), spark.conf.get(key)
    if rows:
        spark.conf.set(key, rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if rows:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: A side with at most this many rows of a few longs each (under 64 MB) may be sent to all tasks; a larger one is joined by shuffle.
SENT_ROWS = 2_000_000


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS, weight: Column | None = None) -> DataFrame:
    """A broadcast hint for a written table whose rows, or the sum of whose weights, were counted, and beyond the bound one
    for a shuffle join: Spark goes by the size of the files, which are compressed, and might send the table all the same."""
    counted = df.limit(rows + 1).count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if counted <= rows else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A hint for a shuffle join, for a side whose size Spark takes to be too small, as after an explode, which it does not count."""
    return df.hint("merge")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal a small written table out over as many tasks as a shuffle has, before each row becomes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def values(column) -> Iterator:
    """The values of an Arrow column one by one; only a few hundred at a time are Python objects."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def lists(column) -> Iterator[np.ndarray]:
    """The lists of numbers of an Arrow column one by one, without a copy."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (flat[lo:hi] for lo, hi in zip(offsets, offsets[1:]))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (f"_{name}{n or ''}" for n in range(len(taken) + 1)) if x not in taken) for name in names]


def _edge_state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1)).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: pairs of longs; self-links, repeats and nulls are dropped. Returns (node, comp), one row for each node
    that has a link, comp being the smallest node that can be reached. Every round writes its links to the shared
    folder and removes those of the round before. Only two numbers a round reach the driver.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    path = new_path(spark, "links")
    pairs.write.option("compression", "zstd").parquet(path)
    current = spark.read.schema("u long, v long").parquet(path)
    state = _edge_state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joinable = shuffled if state[0] > SENT_ROWS // 8 else lambda df: df
        low = joinable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = joinable(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = new_path(spark, "links")
        small.write.option("compression", "zstd").parquet(after)
        remove(spark, path)
        path, current = after, spark.read.schema("u long, v long").parquet(after)
        new_state = _edge_state(current)
        if new_state == state:
            break
        state = new_state
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return leaves.unionByName(roots)
