"""The canonical tables, made from the test tables events and embeddings.

A day of the month is a reach, (reach - 1) % 3 its stimulus, a quarter of an hour a row, user_id % cells a cell. The
mapping exercises the operators; it says nothing about neurons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, REACHES, STEP_S = 96, 30, 900


def events(spark: SparkSession, sf_dir: str, cells: int = 8) -> DataFrame:
    """session, stim, reach, t, cell, value of every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "value")
    reach, second = F.dayofmonth("ts"), F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return e.select(F.lit("events").alias("session"), ((reach - 1) % 3).cast("int").alias("stim"), reach.cast("int").alias("reach"), F.floor(second / STEP_S).cast("int").alias("t"), (F.col("user_id") % cells).cast("int").alias("cell"), "value")


def spikes(spark: SparkSession, sf_dir: str, cells: int = 8) -> DataFrame:
    """Number of events in every row of every reach and cell, 0 where there are none."""
    counts = events(spark, sf_dir, cells).groupBy("session", "stim", "reach", "t", "cell").agg(F.count(F.lit(1)).alias("n"))
    reach = spark.range(1, REACHES + 1).select(F.lit("events").alias("session"), ((F.col("id") - 1) % 3).cast("int").alias("stim"), F.col("id").cast("int").alias("reach"))
    rows = spark.range(ROWS).select(F.col("id").cast("int").alias("t"))
    cell = spark.range(cells).select(F.col("id").cast("int").alias("cell"))
    grid = reach.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cell))  # three sequences of fixed length
    return grid.join(counts, ["session", "stim", "reach", "t", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))


def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by row as the position x, at time t; rows without events are missing."""
    return events(spark, sf_dir).groupBy("session", "stim", "reach", "t").agg(F.avg("value").alias("x")).withColumn("time", F.col("t").cast("double"))


def spins(spark: SparkSession, sf_dir: str, cells: int = 64) -> DataFrame:
    """state, label, i, s: signs of the parts of every embedding, all of them or the first ones as cells."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    parts = F.posexplode(F.slice("embedding", 1, cells)).alias("i", "v")
    return e.select(F.col("vec_id").alias("state"), "label", parts).select("state", "label", F.col("i").cast("int").alias("i"), F.when(F.col("v") > 0, 1).otherwise(-1).alias("s"))
