"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, written

#: Hexadecimal digits of the seeded hash that make a bucket of a source, and parts of the line from 0 to 1.
BUCKET_DIGITS = 3
LINE_PARTS = 1 << 12


def interleave(rows: DataFrame, shards: int = 16, source: str = "source", id_col: str = "doc_id", seed: str = "shard", ties: tuple[str, ...] = ()) -> DataFrame:
    """Add shard (0 to shards - 1), slot (0, 1, ... within the shard) and law (`rows`) to every row.

    Rows are shuffled within their source by the MD5 of seed and id, and a row's place on the line from 0 to 1 is
    (rank - 1 + the source's own offset) / rows of the source; the line, cut into equal numbers of rows, gives the
    shards. So counts differ by one at most, and every stretch of the line has its share of every source. Small
    sources start at different offsets, so that they do not all meet at one place.

    Ranks come from two levels, buckets and rows within a bucket; no window holds a whole source or the whole table.
    Null sources are one source; a null id counts as an empty one; rows with equal ids stand in the order of the columns
    `ties`, and rows that agree in those too are alike. An empty table gives an empty result. Columns of the names
    shard, slot and law are replaced; rows should have none that begin with an underscore.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot", "law")]
    rows = rows.select(*names).withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    # null and empty sources differ in the first column of the key
    rows = rows.withColumn("_null", F.col(source).isNull()).withColumn("_source", F.coalesce(F.col(source), F.lit(""))).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    key = ["_null", "_source", "_bucket"]
    counts = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "counts")
    running = Window.partitionBy("_null", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_null", "_source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("_source"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).withColumn("_rows", F.sum("_n").over(whole)).withColumn("_offset", offset)

    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_hash", id_col, *ties))
    ranked = rows.withColumn("_rank", rank).join(counts, key)
    line = ranked.withColumn("_at", (F.col("_before") + F.col("_rank") - 1 + F.col("_offset")) / F.col("_rows")).withColumn("_part", F.least(F.floor(F.col("_at") * LINE_PARTS), F.lit(LINE_PARTS - 1)))
    line = written(line.select(*names, "_hash", "_at", "_part"), "line")

    parts = line.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_at", source, "_hash", id_col, *ties)) - 1
    placed = line.withColumn("_place", place).join(parts, F.col("_part") == F.col("_p")).withColumn("_place", F.col("_place") + F.col("_before"))
    shard = F.floor(F.col("_place") * shards / F.col("_all"))
    first = F.ceil(shard * F.col("_all") / shards)
    return placed.select(*names, shard.cast("int").alias("shard"), (F.col("_place") - first).cast("long").alias("slot"), F.lit("rows").alias("law"))


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under the law `rows`) of every row of docs.

    Null text has size 1; rows of equal ids stand by size and CRC; null sources are one source; other columns are ignored.
    """
    small = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return interleave(written(small, "digest"), shards, ties=("size", "text_crc32")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def identity(rows: DataFrame) -> Column:
    """96 bits that tell rows apart by all their columns. Hashes pass over nulls, so each column also says whether it is
    null; lists, structs and maps, whose hash would pass over nulls in them, are taken as JSON with their nulls."""
    told = []
    for field in rows.schema.fields:
        column = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        told += [column.isNull(), F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"}) if nested else column]
    return F.struct(F.xxhash64(*told).alias("a"), F.hash(*told).alias("b"))


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs with shard and slot. Ranks are found on ids alone; the texts are shuffled once, each different row once.

    Null ids, sources and texts are kept, rows that differ in any column (also only in which is null) are different, repeated rows each get a slot of their own, an empty table gives an empty
    result, and columns called shard or slot are replaced; all others stay as they are.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    docs = docs.select(*names)
    (row,) = fresh(docs, "row")
    keyed = docs.withColumn(row, identity(docs))
    small = keyed.select("doc_id", "source", F.col(row).alias("row_of"))
    placed = interleave(written(small, "digest"), shards, ties=("row_of",)).select(F.col("row_of").alias(row), "shard", "slot")
    return keyed.dropDuplicates([row]).join(placed, row).select(*names, "shard", "slot")
