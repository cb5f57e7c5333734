"""Mixing sources to target weights by capped water-filling, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, fresh, written

#: Hexadecimal digits of the seeded hash that make a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    packed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(packed == "", F.lit(0)).otherwise(F.size(F.split(packed, SPACES))).cast("long")


def source_weights(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """(source, source_size) with the weights dealt in turn: sources by code point, null last.

    One row for each source goes through the one sort; rows of the corpus do not.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))


def water_fill(sources: DataFrame, budget: Column, max_epochs: float) -> DataFrame:
    """Targets of sources (source, source_size, weight): weight x level, but never over max_epochs x size.

    The sources that stop at their cap are those with the smallest cap for their weight. After capping the first k
    of them the level is (budget - their caps) / the weight of the rest; the right k is the first at which no other
    source passes its cap, and of those at which none does it
    has the highest level. This is where redistributing the excess again and again ends.
    """
    total = Window.partitionBy()
    order = Window.orderBy("ratio", "weight", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("all_size", F.sum("source_size").over(total)).withColumn("all_weight", F.sum("weight").over(total))
    ranked = ranked.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(total)
    return ranked.withColumn("_level", level).withColumn("target", F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("_level")))).select("source", "source_size", "target")


def mix(rows: DataFrame, size: str = "size", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """Add source_size, target and copies (whole repetitions of the row that the mix takes) to rows.

    The weights go to the sources in turn, by code point, null last (null is a source of its own). All targets sum
    to share x all sizes, unless the caps of max_epochs x a source's size do not allow it. Every row is taken
    floor(target / source size) times, and once more up to the point in a seeded order where the source's target is
    reached, so that what a source gives is within half a row of its target. The seeded order is by the MD5 of seed
    and id, in buckets of its first hexadecimal digits: only a source's last bucket is sorted. Rows with the same id
    are ordered by size, those with the same size too are taken alike; a null id counts as an empty one. Sources of size 0 have target 0. An empty table gives an
    empty result. rows should be small (ids and sizes): it is read several times; columns named source_size, target
    or copies are replaced, and other names do not clash.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = rows.drop("source_size", "target", "copies").withColumn("_hash", digest).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    by_bucket = rows.groupBy(F.col(source).alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum(size).alias("_bucket_size"))
    by_bucket = written(by_bucket, "buckets")
    sizes = by_bucket.groupBy(F.col("_s").alias("source")).agg(F.sum("_bucket_size").alias("source_size"))
    targets = water_fill(source_weights(sizes, list(weights)), F.lit(float(share)) * F.col("all_size"), max_epochs)
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    running = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = by_bucket.withColumn("_before", F.coalesce(F.sum("_bucket_size").over(running), F.lit(0)))
    plan = buckets.join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    plan = written(plan, "plan")

    placed = rows.join(plan, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    full = (F.col("_rest") > 0) & (F.col("_before") + F.col("_bucket_size") <= F.col("_rest"))
    inside = (F.col("_before") < F.col("_rest")) & ~full
    upto = F.sum(size).over(Window.partitionBy("_s", "_b").orderBy("_hash", id_col, size))  # rows alike stand together
    last = placed.where(inside).withColumn("_more", (F.col("_before") + upto - F.col(size) / 2 <= F.col("_rest")).cast("long"))
    done = placed.where(~inside).withColumn("_more", full.cast("long")).unionByName(last)
    return done.withColumn("copies", F.col("_whole") + F.col("_more")).drop("_hash", "_bucket", "_s", "_b", "_bucket_size", "_before", "_whole", "_rest", "_more")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size (words), source_size, target and taken (words, repeats counted) of every row of docs.

    Null text has size 0; null ids and sources are kept; repeated rows give repeated rows; other columns are ignored.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sizes, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it. Columns stay as they are, whatever their names; the texts are
    shuffled once.

    Null ids and sources are kept, null and empty texts have no words and are taken like the other rows of their source,
    rows with the same id, source and size are taken alike, and an empty table gives an empty result.
    """
    size, copies, i, s, z, copy = fresh(docs, "size", "copies", "i", "s", "z", "copy")
    keyed = docs.withColumn(size, word_count(F.col("text")))
    sizes = written(keyed.select("doc_id", "source", F.col(size).alias("size")), "sizes")
    taken = mix(sizes, **options).where("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z), F.col("copies").cast("int").alias(copies)).distinct()
    on = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(size) == F.col(z))
    return keyed.join(taken, on).select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(copy)).select(*docs.columns)
