"""Confidence intervals, first maxima, moments and higher correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.student import t_for_many, t_quantile_table


#: Degrees of freedom up to which t quantiles come from a table, which is broadcast.
TABLE_DF = 100


def mean_ci(df: DataFrame, keys: Sequence[str], col: str, confidence: float = 0.95) -> DataFrame:
    """keys, mean, lower and upper of the t-interval of the mean; the bounds are null for one value."""
    sums = df.groupBy(*keys).agg(F.avg(col).alias("mean"), (F.stddev_samp(col) / F.sqrt(F.count(col))).alias("_se"), (F.count(col) - 1).alias("_n"))
    table = t_quantile_table(df.sparkSession, confidence, TABLE_DF).select(F.col("df").alias("_df"), F.col("t").alias("_q"))
    joined = sums.join(F.broadcast(table), F.col("_n") == F.col("_df"), "left")
    half = F.col("_se") * F.when(F.col("_n") <= TABLE_DF, F.col("_q")).otherwise(t_for_many(confidence, F.col("_n")))
    return joined.select(*keys, "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def argmax_first(df: DataFrame, keys: Sequence[str], col: str, order: str) -> DataFrame:
    """The row of each group with the largest col, the first by order on ties; NaN is largest."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max(F.struct(F.col(col).alias("_v"), (-F.col(order)).alias("_o"), F.struct(*rest).alias("_row"))).alias("_top")
    picked = df.groupBy(*keys).agg(top)
    return picked.select(*keys, *[F.col(f"_top._row.{c}").alias(c) for c in rest])


#: States of a block, 64 to a word.
BLOCK_STATES = 4096


def packed_spins(spins: DataFrame, keys: Sequence[str] = (), state: str = "state", block_states: int | None = None) -> DataFrame:
    """keys, cells (in order), bits and known: one row for each block of states, bits and known being for each cell words
    of 64 states. A bit of `bits` says that the state's spin is -1, one of `known` that the state has the cell.

    States go to blocks by the hash of their name, so a block has about block_states states whatever a group's size, and
    are numbered within it. A cell's words of a block are then 64 times smaller than its spins. spins: keys, state, i, s;
    a state that has a cell twice counts once, as -1 if either is.
    """
    blocks = spins.groupBy(*keys).agg(F.ceil(F.approx_count_distinct(state) / (block_states or BLOCK_STATES)).alias("_blocks"))
    near = spins.join(blocks, list(keys)) if keys else spins.crossJoin(F.broadcast(blocks))  # one row a group of the keys
    rows = near.groupBy(*keys, state, "_blocks").agg(F.collect_list(F.struct("i", (F.col("s") < 0).alias("down"))).alias("_c"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(state), F.greatest("_blocks", F.lit(1))))
    bit = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(state)) - 1
    rows = rows.withColumn("_bit", bit).select(*keys, "_block", (F.col("_bit") / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("_one"), F.inline("_c"))
    words = rows.groupBy(*keys, "_block", "i", "_word").agg(F.bit_or(F.when(F.col("down"), F.col("_one")).otherwise(F.lit(0).cast("long"))).alias("b"), F.bit_or("_one").alias("k"))
    cells = words.groupBy(*keys, "_block", "i").agg(F.map_from_entries(F.collect_list(F.struct("_word", F.struct("b", "k")))).alias("_w"), F.max("_word").alias("_last"))
    blocks = cells.groupBy(*keys, "_block").agg(F.max("_last").alias("_last"), F.sort_array(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.map_entries("_w").alias("w")))).alias("_c"))
    none = F.lit(0).cast("long")
    filled = lambda name: F.transform("_c", lambda c: F.transform(F.sequence(F.lit(0), F.col("_last")), lambda w: F.coalesce(F.map_from_entries(c["w"])[w][name], none)))
    return blocks.select(*keys, F.transform("_c", lambda c: c["i"]).alias("cells"), filled("b").alias("bits"), filled("k").alias("known"))


def subset_sums(spins: DataFrame, k: int, keys: Sequence[str] = (), state: str = "state") -> DataFrame:
    """keys, subset (array of k cells in order), total (sum over states of the product of their spins) and states (how
    many states have all k cells). spins: keys, state, i, s.

    The product of k spins is -1 where an odd number of them is, which is the XOR of their bits. So of 64 states a product
    is one XOR, and its sum a count of bits. Cells are chosen one after the other, and the words of those chosen so far
    are carried along. Blocks of states add up, so what is shuffled is one row for each subset and task.
    """
    rows = packed_spins(spins, keys, state).where(F.size("cells") >= k).withColumn("subset", F.array().cast("array<int>")).withColumn("at", F.lit(-1))
    at = lambda name, q: F.get(F.col(name), q)
    with_bits = lambda q: at("bits", q) if k == 1 else F.zip_with(F.col("odd"), at("bits", q), lambda a, b: a.bitwiseXOR(b))
    with_known = lambda q: at("known", q) if k == 1 else F.zip_with(F.col("all"), at("known", q), lambda a, b: a.bitwiseAND(b))
    for chosen in range(1, k):
        rows = rows.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.size("cells") - (k - chosen) - 1)))
        first = chosen == 1
        q = F.col("at")
        rows = rows.withColumns({"subset": F.array_append("subset", at("cells", q)), "odd": at("bits", q) if first else with_bits(q), "all": at("known", q) if first else with_known(q)})
    count = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))

    def last(q: Column) -> Column:
        known = with_known(q)
        minus = count(F.zip_with(with_bits(q), known, lambda a, b: a.bitwiseAND(b)))
        return F.struct(at("cells", q).alias("cell"), count(known).alias("n"), minus.alias("minus"))

    ends = rows.select(*keys, "subset", F.inline(F.transform(F.sequence(F.col("at") + 1, F.size("cells") - 1), last)))
    sums = ends.where("n > 0").groupBy(*keys, F.array_append("subset", F.col("cell")).alias("subset")).agg(F.sum(F.col("n") - 2 * F.col("minus")).alias("total"), F.sum("n").alias("states"))
    return sums.select(*keys, "subset", F.col("total").cast("double").alias("total"), "states")


def moments(spins: DataFrame, keys: Sequence[str] = (), state: str = "state") -> DataFrame:
    """keys, i, j (null for first moments) and the mean of s_i or s_i s_j for i < j. spins: keys, state, i, s."""
    one, two = (subset_sums(spins, k, keys, state).withColumn("mean", F.col("total") / F.col("states")) for k in (1, 2))
    first = one.select(*keys, F.get("subset", 0).alias("i"), F.lit(None).cast("int").alias("j"), "mean")
    return first.unionByName(two.select(*keys, F.get("subset", 0).alias("i"), F.get("subset", 1).alias("j"), "mean"))


def k_corr(spins: DataFrame, k: int, keys: Sequence[str] = (), state: str = "state") -> DataFrame:
    """keys, subset (array of k cells in order) and the mean of the product of their spins, for every k cells.

    There are (cells choose k) subsets, and every state gives a term to each.
    """
    return subset_sums(spins, k, keys, state).select(*keys, "subset", (F.col("total") / F.col("states")).alias("corr"))


def stand_in_model(spins: DataFrame, keys: Sequence[str] = (), state: str = "state") -> tuple[DataFrame, DataFrame]:
    """model_h (keys, i, h) and model_j (keys, i, j, cpl) straight from the moments: atanh of the means, covariances.

    A stand-in for a fit, good for tests and as a starting point of one.
    """
    m = moments(spins, keys, state)
    means = m.where("j is null").select(*keys, "i", "mean")
    h = means.select(*keys, "i", F.atanh("mean").alias("h"))
    pairs = m.where("j is not null")
    ends = pairs.join(means.withColumnRenamed("mean", "_mi"), [*keys, "i"]).join(means.withColumnsRenamed({"i": "j", "mean": "_mj"}), [*keys, "j"])
    return h, ends.select(*keys, "i", "j", (F.col("mean") - F.col("_mi") * F.col("_mj")).alias("cpl"))


def heat_capacity(energy: Column | str) -> Column:
    """Population variance of the energy, not divided by the temperature."""
    return F.var_pop(energy)
