"""Rolling firing rates, the reactive test, and the classification of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.student import p_value

CELL_ROWS = ("session", "stim", "reach", "cell")


def rolling_rate(spike: DataFrame, w: int, group: Sequence[str] = CELL_ROWS, t: str = "t", value: str = "n") -> DataFrame:
    """Trailing mean over w rows; the first w - 1 rows of a group have rate 0."""
    rows = Window.partitionBy(*group).orderBy(t)
    rate = F.when(F.row_number().over(rows) >= w, F.avg(value).over(rows.rowsBetween(-(w - 1), 0))).otherwise(0.0)
    return spike.withColumn("rate", rate)


def rolling_rate_all_reach(spike: DataFrame, w: int) -> DataFrame:
    """Mean over reaches of every cell's rolling rate, as far as the shortest reach goes."""
    from axonframe.operators.binning import truncate_to_shortest

    return rolling_rate(truncate_to_shortest(spike), w).groupBy("session", "stim", "cell", "t").agg(F.avg("rate").alias("rate"))


def classify_cells(rate: DataFrame, position: DataFrame, model_h: DataFrame, skip: int = 50) -> DataFrame:
    """Pausers and bursters: the sign of the slope of a cell's mean rate over the mean position, rows before skip left out.

    rate: session, stim, cell, t, rate. position: session, stim, t, x. model_h: session, stim, cell, h. A slope that is
    0, null or NaN gives no row. r is the correlation, std_err the standard error of the slope, and p the two-sided
    p-value of a slope of 0; both are null for under three rows.
    """
    both = rate.where(F.col("t") >= skip).join(position, ["session", "stim", "t"])
    sums = both.groupBy("session", "stim", "cell").agg(F.regr_slope("rate", "x").alias("slope"), F.regr_intercept("rate", "x").alias("intercept"), F.regr_sxx("rate", "x").alias("_xx"), F.regr_syy("rate", "x").alias("_yy"), F.regr_sxy("rate", "x").alias("_xy"), F.count(F.lit(1)).alias("rows"))
    r = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    error = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_yy") - F.col("slope") * F.col("_xy"), F.col("_xx") * (F.col("rows") - 2))))
    fit = sums.withColumns({"r": r, "std_err": error}).drop("_xx", "_yy", "_xy")
    # a line through all points has no error, and its slope is not 0 by chance
    fit = fit.withColumn("p", F.when((F.col("std_err") == 0) & (F.col("slope") != 0), 0.0).otherwise(p_value(F.try_divide(F.col("slope"), F.col("std_err")), F.col("rows") - 2)))
    kind = F.when(F.col("slope") < 0, "pauser").when(F.col("slope") > 0, "burster")
    named = fit.where(~F.isnan("slope")).withColumn("kind", kind).where(F.col("kind").isNotNull())
    return named.join(model_h, ["session", "stim", "cell"])


def reactive_test(spike: DataFrame, crossing: DataFrame, w: int, span: int = 50) -> DataFrame:
    """Pooled two-sample t-test of each cell's rates between stimulus 0 and 1, over span rows from the crossing on.

    crossing: session, stim, reach, t_cross. Reaches without a crossing, or with under w - 1 rows from it on, are left
    out; the zeros of the first w - 1 rows count. Returns session, cell, t, df and p.
    """
    window = spike.join(crossing, ["session", "stim", "reach"]).where((F.col("t") >= F.col("t_cross")) & (F.col("t") < F.col("t_cross") + span))
    long_enough = F.count(F.lit(1)).over(Window.partitionBy(*CELL_ROWS)) >= w - 1
    rates = rolling_rate(window.withColumn("_ok", long_enough).where("_ok"), w)
    side = lambda f, k: f(F.when(F.col("stim") == k, F.col("rate")))
    sums = rates.where(F.col("stim").isin(0, 1)).groupBy("session", "cell").agg(*[side(f, k).alias(f"{name}{k}") for k in (0, 1) for f, name in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    df = F.col("n0") + F.col("n1") - 2
    pooled = F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), df)
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n0")) + F.try_divide(F.lit(1.0), F.col("n1")))))
    tested = sums.select("session", "cell", t.alias("t"), df.alias("df"))
    return tested.withColumn("p", p_value(F.col("t"), F.col("df").cast("double")))
