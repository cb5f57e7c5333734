"""Result tables of the analyses: what plots would show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.spline import parabola_value, value_at, with_second_derivatives
from axonframe.operators.energy import energy_time
from axonframe.operators.kinematics import position_time
from axonframe.operators.sampling import metropolis_sweep
from axonframe.operators.stats import argmax_first, mean_ci


def critical_point(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, tc_idx, tc, hc and ec: the temperature of the first largest heat capacity, and the mean energy there."""
    top = argmax_first(sweep.select(*keys, "temp_idx", "temp", "mean_e", "var_e"), keys, "var_e", "temp_idx")
    return top.select(*keys, F.col("temp_idx").alias("tc_idx"), F.col("temp").alias("tc"), F.col("var_e").alias("hc"), F.col("mean_e").alias("ec"))


def spline_at(sweep: DataFrame, places: DataFrame, keys: Sequence[str], out: str = "spline_e") -> DataFrame:
    """places (keys, temp, ...) with `out`: the energy at any temperature on the cubic spline through its sweep. At one of
    the sweep's own temperatures it is the table's value. One row a sweep is put together; it has as many points as the
    sweep has temperatures."""
    points = sweep.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("temp").alias("x"), F.col("mean_e").alias("y")))).alias("_p"))
    lines = points.select(*keys, F.transform("_p", lambda p: p["x"]).alias("_x"), F.transform("_p", lambda p: p["y"]).alias("_y"))
    always, bent = F.lit(True), F.size("_x") >= 4
    lines = with_second_derivatives(lines, "_x", "_y", always, always, "_m")
    at = F.col("temp")
    value = F.when(bent, value_at(F.col("_x"), F.col("_y"), F.col("_m"), at)).otherwise(parabola_value(F.col("_x"), F.col("_y"), at))
    return places.join(lines, list(keys)).select(*places.columns, value.alias(out))


def spline_energy(sweep: DataFrame, critical: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and spline_ec: the energy at tc on the cubic spline through a sweep."""
    return spline_at(sweep, critical.select(*keys, F.col("tc").alias("temp")), keys, "spline_ec").drop("temp")


def energy_curve(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, temp_idx, temp, mean_e, tc and ec: energy against temperature with the lines of the critical point."""
    lines = critical_point(sweep, keys).select(*keys, "tc", "ec")
    return sweep.select(*keys, "temp_idx", "temp", "mean_e").join(lines, list(keys))


def two_branch_critical(plus: DataFrame, minus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, tc and ec: where the branch from mostly up cells has its first largest heat capacity, and the mean of both
    branches' energies there."""
    at = critical_point(plus, keys)
    other = minus.select(*keys, F.col("temp_idx").alias("tc_idx"), F.col("mean_e").alias("_e"))
    return at.join(other, [*keys, "tc_idx"]).select(*keys, "tc_idx", "tc", ((F.col("ec") + F.col("_e")) / 2).alias("ec"))


def tail_mean(curve: DataFrame, keys: Sequence[str], col: str, order: str = "temp_idx", last: int = 10) -> DataFrame:
    """Mean of col over the last rows of each curve."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return curve.withColumn("_r", rank).where(F.col("_r") <= last).groupBy(*keys).agg(F.avg(col).alias(f"{col}_tail"))


def magnetization_curve(sweep: DataFrame, cells: int, keys: Sequence[str]) -> DataFrame:
    """keys, temp_idx, temp, magnetization (mean sum of spins / cells squared) and its mean over the last ten temperatures."""
    curve = sweep.select(*keys, "temp_idx", "temp", (F.col("mean_m") / (cells * cells)).alias("magnetization"))
    return curve.join(tail_mean(curve, keys, "magnetization"), list(keys))


def energy_position_report(spike: DataFrame, kin: DataFrame, model_h: DataFrame, model_j: DataFrame, confidence: float = 0.95, sweep: DataFrame | None = None, at: Sequence[str] = ("session",)) -> DataFrame:
    """session, stim, series (energy or position), t, mean, lower, upper: both series, each on its own rows.

    With a sweep (`at`, temp_idx, temp, mean_e, var_e) each row also has the critical lines of its session (or of what
    else `at` names, such as session and stim): tc and ec, the temperature of the first largest heat capacity and the
    energy there, and spline_ec, the energy there on the spline through the sweep. There is one line of each for a sweep.
    """
    keys = ["session", "stim", "t"]
    energy = mean_ci(energy_time(spike, model_h, model_j), keys, "energy", confidence).withColumn("series", F.lit("energy"))
    position = mean_ci(position_time(kin), keys, "x", confidence).withColumn("series", F.lit("position"))
    report = energy.unionByName(position).select("session", "stim", "series", "t", "mean", "lower", "upper")
    if sweep is None:
        return report
    critical = critical_point(sweep, at)
    lines = critical.select(*at, "tc", "ec").join(spline_energy(sweep, critical, at), list(at))
    return report.join(lines, list(at), "left").select("session", "stim", "series", "t", "mean", "lower", "upper", "tc", "ec", "spline_ec")


def system_size(init: DataFrame, model: DataFrame, temps: DataFrame, keys: Sequence[str], steps: int = 100_000, keep_after: int = 9_000, seed: int = 0) -> DataFrame:
    """keys, cells, temp_idx, temp, mean_e, heat_capacity and magnetization of sweeps of systems of any size; the keys
    name the day, the stimulus and the like. Average over them with groupBy."""
    sizes = init.select(*keys, F.size("state").alias("cells"))
    swept = metropolis_sweep(init, model, temps, keys, steps, keep_after, seed).join(sizes, list(keys))
    return swept.select(*keys, "cells", "temp_idx", "temp", "mean_e", F.col("var_e").alias("heat_capacity"), (F.col("mean_m") / (F.col("cells") * F.col("cells"))).alias("magnetization"))
