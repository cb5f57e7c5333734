"""Ising energies: E(s) = - sum over i<j of cpl_ij s_i s_j - sum over i of h_i s_i."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.operators.binning import binarize, truncate_to_shortest


def energies(s: np.ndarray, h: np.ndarray, cpl: np.ndarray) -> np.ndarray:
    """Energies of rows of s under the fields and couplings of the same rows (or of one row for all)."""
    i, j = np.triu_indices(s.shape[1], 1)
    return -(s * h).sum(axis=1) - (s[:, i] * s[:, j] * cpl).sum(axis=1)


@F.pandas_udf(T.DoubleType())
def _energy(s: pd.Series, h: pd.Series, cpl: pd.Series) -> pd.Series:
    out = np.full(len(s), np.nan)
    by_size: dict[int, list[int]] = {}
    for place, x in enumerate(s):
        by_size.setdefault(len(x), []).append(place)
    for places in by_size.values():
        for at in range(0, len(places), 1000):  # bounds the table of pair terms
            part = places[at : at + 1000]
            out[part] = energies(*(np.stack(c.iloc[part].to_numpy()).astype(float) for c in (s, h, cpl)))
    return pd.Series(out)


def ising_energy(state: Column | str, h: Column | str, cpl: Column | str) -> Column:
    """Energy of an array of spins; h has one number a cell, cpl one for each pair i<j, row by row."""
    return _energy(state, h, cpl)


def _model_row(model_h: DataFrame, model_j: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _h (array of i and h) and _j (array of i, j and cpl): one row a model."""
    h = model_h.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("_h"))
    j = model_j.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "j", "cpl"))).alias("_j"))
    return h.join(j, list(keys), "full") if keys else h.crossJoin(j)


def _energy_of(spin) -> Column:
    """The energy of a state under _h and _j, spin(i) being a cell's spin, or 0 if the state lacks it."""
    zero = F.lit(0.0)
    own = F.aggregate(F.coalesce("_h", F.array().cast("array<struct<i:int,h:double>>")), zero, lambda e, x: e - x["h"] * spin(x["i"]))
    return F.aggregate(F.coalesce("_j", F.array().cast("array<struct<i:int,j:int,cpl:double>>")), own, lambda e, x: e - x["cpl"] * spin(x["i"]) * spin(x["j"]))


def ising_energy_sql(spins: DataFrame, model_h: DataFrame, model_j: DataFrame, keys: Sequence[str] = (), state: Sequence[str] = ("state",)) -> DataFrame:
    """The same from long tables, by expressions alone: keys, state, energy. spins: keys, state, i, s, cells from 0 on.

    model_h and model_j have one row a cell and pair; keys are the columns by which states and models belong together.
    Cells that a state or the model lacks add nothing. A state is put together as one row, which meets the one row of its
    model; pairs of cells are no rows.
    """
    rows = spins.groupBy(*keys, *state).agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), F.col("s").cast("double")))).alias("_of"))
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_of"))), lambda i: F.coalesce(F.col("_of")[i], F.lit(0.0)))
    rows = rows.select(*keys, *state, dense.alias("_s"))
    model = _model_row(model_h.withColumn("i", F.col("i").cast("int")), model_j.withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")}), keys)
    both = rows.join(model, list(keys)) if keys else rows.crossJoin(F.broadcast(model))  # one row
    return both.select(*keys, *state, _energy_of(lambda i: F.coalesce(F.get("_s", i), F.lit(0.0))).alias("energy"))


def model_arrays(model_h: DataFrame, model_j: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Models as arrays (keys, h, cpl) from the long tables."""
    h = model_h.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("h"))
    j = model_j.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cpl"))), lambda x: x["cpl"]).alias("cpl"))
    return h.join(j, list(keys)) if keys else h.crossJoin(j)  # one row each


def energy_time(spike: DataFrame, model_h: DataFrame, model_j: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Energy by reach and row: reaches cut to the shortest of their stimulus, cells as 0 and 1, one model a session."""
    spins = truncate_to_shortest(spike).select("session", "stim", "reach", "t", F.col("cell").alias("i"), binarize(F.col("n")).alias("s"))
    return ising_energy_sql(spins, model_h, model_j, keys, ("stim", "reach", "t"))


#: Number of cells up to which all states are gone through.
MOST_CELLS = 20


def boltzmann_exact(model_h: DataFrame, model_j: DataFrame, temps: DataFrame, cells: int, branch: str | None = None) -> DataFrame:
    """temp_idx, temp, mean_e and var_e over all 2 ** cells states of -1 and +1, weighted by exp(-E / T).

    branch: only the states whose net spin is over 0 (`up`) or under 0 (`down`): the two branches between which a system
    that starts mostly up, or mostly down, does not change at low temperatures. States are numbers, whose bits are the
    spins, dealt out in ranges; a state is one row, and its energy one expression. Energies are taken from the least one
    of the branch, so the weights do not overflow. For a few cells: it is the exact answer that sampling is held against.
    """
    if cells > MOST_CELLS:
        raise ValueError(f"enumeration is for {MOST_CELLS} cells at most")
    if branch not in (None, "up", "down"):
        raise ValueError(f"no branch {branch!r}; there are up and down")
    spark = model_h.sparkSession
    states = spark.range(1 << cells).withColumnRenamed("id", "state")
    net = 2 * F.bit_count("state") - cells
    if branch:
        states = states.where(net > 0 if branch == "up" else net < 0)
    model = _model_row(model_h.withColumn("i", F.col("i").cast("int")), model_j.withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")}), ())
    spin = lambda i: F.when(i < cells, (2 * F.call_function("bit_get", F.col("state"), F.least(i, F.lit(cells - 1))) - 1).cast("double")).otherwise(0.0)
    e = states.crossJoin(F.broadcast(model)).select(_energy_of(spin).alias("energy"))  # one row
    low = e.agg(F.min("energy").alias("_low"))
    weighted = e.crossJoin(F.broadcast(low)).crossJoin(F.broadcast(temps)).withColumn("_w", F.exp(-(F.col("energy") - F.col("_low")) / F.col("temp")))
    sums = weighted.groupBy("temp_idx", "temp").agg(F.sum("_w").alias("_z"), F.sum(F.col("_w") * F.col("energy")).alias("_e"), F.sum(F.col("_w") * F.col("energy") * F.col("energy")).alias("_e2"))
    mean = F.col("_e") / F.col("_z")
    return sums.select("temp_idx", "temp", mean.alias("mean_e"), (F.col("_e2") / F.col("_z") - mean * mean).alias("var_e"))
