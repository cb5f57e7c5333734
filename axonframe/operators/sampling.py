"""Metropolis sampling of Ising models, one chain a row, and the temperature grids it is run on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def adaptive_temperatures() -> list[float]:
    """From 0.1 by 0.1, by 0.01 between 0.7 and 1.7, then by 0.1 again, below 3."""
    out, temp = [], 0.1
    while temp < 3:
        out.append(temp)
        temp += 0.01 if 0.7 <= temp < 1.7 else 0.1
    return out


def regular_temperatures(start: float = 0.1, stop: float = 3.0, step: float = 0.1) -> list[float]:
    return [float(t) for t in np.arange(start, stop, step)]


def grid(spark: SparkSession, temps: Sequence[float]) -> DataFrame:
    """(temp_idx, temp)."""
    return spark.createDataFrame(list(enumerate(temps)), "temp_idx int, temp double")


def couplings(n: int, cpl: np.ndarray) -> np.ndarray:
    """Symmetric matrix of the pair couplings given row by row for i<j."""
    full = np.zeros((n, n))
    full[np.triu_indices(n, 1)] = cpl
    return full + full.T


def chain(state: np.ndarray, h: np.ndarray, cpl: np.ndarray, beta: float, steps: int, keep_after: int, seed: int) -> tuple[int, float, float, float, float]:
    """One chain: kept samples, mean and population variance of the energy, mean of the sum of spins, part accepted.

    A step proposes to flip one cell and accepts if the energy does not rise, or with probability exp(-beta dE). The
    local fields are carried along, so a step costs the change of one cell and not a new sum over all pairs. Samples
    are taken after every step with a number over keep_after, counted from 0.
    """
    rng = np.random.default_rng(seed)
    n, s = len(state), state.astype(float).copy()
    j = couplings(n, cpl)
    field = h + j @ s
    rows = list(j)
    energy, net = float(-(h @ s) - s @ j @ s / 2), float(s.sum())
    kept = accepted = 0
    base, sums, squares, spins = energy, 0.0, 0.0, 0.0
    for at in range(0, steps, 1 << 16):
        count = min(1 << 16, steps - at)
        flips, luck = rng.integers(0, n, count).tolist(), rng.random(count).tolist()
        for k in range(count):
            i = flips[k]
            rise = 2.0 * s[i] * field[i]
            if rise <= 0 or luck[k] < np.exp(-beta * rise):
                field -= 2.0 * s[i] * rows[i]
                s[i] = -s[i]
                energy, net, accepted = energy + rise, net + 2.0 * s[i], accepted + 1
            if at + k > keep_after:
                kept += 1
                sums += energy - base
                squares += (energy - base) ** 2
                spins += net
    if not kept:
        return 0, float("nan"), float("nan"), float("nan"), accepted / max(1, steps)
    mean = sums / kept
    return kept, base + mean, squares / kept - mean * mean, spins / kept, accepted / steps


def metropolis_sweep(init: DataFrame, model: DataFrame, temps: DataFrame, keys: Sequence[str], steps: int = 100_000, keep_after: int = 9_000, seed: int = 0) -> DataFrame:
    """keys, temp_idx, temp, n, mean_e, var_e, mean_m and accepted of one chain for each row of init and temperature.

    init: keys, state (array of -1 and +1, where the chain starts). model: keys, h, cpl. Chains are spread evenly over
    the tasks. The seed of a chain is a hash of its keys, its temperature's place and `seed`, so results do not depend
    on how the work is laid out, nor on tasks that are run again.
    """
    work = init.join(model, list(keys)).crossJoin(F.broadcast(temps)).withColumn("_seed", F.xxhash64(*keys, "temp_idx", F.lit(seed)))
    parts = max(int(init.sparkSession.conf.get("spark.sql.shuffle.partitions")), init.sparkSession.sparkContext.defaultParallelism * 4)
    work = work.repartition(parts, *keys, "temp_idx")
    schema = work.select(*keys, "temp_idx", "temp").schema.add("n", "long").add("mean_e", "double").add("var_e", "double").add("mean_m", "double").add("accepted", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = zip(part["state"], part["h"], part["cpl"], part["temp"], part["_seed"])
            found = [chain(np.asarray(x), np.asarray(h, dtype=float), np.asarray(c, dtype=float), 1.0 / t, steps, keep_after, int(z) % 2**63) for x, h, c, t, z in rows]
            out = part[[*keys, "temp_idx", "temp"]].copy()
            out[["n", "mean_e", "var_e", "mean_m", "accepted"]] = pd.DataFrame(found, index=out.index, columns=["n", "mean_e", "var_e", "mean_m", "accepted"])
            yield out

    return work.select(*keys, "temp_idx", "temp", "state", "h", "cpl", "_seed").mapInPandas(run, schema)
