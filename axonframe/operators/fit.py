"""Fits of pairwise maximum-entropy models by Monte Carlo histogram steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.operators.sampling import couplings
from axonframe.operators.stats import k_corr, moments


def sample_states(h: np.ndarray, cpl: np.ndarray, size: int, burn_in: int, between: int, rng: np.random.Generator, chains: int = 200) -> np.ndarray:
    """At least `size` states under weights exp(-E), from chains advanced together; `between` steps lie between samples."""
    n = len(h)
    j = couplings(n, cpl)
    s = rng.choice([-1.0, 1.0], (chains, n))
    field, rows = h + s @ j, np.arange(chains)
    out = np.empty((-(-size // chains), chains, n))
    kept, step = 0, 0
    while kept < len(out):
        i = rng.integers(0, n, chains)
        spin = s[rows, i]
        flip = rng.random(chains) < np.exp(np.clip(-2.0 * spin * field[rows, i], -700, 0))
        change = np.where(flip, -2.0 * spin, 0.0)
        field += change[:, None] * j[i]
        s[rows, i] += change
        step += 1
        if step > burn_in and (step - burn_in) % between == 0:
            out[kept] = s
            kept += 1
    return out.reshape(-1, n)


def features(s: np.ndarray) -> np.ndarray:
    """Cells and products of pairs i<j."""
    i, j = np.triu_indices(s.shape[1], 1)
    return np.concatenate([s, s[:, i] * s[:, j]], axis=1)


def solve(data: np.ndarray, n: int, sample_size: int, maxiter: int, eta: float, maxdlamda: float, seed: int, tolerance: float = 0.01, inner: int = 50) -> tuple[np.ndarray, int, float]:
    """Multipliers (h, then couplings) whose model has the moments `data`, the rounds it took and the largest error left.

    Every round samples the model, then steps the multipliers along the differences of the moments; what a step does to
    the moments is read off the same samples, weighted by exp(-change of E), until the step has length maxdlamda.
    """
    rng = np.random.default_rng(seed)
    lam = np.zeros(n + n * (n - 1) // 2)
    lam[:n] = np.arctanh(np.clip(data[:n], -0.999, 0.999))
    error = float("inf")
    for done in range(maxiter):
        f = features(sample_states(lam[:n], lam[n:], sample_size, 10 * n, 10 * n, rng))
        now = f.mean(axis=0)
        error = float(np.abs(data - now).max())
        if error < tolerance:
            return lam, done, error
        step = np.zeros_like(lam)
        for _ in range(inner):
            move = eta * (data - now)
            if np.linalg.norm(step + move) > maxdlamda:
                break
            step += move
            w = f @ step
            w = np.exp(w - w.max())
            now = w @ f / w.sum()
        lam = lam + step
    return lam, maxiter, error


def fit_ising(spins: DataFrame, keys: Sequence[str], sample_size: int = 100_000, maxiter: int = 75, eta: float = 1e-3, maxdlamda: float = 1.0, seed: int = 0, tolerance: float = 0.01, inner: int = 50, state: str = "state") -> DataFrame:
    """keys, h, cpl, rounds and error of the model of each group of spins (keys, state, i in 0..N-1, s in -1, +1).

    Moments are made by Spark over all states; what reaches a group's task is N + N (N - 1) / 2 numbers. The seed is a
    hash of the keys and `seed`. Moments are matched; multipliers need not agree with another implementation's.
    """
    m = moments(spins, keys, state).withColumn("_seed", F.xxhash64(*keys, F.lit(seed)))
    schema = spins.select(*keys).schema.add("h", T.ArrayType(T.DoubleType())).add("cpl", T.ArrayType(T.DoubleType())).add("rounds", T.IntegerType()).add("error", T.DoubleType())

    def one(part: pd.DataFrame) -> pd.DataFrame:
        first = part[part["j"].isna()].sort_values("i")
        pairs = part[part["j"].notna()].sort_values(["i", "j"])
        n = len(first)
        lam, rounds, error = solve(np.concatenate([first["mean"], pairs["mean"]]).astype(float), n, sample_size, maxiter, eta, maxdlamda, int(part["_seed"].iloc[0]) % 2**63, tolerance, inner)
        row = {k: [part[k].iloc[0]] for k in keys} | {"h": [lam[:n].tolist()], "cpl": [lam[n:].tolist()], "rounds": [rounds], "error": [error]}
        return pd.DataFrame(row)

    return m.groupBy(*keys).applyInPandas(one, schema)


def sample_model(model: DataFrame, keys: Sequence[str], size: int = 10_000, seed: int = 0) -> DataFrame:
    """keys, state, i and s of states drawn from each model (keys, h, cpl)."""
    schema = model.select(*keys).schema.add("state", T.LongType()).add("i", T.IntegerType()).add("s", T.IntegerType())

    def one(part: pd.DataFrame) -> pd.DataFrame:
        r = part.iloc[0]
        h, cpl = np.asarray(r["h"], dtype=float), np.asarray(r["cpl"], dtype=float)
        s = sample_states(h, cpl, size, 10 * len(h), 10 * len(h), np.random.default_rng(int(r["_seed"]) % 2**63))
        count, n = s.shape
        out = pd.DataFrame({"state": np.repeat(np.arange(count), n), "i": np.tile(np.arange(n, dtype=np.int32), count), "s": s.astype(np.int32).ravel()})
        for k in keys:
            out[k] = r[k]
        return out[[*keys, "state", "i", "s"]]

    return model.withColumn("_seed", F.xxhash64(*keys, F.lit(seed))).groupBy(*keys).applyInPandas(one, schema)


def verify_fit(spins: DataFrame, model: DataFrame, keys: Sequence[str], ks: Sequence[int] = (3, 4, 5), size: int = 10_000, seed: int = 0) -> DataFrame:
    """keys, k, subset, data and model: the correlations of every k cells in the data and in samples of the model."""
    drawn = sample_model(model, keys, size, seed)
    out = None
    for k in ks:
        both = k_corr(spins, k, keys).withColumnRenamed("corr", "data").join(k_corr(drawn, k, keys).withColumnRenamed("corr", "model"), [*keys, "subset"])
        part = both.select(*keys, F.lit(k).alias("k"), "subset", "data", "model")
        out = part if out is None else out.unionByName(part)
    return out
