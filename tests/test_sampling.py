"""Sampling and fits against exact answers."""

import numpy as np
import pytest

from axonframe.operators import energy, fit, sampling
from axonframe.plans import reports


def test_grids(spark):
    t = sampling.adaptive_temperatures()
    assert len(t) == 119 and t[0] == 0.1 and t[-1] == pytest.approx(2.9, abs=0.05)
    assert len(sampling.regular_temperatures()) == 29 and len(sampling.regular_temperatures(step=0.05)) == 58


def test_chain_matches_enumeration():
    n, e, var, m, accepted = sampling.chain(np.array([1, -1]), np.array([0.5, -1.0]), np.array([0.25]), 1.0, 100_000, 9_000, 5)
    assert n == 90_999 and e == pytest.approx(-0.831089, abs=0.02) and var == pytest.approx(0.410728, abs=0.03)
    assert sampling.chain(np.ones(3), np.ones(3), np.ones(3), 0.0, 500, 0, 1)[4] == 1.0


def test_sweep_does_not_depend_on_layout(spark):
    init = spark.createDataFrame([("a", [1, -1, 1]), ("b", [-1, -1, 1])], "session string, state array<int>")
    model = spark.createDataFrame([(s, [0.1, -0.2, 0.3], [0.5, 0.0, -0.4]) for s in "ab"], "session string, h array<double>, cpl array<double>")
    temps = sampling.grid(spark, [0.5, 1.0, 2.0])
    first = sorted(map(tuple, sampling.metropolis_sweep(init, model, temps, ["session"], 2000, 100).collect()))
    again = sorted(map(tuple, sampling.metropolis_sweep(init.repartition(3), model.coalesce(1), temps, ["session"], 2000, 100).collect()))
    assert first == again and len(first) == 6
    curve = reports.magnetization_curve(sampling.metropolis_sweep(init, model, temps, ["session"], 2000, 100), 3, ["session"])
    assert curve.count() == 6


def test_fit_without_couplings_is_atanh(spark):
    rng = np.random.default_rng(2)
    s = np.where(rng.random((4000, 4)) < [0.3, 0.5, 0.6, 0.8], 1, -1)
    long = spark.createDataFrame([("m", int(k), int(i), int(s[k, i])) for k in range(len(s)) for i in range(4)], "session string, state int, i int, s int")
    r = fit.fit_ising(long, ["session"], sample_size=20_000, maxiter=15, eta=0.05).first()
    assert r.h == pytest.approx(np.arctanh(s.mean(axis=0)), abs=0.12)
    assert max(map(abs, r.cpl)) < 0.12


def test_fit_matches_moments():
    h, cpl = np.array([0.3, -0.2, 0.1]), np.array([0.6, -0.4, 0.2])
    states = np.array([[2 * (k >> i & 1) - 1 for i in range(3)] for k in range(8)], dtype=float)
    w = np.exp(-energy.energies(states, h, cpl))
    data = (w @ fit.features(states)) / w.sum()
    lam, rounds, error = fit.solve(data, 3, 20_000, 30, 0.05, 1.0, 1)
    w = np.exp(-energy.energies(states, lam[:3], lam[3:]))
    assert (w @ fit.features(states)) / w.sum() == pytest.approx(data, abs=0.03)
