"""Operators that cut long groups into segments: the same results however they are cut and stored."""

import random

import numpy as np
import pytest

from axonframe.functions.spline import spline
from axonframe.operators import binning, energy, kinematics, stats

SPIKE = "session string, reach int, t int, cell int, n double"


def spikes(spark, seed=1, part=0.1):
    """Reaches of very different lengths, two of them of one row, in two sessions."""
    rng, rows = random.Random(seed), []
    for session in "ab":
        for cell in range(3):
            for reach, length in enumerate((7, 1, 60, 3, 1, 25)):
                rows += [(session, reach, t, cell, float(rng.random() < part * cell)) for t in range(length)]
    return rows, spark.createDataFrame(rows, SPIKE)


def lines(rows):
    out = {}
    for session, reach, t, cell, n in sorted(rows):
        out.setdefault((session, cell), []).append(n)
    return out


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_windows_over_the_ends_of_reaches(spark, parts):
    rows, df = spikes(spark)
    df = df.repartition(parts)
    for width, segment in ((1, 5), (10, 5), (10, 1000), (40, 8), (200, 8)):
        got = {(r.session, r.cell, r.pos): r.fired for r in binning.bin_or(df, width, ("session", "cell"), ("reach", "t"), segment_rows=segment).collect()}
        wanted = {(*key, pos): int(any(x[pos : pos + width])) for key, x in lines(rows).items() for pos in range(len(x) - width + 1)}
        assert got == wanted


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_bin_sizes_from_silent_runs(spark, parts):
    rows, df = spikes(spark, part=0.03)
    for segment in (4, 1000):
        got = {(r.session, r.width): r.n_c for r in binning.bin_size_scan(df.repartition(parts), 1, 60, segment_rows=segment).collect()}
        for session in "ab":
            x = [v for (s, _), v in lines(rows).items() if s == session]
            for width in range(1, 60):
                fired = [any(v[p : p + width]) for v in x for p in range(len(v) - width + 1)]
                mean = sum(fired) / len(fired)
                assert got[session, width] == pytest.approx(1 / (mean * width) if mean else float("inf"))


def test_no_window_is_over_a_cell_alone(spark):
    _, df = spikes(spark)
    for found in (binning.bin_or(df, 10, ("session", "cell"), ("reach", "t")), binning.bin_size_scan(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.split("\n") if "Window [" in line and "row_number" in line and "_segment" not in line]
        assert not wide


def test_all_silent_and_all_firing(spark):
    rows = [("a", r, t, c, float(c)) for r in range(3) for t in range(20) for c in (0, 1)]
    scan = binning.bin_size_scan(spark.createDataFrame(rows, SPIKE).where("cell = 0"), 1, 4, segment_rows=6).collect()
    assert all(r.n_c == float("inf") for r in scan)
    scan = binning.bin_size_scan(spark.createDataFrame(rows, SPIKE).where("cell = 1"), 1, 4, segment_rows=6).collect()
    assert all(r.n_c == pytest.approx(1 / r.width) for r in scan)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_interpolation_of_a_long_reach(spark, parts):
    rng = random.Random(2)
    rows, asked = [], []
    for reach, n in enumerate((1, 2, 5, 800)):
        times = sorted(rng.uniform(0, 10) ** 3 for _ in range(n))
        rows += [("s", 0, reach, t, rng.uniform(-1, 1), float(i)) for i, t in enumerate(times)]
        asked += [("s", 0, reach, t) for t in [*(rng.uniform(-5, 1005) for _ in range(100)), *times[:3], -1.0, 2000.0]]
    asked += [("s", 0, 9, 1.0), ("s", 0, 2, None)]
    kin = spark.createDataFrame(rows, "session string, stim int, reach int, time double, x double, y double")
    clock = spark.createDataFrame(asked, "session string, stim int, reach int, time double")
    got = kinematics.interpolate(clock.repartition(parts), kin.repartition(parts), ["x", "y"], stretch_rows=30).collect()
    assert len(got) == len(asked)
    for r in got:
        points = [(t, x, y) for _, _, k, t, x, y in rows if k == r.reach]
        if r.time is None or not points or not points[0][0] <= r.time <= points[-1][0]:
            assert r.x is None and r.y is None
        else:
            times = [p[0] for p in points]
            assert (r.x, r.y) == (pytest.approx(np.interp(r.time, times, [p[1] for p in points])), pytest.approx(np.interp(r.time, times, [p[2] for p in points])))


def test_splines_in_blocks(spark):
    rng, rows, wanted = np.random.default_rng(1), [], {}
    for reach, n in enumerate((1, 2, 3, 4, 6, 300)):
        x = np.cumsum(rng.random(n) + 0.05)
        y = rng.normal(size=n)
        for t, v, d in zip(x, y, spline(x, y, x, derivative=True)):
            rows.append(("s", 0, reach, float(t), float(v), "other"))
            wanted[reach, float(t)] = d
    df = spark.createDataFrame(rows, "session string, stim int, reach int, time double, v double, d string").selectExpr("*", "2 * v AS twice")
    for parts, block in ((1, 256), (5, 60)):
        got = kinematics.spline_derivatives(df.repartition(parts), {"v": "d_v", "twice": "d_twice"}, rows=block).collect()
        assert len(got) == len(rows) and got[0].d == "other"
        for r in got:
            assert r.d_v == pytest.approx(wanted[r.reach, r.time], abs=1e-10, nan_ok=True) and r.d_twice == pytest.approx(2 * r.d_v, nan_ok=True)
    assert kinematics.derivative(df.limit(0), "v", "spline").count() == 0


def test_correlations_in_blocks_of_states(spark):
    rng = np.random.default_rng(3)
    table = rng.choice([-1, 1], (300, 7))
    rows = [(f"s{k}", i, int(v)) for k, row in enumerate(table) for i, v in enumerate(row) if (k + i) % 11]
    df = spark.createDataFrame(rows, "state string, i int, s int").repartition(5)
    cells = {}
    for state, i, s in rows:
        cells.setdefault(state, {})[i] = s
    packed = stats.packed_spins(df, block_states=70).collect()
    assert len(packed) > 2 and sum(bin(w & (1 << 64) - 1).count("1") for r in packed for words in r.known for w in words) == len(rows)
    for k in (1, 2, 4):
        for block in (70, 4096):
            stats.BLOCK_STATES, before = block, stats.BLOCK_STATES
            got = {tuple(r.subset): (r.total, r.states) for r in stats.subset_sums(df, k).collect()}
            stats.BLOCK_STATES = before
            for subset in got:
                products = [int(np.prod([c[i] for i in subset])) for c in cells.values() if set(subset) <= set(c)]
                assert got[subset] == (sum(products), len(products))
    plan = stats.k_corr(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan
    assert stats.subset_sums(df, 8).count() == 0 and stats.subset_sums(df.limit(0), 2).count() == 0


def test_energies_need_no_pairs_of_rows(spark):
    rng = np.random.default_rng(4)
    n = 6
    h, cpl = rng.normal(size=n), np.triu(rng.normal(size=(n, n)), 1)
    table = rng.choice([-1, 0, 1], (20, n))
    spins = spark.createDataFrame([(k, i, int(v)) for k, row in enumerate(table) for i, v in enumerate(row) if (k + i) % 7], "state int, i int, s int")
    model_h = spark.createDataFrame([(i, float(v)) for i, v in enumerate(h)], "i int, h double")
    model_j = spark.createDataFrame([(i, j, float(cpl[i, j])) for i in range(n) for j in range(i + 1, n)], "i int, j int, cpl double")
    found = energy.ising_energy_sql(spins, model_h, model_j)
    for r in found.collect():
        s = np.array([v if (r.state + i) % 7 else 0 for i, v in enumerate(table[r.state])])
        assert r.energy == pytest.approx(-h @ s - s @ cpl @ s)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    states = np.array([[2 * (k >> i & 1) - 1 for i in range(n)] for k in range(1 << n)])
    e = -states @ h - np.einsum("ki,ij,kj->k", states, cpl, states)
    temps = spark.createDataFrame([(0, 0.5), (1, 2.0)], "temp_idx int, temp double")
    for branch, kept in ((None, e), ("up", e[states.sum(axis=1) > 0]), ("down", e[states.sum(axis=1) < 0])):
        for r in energy.boltzmann_exact(model_h, model_j, temps, n, branch).collect():
            w = np.exp(-(kept - kept.min()) / r.temp)
            mean = (w @ kept) / w.sum()
            assert (r.mean_e, r.var_e) == (pytest.approx(mean), pytest.approx((w @ kept**2) / w.sum() - mean**2))
    with pytest.raises(ValueError):
        energy.boltzmann_exact(model_h, model_j, temps, n, "left")


def test_histogram_reads_its_table_once(spark):
    rows = [(k, i, -1 if (k * i) % 3 else 1) for k in range(50) for i in range(6)]
    df = spark.createDataFrame(rows, "state int, i int, s int")
    got = {r.bin: r["count"] for r in binning.q_histogram(df, 10).collect()}
    q = np.array([sum(max(s, 0) for k, _, s in rows if k == state) / 12 + 0.5 for state in range(50)])
    counts, _ = np.histogram(q, 10)
    assert got == {i: c for i, c in enumerate(counts.tolist()) if c}
    same = spark.createDataFrame([(k, i, 1) for k in range(3) for i in range(2)], "state int, i int, s int")
    assert [r["count"] for r in binning.q_histogram(same, 4).collect()] == [3]
    plan = binning.q_histogram(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
