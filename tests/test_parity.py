"""Sessions by path, first rows, splines, correlations by task, critical lines and p-values in batches."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from axonframe.functions.spline import spline
from axonframe.functions.student import p_value, t_tail, t_tails
from axonframe.operators import kinematics, stats
from axonframe.plans import reports
from axonframe.sources import sessions


def test_spline_goes_through_cubics_and_meets_its_conditions():
    rng = np.random.default_rng(1)
    for n in (4, 5, 9, 60):
        x = np.cumsum(rng.random(n) + 0.1)
        cubic = np.poly1d(rng.normal(size=4))
        at = np.linspace(x[0], x[-1], 50)
        assert np.allclose(spline(x, cubic(x), at), cubic(at)) and np.allclose(spline(x, cubic(x), at, derivative=True), cubic.deriv()(at))
        y, eps = rng.normal(size=n), 1e-6
        assert np.allclose(spline(x, y, x), y)
        inner = x[1:-1]
        assert np.allclose(spline(x, y, inner - eps, True), spline(x, y, inner + eps, True), atol=1e-3)
    assert np.isfinite(spline(np.arange(100_000.0), np.sin(np.arange(100_000.0)), np.array([5.5]))).all()  # no table of n x n


def test_p_values_in_batches():
    rng = np.random.default_rng(2)
    t, df = rng.normal(size=300) * 4, rng.integers(1, 300, 300).astype(float)
    assert np.allclose(t_tails(t, df), [t_tail(a, b) for a, b in zip(t, df)], atol=1e-12)
    assert np.isnan(t_tails(np.array([np.nan, 1.0]), np.array([3.0, 0.0]))).all() and t_tails(np.array([0.0, np.inf]), np.array([3.0, 3.0])).tolist() == [1.0, 0.0]


def test_p_values_by_expressions(spark):
    rows = [(float(t), float(d)) for t in (0, 1e-9, 0.1, 1, -3, 30, 1e5, "inf", "nan") for d in (1, 2, 3, 57, 300, 5000, 0)]
    got = spark.createDataFrame([*rows, (None, 3.0), (1.0, None)], "t double, d double").select(p_value(F.col("t"), F.col("d")).alias("p")).collect()
    assert [r.p for r in got[-2:]] == [None, None]
    for (t, d), r in zip(rows, got):
        wanted = t_tails(np.array([t]), np.array([d]))[0]
        assert r.p is None if np.isnan(wanted) else abs(r.p - wanted) <= 1e-9 * max(wanted, 1e-200) + 1e-13


def test_correlations_by_group_with_cells_that_some_states_lack(spark):
    rng = random.Random(3)
    rows = [(g, st, i, rng.choice([-1, 1])) for g in "ab" for st in range(40) for i in range(6) if st % 5 or i != 2]
    got = stats.k_corr(spark.createDataFrame(rows, "g string, state int, i int, s int"), 3, ["g"]).collect()
    for g in "ab":
        states = {}
        for x, st, i, s in rows:
            if x == g:
                states.setdefault(st, {})[i] = s
        for subset in combinations(range(6), 3):
            terms = [np.prod([c[i] for i in subset]) for c in states.values() if set(subset) <= set(c)]
            (row,) = [r for r in got if r.g == g and tuple(r.subset) == subset]
            assert abs(row["corr"] - np.mean(terms)) < 1e-12


def test_sessions_by_path(spark):
    paths = [f"/d/m1/P_Cells/{b}/X_060102_x{k}_NPresults.mat" for b in ("bin10", "bin9") for k in (10, 9)] + ["/d/m1/Others/bin1/a.mat", "short.mat"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = sorted((r.place, r.mouse, r.cell_group, r.bin, r.file) for r in sessions.report_sessions(df).collect())
    assert rows == [(0, "m1", "P_Cells", "bin9", "X_060102_x9_NPresults.mat"), (1, "m1", "P_Cells", "bin9", "X_060102_x10_NPresults.mat")]
    parsed = df.select(sessions.parse_session_name(F.element_at(F.split("path", "/"), -1)).alias("p")).collect()
    assert [r.p.key for r in parsed] == ["060102_x10", "060102_x9"] * 2 + ["", ""] and parsed[0].p.identifier == "x10"
    assert sessions.report_sessions(df.limit(0)).count() == 0


def test_model_table_round_trip(spark, tmp_path):
    row = [("s", 0, "mid", 3, [0.5, -1.0], [0.25])]
    models = spark.createDataFrame(row, sessions.MODEL)
    sessions.write_table(models, f"{tmp_path}/models", ("session", "stim"))
    back = sessions.read_models(spark, f"{tmp_path}/models").select(*models.columns).collect()
    assert [tuple(r) for r in back] == row


def test_first_rows_have_spline_accelerations_and_no_jerk(spark):
    rows = [("s", 0, 0, t, t / 10, 1.0, 0.0, 0.0, 0.0, (t / 10) ** 2, (t / 10) ** 3, 2.0) for t in range(60)]
    kin = spark.createDataFrame(rows, "session string, stim int, reach int, t int, time double, x double, y double, z double, speed double, vx double, vy double, vz double")
    got = kinematics.head_with_accelerations(kin, 40).orderBy("t").collect()
    assert len(got) == 40 and not any("jerk" in c for c in got[0].asDict())
    assert all(abs(r.ax - 2 * r.time) < 1e-9 and abs(r.ay - 3 * r.time**2) < 1e-9 and abs(r.az) < 1e-9 for r in got)


def test_masks_of_reaches_of_very_different_lengths(spark):
    clock = spark.createDataFrame([(float(t),) for t in range(1000)], "time double")
    spans = {0: (-5.5, 3.5), 1: (2.0, 900.25), 2: (10.0, 10.0), 3: (400.5, 402.5)}
    kin = spark.createDataFrame([("s", 0, r, x) for r, span in spans.items() for x in span], "session string, stim int, reach int, time double")
    got = sorted((r.reach, r.time) for r in kinematics.mask_to_reach(clock, kin).collect())
    assert got == sorted((r, float(t)) for r, (lo, hi) in spans.items() for t in range(1000) if lo < t < hi)


def test_report_has_the_critical_lines(spark):
    spike = spark.createDataFrame([("s", 0, r, t, c, float((r + t + c) % 2)) for r in range(3) for t in range(4) for c in range(2)], "session string, stim int, reach int, t int, cell int, n double")
    kin = spark.createDataFrame([("s", 0, r, t, float(t + r)) for r in range(3) for t in range(4)], "session string, stim int, reach int, t int, x double")
    h = spark.createDataFrame([("s", 0, 0.5), ("s", 1, -1.0)], "session string, i int, h double")
    j = spark.createDataFrame([("s", 0, 1, 0.25)], "session string, i int, j int, cpl double")
    sweep = spark.createDataFrame([("s", k, 0.5 + k, -1.0 + k, v) for k, v in enumerate((0.1, 0.9, 0.9, 0.2))], "session string, temp_idx int, temp double, mean_e double, var_e double")
    rows = reports.energy_position_report(spike, kin, h, j, sweep=sweep).collect()
    assert {r.series for r in rows} == {"energy", "position"} and {(r.tc, r.ec) for r in rows} == {(1.5, 0.0)}
    assert all(abs(r.spline_ec) < 1e-12 for r in rows)
