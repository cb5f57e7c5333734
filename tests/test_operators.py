"""Known answers of the operators on small tables."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axonframe.functions.spline import spline
from axonframe.functions.student import t_for_many, t_quantile, t_tail
from axonframe.operators import binning, energy, kinematics, rates, stats
from axonframe.plans import reports


def spike(spark, *reaches, cell=0):
    rows = [("s", 0, r, t, cell, float(n)) for r, values in enumerate(reaches) for t, n in enumerate(values)]
    return spark.createDataFrame(rows, "session string, stim int, reach int, t int, cell int, n double")


def fired(df):
    return [r.fired for r in df.orderBy("reach" if "reach" in df.columns else "pos", "pos").collect()]


def test_bin_or(spark):
    assert fired(binning.bin_or(spike(spark, [0, 1, 0, 0, 0]), 2)) == [1, 1, 0, 0]
    both = spike(spark, [0, 0, 1], [0, 0, 0])
    assert fired(binning.bin_or(both, 2)) == [0, 1, 0, 0]
    assert fired(binning.bin_or(both, 2, ("session", "cell"), ("reach", "t"))) == [0, 1, 1, 0, 0]
    assert binning.bin_or(spike(spark, [1, 1]), 3).count() == 0


def test_perturbation_number_and_scan(spark):
    one = spike(spark, [0, 1, 0, 0, 0])
    assert binning.perturbation_number(one, 2).first().n_c == 1.0
    assert binning.perturbation_number(spike(spark, [0, 0, 0]), 2).first().n_c == math.inf
    rng = np.random.default_rng(0)
    some = spike(spark, (rng.random(60) < 0.1).astype(int), (rng.random(40) < 0.1).astype(int))
    scan = {r.width: r.n_c for r in binning.bin_size_scan(some, 1, 12).collect()}
    for width in (1, 4, 11):
        assert scan[width] == pytest.approx(binning.perturbation_number(some, width).first().n_c)


def test_segments_and_filters(spark):
    rows = spark.range(700).select(F.col("id").cast("int").alias("t"))
    assert [binning.segment(rows, s).count() for s in ("pre", "active", "mid", "full")] == [451, 249, 150, 700]
    with pytest.raises(ValueError):
        binning.segment(rows, "late")
    cells = spark.createDataFrame([(1, "PC"), (2, ""), (3, None), (4, "MLI")], "cell int, cell_type string")
    assert [r.cell for r in binning.purkinje_only(cells).collect()] == [1]
    assert binning.purkinje_only(cells, all_cells=True).count() == 4
    ragged = spike(spark, [1, 1, 1, 1], [1, 1])
    assert binning.truncate_to_shortest(ragged).count() == 4
    assert binning.min_cells(ragged, 2).count() == 0 and binning.min_cells(ragged, 1).count() == 6


def test_q_histogram(spark):
    states = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 1, -1, -1])] + [(1, i, 1) for i in range(4)], "state int, i int, s int")
    rows = binning.q_histogram(states, 4).orderBy("bin").collect()
    assert [(r.bin, round(r.left_edge, 6), r["count"]) for r in rows] == [(0, 0.75, 1), (3, 0.9375, 1)]
    assert sum(r.density for r in rows) * (0.25 / 4) == pytest.approx(1)


def test_rolling_rate(spark):
    got = [r.rate for r in rates.rolling_rate(spike(spark, [1, 0, 1, 1, 0]), 3).orderBy("t").collect()]
    assert got == pytest.approx([0, 0, 2 / 3, 2 / 3, 2 / 3])


def kin(spark, values, times=None):
    rows = [("s", 0, 0, t, float(times[t] if times else t), float(v)) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "session string, stim int, reach int, t int, time double, x double")


def test_derivatives(spark):
    got = kinematics.derivative(kin(spark, [1, 4, 9, 20], [0, 0.5, 1, 1.5]), "x").orderBy("t").collect()
    assert [r.d_x for r in got] == pytest.approx([6, 8, 16, 22])
    cubic = kinematics.derivative(kin(spark, [t**3 for t in range(8)]), "x", "spline").orderBy("t").collect()
    assert [r.d_x for r in cubic] == pytest.approx([3 * t**2 for t in range(8)])
    assert kinematics.derivative(kin(spark, [5]), "x").first().d_x is None


def test_interpolate_and_mask(spark):
    k = kin(spark, [10, 20, 0], [1, 2, 3])
    clock = spark.createDataFrame([("s", 0, 0, t) for t in (0.5, 1.5, 2.0, 2.5, 3.5)], "session string, stim int, reach int, time double")
    assert [r.x for r in kinematics.interpolate(clock, k, ["x"]).orderBy("time").collect()] == [None, 15, 20, 10, None]
    times = spark.createDataFrame([(t,) for t in (1.0, 1.5, 3.0)], "time double")
    assert [r.time for r in kinematics.mask_to_reach(times, k).collect()] == [1.5]


def test_rescale_and_crossing(spark):
    scaled = kinematics.rescale(kin(spark, [2, 4, 6]), "x")
    assert [r.x for r in scaled.orderBy("t").collect()] == [0, 0.5, 1]
    assert [r.x for r in kinematics.rescale(kin(spark, [2, 4, 6]), "x", -1, 1).orderBy("t").collect()] == [-1, 0, 1]
    assert [r.x for r in kinematics.rescale(kin(spark, [3, 3]), "x", -1, 1).collect()] == [-1, -1]
    assert kinematics.first_crossing(scaled).first().t_cross == 2
    assert kinematics.first_crossing(kin(spark, [0, 0])).count() == 0


def test_accelerations(spark):
    rows = [("s", 0, 0, t, float(t), 1.0, float(t), float(t * t)) for t in range(6)]
    k = spark.createDataFrame(rows, "session string, stim int, reach int, t int, time double, vx double, vy double, vz double")
    got = kinematics.with_accelerations(k).orderBy("t").collect()[2]
    assert (got.ax, got.ay, got.az, got.jerk_y, got.jerk_pos_x) == (0, 1, 4, 0, 4)


def test_student():
    assert t_quantile(0.975, 2) == pytest.approx(4.302653, abs=1e-6)
    assert t_quantile(0.975, 30) == pytest.approx(2.042272, abs=1e-6)
    assert t_tail(0.0, 5) == pytest.approx(1) and t_tail(2.570582, 5) == pytest.approx(0.05, abs=1e-6)


def test_many_degrees_of_freedom(spark):
    got = spark.range(1).select(t_for_many(0.95, F.lit(150)).alias("t")).first().t
    assert got == pytest.approx(t_quantile(0.975, 150), abs=1e-7)


def test_mean_ci(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 7.0)], "k string, v double")
    a, b = stats.mean_ci(df, ["k"], "v").orderBy("k").collect()
    assert (a.mean, a.lower, a.upper) == pytest.approx((2, 2 - 2.484138, 2 + 2.484138), abs=1e-6)
    assert (b.mean, b.lower, b.upper) == (7, None, None)


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 2.0), ("a", 2, 1.0)], "k string, o int, v double")
    assert stats.argmax_first(df, ["k"], "v", "o").first().o == 0
    assert spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "e double").agg(stats.heat_capacity("e").alias("c")).first().c == pytest.approx(2 / 3)


def test_classification(spark):
    rate = spark.createDataFrame([("s", 0, c, t, y) for c, ys in enumerate([[1, 0.5, 0.5, 0], [0, 0, 0, 0], [0, 1, 2, 3]]) for t, y in enumerate(map(float, ys))], "session string, stim int, cell int, t int, rate double")
    position = spark.createDataFrame([("s", 0, t, float(t)) for t in range(4)], "session string, stim int, t int, x double")
    h = spark.createDataFrame([("s", 0, c, 0.5) for c in range(3)], "session string, stim int, cell int, h double")
    got = {r.cell: r for r in rates.classify_cells(rate, position, h, skip=0).collect()}
    assert {c: r.kind for c, r in got.items()} == {0: "pauser", 2: "burster"}
    assert (got[0].slope, got[0].intercept) == pytest.approx((-0.3, 0.95))
    flat = position.withColumn("x", F.lit(1.0))
    assert rates.classify_cells(rate, flat, h, skip=0).count() == 0


def test_reactive_test(spark):
    rows = [("s", s, s, t, 0, float(v)) for s, vs in enumerate([[1, 2, 3], [2, 4, 6]]) for t, v in enumerate(vs)]
    spikes = spark.createDataFrame(rows, "session string, stim int, reach int, t int, cell int, n double")
    crossing = spark.createDataFrame([("s", 0, 0, 0), ("s", 1, 1, 0)], "session string, stim int, reach int, t_cross int")
    r = rates.reactive_test(spikes, crossing, 1).first()
    assert (r.t, r.df) == (pytest.approx(-1.549193, abs=1e-6), 4)
    assert r.p == pytest.approx(t_tail(1.549193, 4), abs=1e-6)


def tiny_model(spark):
    return spark.createDataFrame([(0, 0.5), (1, -1.0)], "i int, h double"), spark.createDataFrame([(0, 1, 0.25)], "i int, j int, cpl double")


def test_energy(spark):
    states = [(1, -1), (1, 1), (1, 0), (-1, -1)]
    h, j = tiny_model(spark)
    long = spark.createDataFrame([(k, i, s) for k, x in enumerate(states) for i, s in enumerate(x)], "state int, i int, s int")
    assert [r.energy for r in energy.ising_energy_sql(long, h, j).orderBy("state").collect()] == pytest.approx([-1.25, 0.25, -0.5, -0.75])
    arrays = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(states)], "state int, s array<double>").crossJoin(energy.model_arrays(h, j))
    assert [r.e for r in arrays.select("state", energy.ising_energy("s", "h", "cpl").alias("e")).orderBy("state").collect()] == pytest.approx([-1.25, 0.25, -0.5, -0.75])


def test_exact_enumeration_and_critical_point(spark):
    temps = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 2.0)], "temp_idx int, temp double")
    rows = energy.boltzmann_exact(*tiny_model(spark), temps, 2).orderBy("temp_idx")
    got = [(r.mean_e, r.var_e) for r in rows.collect()]
    assert np.ravel(got) == pytest.approx([-1.062655, 0.124252, -0.831089, 0.410728, -0.535720, 0.809652], abs=1e-6)
    keyed = rows.withColumn("session", F.lit("s"))
    at = reports.critical_point(keyed, ["session"])
    assert at.first().tc == 2.0
    assert reports.spline_energy(keyed, at, ["session"]).first().spline_ec == pytest.approx(-0.535720, abs=1e-6)
    assert reports.two_branch_critical(keyed, keyed, ["session"]).first().ec == pytest.approx(-0.535720, abs=1e-6)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=4, max_size=4), st.integers(4, 20))
def test_spline_reproduces_cubics(coefficients, n):
    x = np.linspace(0, 3, n)
    at = np.linspace(0, 3, 17)
    assert spline(x, np.polyval(coefficients, x), at) == pytest.approx(np.polyval(coefficients, at), abs=1e-8)
    assert spline(x, np.polyval(coefficients, x), at, True) == pytest.approx(np.polyval(np.polyder(coefficients), at), abs=1e-7)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([-1.0, 1.0]), min_size=5, max_size=5), st.lists(st.floats(-2, 2), min_size=10, max_size=10))
def test_energy_is_even_without_fields(s, cpl):
    s, h = np.array([s]), np.zeros(5)
    assert energy.energies(s, h, np.array(cpl)) == pytest.approx(energy.energies(-s, h, np.array(cpl)))


def test_k_corr_and_moments(spark):
    rng = np.random.default_rng(1)
    s = rng.choice([-1, 1], (50, 5))
    long = spark.createDataFrame([(int(k), int(i), int(s[k, i])) for k in range(50) for i in range(5)], "state int, i int, s int")
    got = {tuple(r.subset): r["corr"] for r in stats.k_corr(long, 3).collect()}
    assert len(got) == 10 and all(v == pytest.approx(s[:, list(k)].prod(axis=1).mean()) for k, v in got.items())
    m = {(r.i, r.j): r["mean"] for r in stats.moments(long).collect()}
    assert len(m) == 15 and m[1, 3] == pytest.approx((s[:, 1] * s[:, 3]).mean()) and m[2, None] == pytest.approx(s[:, 2].mean())
