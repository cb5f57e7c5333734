"""Queries over the test tables by name, and SQL for DuckDB that gives the same rows where SQL can.

Floats are rounded to six decimals on both sides: sums depend on the order of their terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonframe.functions.student import t_quantile
from axonframe.operators import binning, energy, kinematics, rates, sampling, stats
from axonframe.plans import reports, testdata
from axonframe.session import new_path
from axonframe.sources import mat, sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Shared parts of the SQL.
WITH = """WITH ev AS (
  SELECT CAST(day(ts) AS INTEGER) AS reach, CAST((day(ts) - 1) % 3 AS INTEGER) AS stim,
         CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 900 AS INTEGER) AS t, CAST(user_id % 8 AS INTEGER) AS cell, user_id, value FROM events),
spike AS (
  SELECT CAST((r - 1) % 3 AS INTEGER) AS stim, CAST(r AS INTEGER) AS reach, CAST(g AS INTEGER) AS t, CAST(c AS INTEGER) AS cell, coalesce(n, 0)::DOUBLE AS n
  FROM range(1, 31) a(r), range(96) b(g), range(8) d(c)
  LEFT JOIN (SELECT reach, t, cell, count(*) AS n FROM ev GROUP BY ALL) k ON k.reach = r AND k.t = g AND k.cell = c),
kin AS (SELECT stim, reach, t, avg(value) AS x FROM ev GROUP BY ALL),
spin AS (
  SELECT vec_id AS state, label, CAST(i AS INTEGER) AS i, CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE -1 END AS s FROM embeddings, range(64) p(i)),
m1 AS (SELECT i, avg(s) AS mean FROM spin GROUP BY i),
m2 AS (SELECT a.i, b.i AS j, avg(a.s * b.s) AS mean FROM spin a JOIN spin b ON a.state = b.state AND a.i < b.i GROUP BY ALL),
model_h AS (SELECT i, atanh(mean) AS h FROM m1),
model_j AS (SELECT m2.i, m2.j, m2.mean - a.mean * b.mean AS cpl FROM m2 JOIN m1 a ON a.i = m2.i JOIN m1 b ON b.i = m2.j),
cut AS (SELECT stim, reach, t, x FROM (SELECT *, min(len) OVER (PARTITION BY stim) AS shortest FROM
         (SELECT stim, reach, row_number() OVER (PARTITION BY stim, reach ORDER BY t) - 1 AS t, x, count(*) OVER (PARTITION BY stim, reach) AS len FROM kin)) WHERE t < shortest),
scaled AS (SELECT stim, reach, t, CASE WHEN max(x) OVER w = min(x) OVER w THEN 0 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END AS u FROM kin WINDOW w AS (PARTITION BY reach))
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = WITH + sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.numbered(testdata.kinematics(spark, sf_dir))


def _model(spark: SparkSession, sf_dir: str, cells: int = 64) -> tuple[DataFrame, DataFrame]:
    return stats.stand_in_model(testdata.spins(spark, sf_dir, cells))


@query("SELECT stim, reach, t, cell, n FROM spike")
def spike_grid(spark, sf_dir):
    return testdata.spikes(spark, sf_dir).select("stim", "reach", "t", "cell", "n")


@query("""SELECT stim, reach, cell, CAST(t AS INTEGER) AS pos, fired FROM (
  SELECT *, CAST(sum(n) OVER w > 0 AS INTEGER) AS fired, count(*) OVER w AS c FROM spike
  WINDOW w AS (PARTITION BY stim, reach, cell ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE c = 10""")
def bin_or_b10(spark, sf_dir):
    return binning.bin_or(testdata.spikes(spark, sf_dir), 10).drop("session")


@query("""SELECT stim, cell, CAST(pos AS INTEGER) AS pos, fired FROM (
  SELECT stim, cell, row_number() OVER o - 1 AS pos, CAST(sum(n) OVER w > 0 AS INTEGER) AS fired, count(*) OVER w AS c FROM spike
  WINDOW o AS (PARTITION BY stim, cell ORDER BY reach, t), w AS (PARTITION BY stim, cell ORDER BY reach, t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE c = 10""")
def bin_or_cross_reach(spark, sf_dir):
    return binning.bin_or(testdata.spikes(spark, sf_dir), 10, ("stim", "cell"), ("reach", "t"))


@query("SELECT state, label, i, s FROM spin")
def spins_pm1(spark, sf_dir):
    s = testdata.spins(spark, sf_dir)
    return s.select("state", "label", "i", binning.to_spin(binning.binarize(F.col("s"))).alias("s"))


@query("""SELECT name AS segment, stim, reach, cell, count(*) AS n_rows, sum(n) AS spikes
  FROM spike JOIN (VALUES ('pre', 0, 45), ('active', 45, 96), ('mid', 45, 60), ('full', 0, 96)) v(name, lo, hi) ON t >= lo AND t < hi GROUP BY ALL""")
def segment_pre_mid_active(spark, sf_dir):
    rows = testdata.spikes(spark, sf_dir).withColumn("segment", F.explode(binning.segments_of(F.col("t"), 45, 60)))
    return rows.groupBy("segment", "stim", "reach", "cell").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("spikes"))


@query("""SELECT reach, count(DISTINCT user_id % 24) AS n_cells, count(*) AS n_events FROM ev GROUP BY reach HAVING count(DISTINCT user_id % 24) >= 20""")
def session_gate(spark, sf_dir):
    kept = binning.min_cells(testdata.events(spark, sf_dir, 24), 20, ("reach",))
    return kept.groupBy("reach").agg(F.countDistinct("cell").alias("n_cells"), F.count(F.lit(1)).alias("n_events"))


@query("""SELECT stim, CAST(10 AS INTEGER) AS width, round(1 / (avg(fired) * 10), 6) AS n_c FROM (
  SELECT stim, CAST(sum(n) OVER w > 0 AS INTEGER) AS fired, count(*) OVER w AS c FROM spike
  WINDOW w AS (PARTITION BY stim, cell ORDER BY reach, t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE c = 10 GROUP BY stim""")
def perturbation_number(spark, sf_dir):
    return binning.perturbation_number(testdata.spikes(spark, sf_dir), 10, ("stim",)).withColumn("n_c", r6("n_c"))


@query(""", p AS (SELECT stim, cell, row_number() OVER w AS pos, sum(n) OVER w AS upto FROM spike WINDOW w AS (PARTITION BY stim, cell ORDER BY reach, t))
  SELECT b.stim, CAST(width AS INTEGER) AS width, round(1 / (avg(CASE WHEN b.upto > coalesce(a.upto, 0) THEN 1 ELSE 0 END) * width), 6) AS n_c
  FROM range(1, 200) g(width) JOIN p b ON b.pos >= width LEFT JOIN p a ON a.stim = b.stim AND a.cell = b.cell AND a.pos = b.pos - width GROUP BY b.stim, width""")
def bin_size_scan(spark, sf_dir):
    return binning.bin_size_scan(testdata.spikes(spark, sf_dir), 1, 200, ("stim",)).withColumn("n_c", r6("n_c"))


@query(""", q AS (SELECT state, sum((s + 1) / 2) / 128.0::DOUBLE + 0.5 AS q FROM spin GROUP BY state), e AS (SELECT min(q) AS lo, max(q) AS hi, count(*) AS n FROM q)
  SELECT bin, round(lo + bin * ((hi - lo) / 100), 6) AS left_edge, count(*) AS count, round(count(*) / (n * ((hi - lo) / 100)), 6) AS density
  FROM (SELECT CAST(least(floor((q - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bin, lo, hi, n FROM q, e) GROUP BY bin, lo, hi, n""")
def q_histogram(spark, sf_dir):
    h = binning.q_histogram(testdata.spins(spark, sf_dir))
    return h.select("bin", r6("left_edge").alias("left_edge"), "count", r6("density").alias("density"))


RATE = """rate AS (SELECT stim, reach, cell, t, CASE WHEN row_number() OVER w >= 10 THEN avg(n) OVER (PARTITION BY stim, reach, cell ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) ELSE 0 END AS rate
  FROM spike WINDOW w AS (PARTITION BY stim, reach, cell ORDER BY t))"""


@query(f", {RATE} SELECT stim, reach, cell, t, round(rate, 6) AS rate FROM rate")
def rolling_rate(spark, sf_dir):
    return rates.rolling_rate(testdata.spikes(spark, sf_dir), 10).select("stim", "reach", "cell", "t", r6("rate").alias("rate"))


@query(f", {RATE} SELECT stim, cell, t, round(avg(rate), 6) AS rate FROM rate GROUP BY ALL")
def rolling_rate_all_reach(spark, sf_dir):
    return rates.rolling_rate_all_reach(testdata.spikes(spark, sf_dir), 10).select("stim", "cell", "t", r6("rate").alias("rate"))


@query("SELECT stim, CAST(t AS INTEGER) AS t, round(avg(x), 6) AS x FROM cut GROUP BY ALL")
def average_position(spark, sf_dir):
    return kinematics.average_position(_numbered(spark, sf_dir)).select("stim", "t", r6("x").alias("x"))


@query("""SELECT stim, reach, t, round(CASE WHEN lag(x) OVER w IS NULL THEN (lead(x) OVER w - x) / step WHEN lead(x) OVER w IS NULL THEN (x - lag(x) OVER w) / step
    ELSE (lead(x) OVER w - lag(x) OVER w) / (2 * step) END, 6) AS d_x
  FROM (SELECT *, nth_value(t, 2) OVER f - min(t) OVER f AS step FROM kin WINDOW f AS (PARTITION BY reach ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WINDOW w AS (PARTITION BY reach ORDER BY t)""")
def derivative_central(spark, sf_dir):
    return kinematics.derivative(testdata.kinematics(spark, sf_dir), "x").select("stim", "reach", "t", r6("d_x").alias("d_x"))


def spline_sql(points: str, out: str) -> str:
    """SQL for {out}_m (g, k, n, x, y, h, d, m): points (g, k from 0, x, y, n) of at least four a group, with the step, the
    slope and the second derivative of the cubic spline at each; three diagonals are solved by recursion."""
    return f"""{out}_h AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d FROM {points} WINDOW w AS (PARTITION BY g ORDER BY k)),
  {out}_t AS (SELECT b.g, b.k, b.n, a.h - CASE WHEN b.k = b.n - 2 THEN b.h * b.h / a.h ELSE 0 END AS lo, b.h - CASE WHEN b.k = 1 THEN a.h * a.h / b.h ELSE 0 END AS up, 6 * (b.d - a.d) AS rhs,
      2 * (a.h + b.h) + CASE WHEN b.k = 1 THEN a.h * (a.h + b.h) / b.h ELSE 0 END + CASE WHEN b.k = b.n - 2 THEN b.h * (a.h + b.h) / a.h ELSE 0 END AS mid
      FROM {out}_h a JOIN {out}_h b ON a.g = b.g AND b.k = a.k + 1 WHERE b.k <= b.n - 2),
  {out}_f(g, k, n, c, r) AS (SELECT g, k, n, up / mid, rhs / mid FROM {out}_t WHERE k = 1 UNION ALL
      SELECT t.g, t.k, t.n, t.up / (t.mid - t.lo * f.c), (t.rhs - t.lo * f.r) / (t.mid - t.lo * f.c) FROM {out}_f f JOIN {out}_t t ON t.g = f.g AND t.k = f.k + 1),
  {out}_b(g, k, m) AS (SELECT g, k, r FROM {out}_f WHERE k = n - 2 UNION ALL SELECT f.g, f.k, f.r - f.c * b.m FROM {out}_b b JOIN {out}_f f ON f.g = b.g AND f.k = b.k - 1),
  {out}_m AS (SELECT h.*, CASE WHEN h.k = 0 THEN ((h.h + h1.h) * b1.m - h.h * b2.m) / h1.h WHEN h.k = h.n - 1 THEN ((g1.h + g2.h) * c1.m - g1.h * c2.m) / g2.h ELSE b.m END AS m FROM {out}_h h
      LEFT JOIN {out}_b b ON b.g = h.g AND b.k = h.k LEFT JOIN {out}_h h1 ON h1.g = h.g AND h1.k = 1 LEFT JOIN {out}_b b1 ON b1.g = h.g AND b1.k = 1 LEFT JOIN {out}_b b2 ON b2.g = h.g AND b2.k = 2
      LEFT JOIN {out}_h g1 ON g1.g = h.g AND g1.k = h.n - 2 LEFT JOIN {out}_h g2 ON g2.g = h.g AND g2.k = h.n - 3 LEFT JOIN {out}_b c1 ON c1.g = h.g AND c1.k = h.n - 2 LEFT JOIN {out}_b c2 ON c2.g = h.g AND c2.k = h.n - 3)"""


def spline_slopes(points: str, out: str) -> str:
    """SQL for `out` (g, x, slope): the spline's derivative at its points."""
    return f"""{spline_sql(points, out)},
  {out} AS (SELECT g, x, CASE WHEN k < n - 1 THEN d - h * (2 * m + lead(m) OVER w) / 6 ELSE lag(d) OVER w + lag(h) OVER w * (lag(m) OVER w + 2 * m) / 6 END AS slope FROM {out}_m WINDOW w AS (PARTITION BY g ORDER BY k))"""


def recursive(name: str) -> None:
    ORACLES[name] = ORACLES[name].replace("WITH ev", "WITH RECURSIVE ev", 1)


@query(f""", pt AS (SELECT reach AS g, row_number() OVER (PARTITION BY reach ORDER BY t) - 1 AS k, t::DOUBLE AS x, x AS y, count(*) OVER (PARTITION BY reach) AS n FROM kin), {spline_slopes("pt", "sl")}
  SELECT stim, reach, t, round(slope, 6) AS d_x FROM kin JOIN sl ON g = reach AND sl.x = t""")
def derivative_spline(spark, sf_dir):
    return kinematics.derivative(testdata.kinematics(spark, sf_dir), "x", "spline").select("stim", "reach", "t", r6("d_x").alias("d_x"))


@query("""SELECT stim, reach, CAST(c AS INTEGER) AS t FROM range(96) g(c) JOIN (SELECT stim, reach, min(t) AS lo, max(t) AS hi FROM kin GROUP BY ALL) ON c > lo AND c < hi""")
def interval_mask(spark, sf_dir):
    clock = spark.range(testdata.ROWS).select(F.col("id").cast("double").alias("time"), F.col("id").cast("int").alias("t"))
    return kinematics.mask_to_reach(clock, testdata.kinematics(spark, sf_dir)).select("stim", "reach", "t")


@query(""", c AS (SELECT stim, reach, g + 0.5::DOUBLE AS time FROM range(96) r(g), (SELECT DISTINCT stim, reach FROM kin)),
  b AS (SELECT c.*, kin.t AS t0, kin.x AS x0 FROM c ASOF LEFT JOIN kin ON c.reach = kin.reach AND c.time >= kin.t),
  a AS (SELECT b.*, kin.t AS t1, kin.x AS x1 FROM b ASOF LEFT JOIN kin ON b.reach = kin.reach AND b.time <= kin.t)
  SELECT stim, reach, time, round(x0 + (x1 - x0) * (time - t0) / (t1 - t0), 6) AS x FROM a""")
def interp_linear(spark, sf_dir):
    kin = testdata.kinematics(spark, sf_dir)
    half = spark.range(testdata.ROWS).select((F.col("id") + 0.5).cast("double").alias("time"))
    clock = kin.select("session", "stim", "reach").distinct().crossJoin(F.broadcast(half))
    return kinematics.interpolate(clock, kin, ["x"]).select("stim", "reach", "time", r6("x").alias("x"))


@query("SELECT stim, reach, t, round(u, 6) AS x FROM scaled")
def rescale_unit(spark, sf_dir):
    return kinematics.rescale(testdata.kinematics(spark, sf_dir), "x").select("stim", "reach", "t", r6("x").alias("x"))


@query("SELECT stim, reach, t, round(2 * u - 1, 6) AS x FROM scaled")
def rescale_signed(spark, sf_dir):
    return kinematics.rescale(testdata.kinematics(spark, sf_dir), "x", -1, 1).select("stim", "reach", "t", r6("x").alias("x"))


def _crossing(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    return kinematics.first_crossing(kinematics.rescale(testdata.kinematics(spark, sf_dir), "x"), "x", threshold)


@query("SELECT stim, reach, min(t) AS t_cross FROM scaled WHERE u > 0.99 GROUP BY ALL")
def first_crossing(spark, sf_dir):
    return _crossing(spark, sf_dir, 0.99).select("stim", "reach", "t_cross")


@query(""", x AS (SELECT reach, min(t) AS t0 FROM scaled WHERE u > 0.5 GROUP BY reach),
  w AS (SELECT stim, reach, cell, t, n, count(*) OVER (PARTITION BY reach, cell) AS c FROM spike JOIN x USING (reach) WHERE t >= t0 AND t < t0 + 50),
  r AS (SELECT stim, cell, CASE WHEN row_number() OVER o >= 5 THEN avg(n) OVER (PARTITION BY reach, cell ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE 0 END AS rate FROM w WHERE c >= 4 WINDOW o AS (PARTITION BY reach, cell ORDER BY t)),
  g AS (SELECT cell, avg(rate) FILTER (stim = 0) AS m0, var_samp(rate) FILTER (stim = 0) AS v0, count(*) FILTER (stim = 0) AS n0,
               avg(rate) FILTER (stim = 1) AS m1, var_samp(rate) FILTER (stim = 1) AS v1, count(*) FILTER (stim = 1) AS n1 FROM r WHERE stim < 2 GROUP BY cell)
  SELECT cell, n0 + n1 - 2 AS df, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)), 6) AS t FROM g""")
def ttest_stat(spark, sf_dir):
    return rates.reactive_test(testdata.spikes(spark, sf_dir), _crossing(spark, sf_dir), 5).select("cell", "df", r6("t").alias("t"))


def tails(table: str, keys: str) -> str:
    """SQL for p (keys, p): two-sided p-values of `table` (keys, t, df), by the finite sums for whole degrees of freedom."""
    return f"""tk AS (SELECT *, atan(abs(t) / sqrt(df)) AS theta, df % 2 AS odd, CASE WHEN df % 2 = 1 THEN (df - 1) // 2 ELSE df // 2 END AS terms FROM {table}),
  tz AS (SELECT {keys}, k, theta, odd, sum(CASE WHEN k = 0 THEN 0 WHEN odd = 1 THEN ln(2.0::DOUBLE * k / (2 * k + 1)) ELSE ln((2.0::DOUBLE * k - 1) / (2 * k)) END) OVER (PARTITION BY {keys} ORDER BY k) AS l FROM tk, range(2000) r(k) WHERE k < terms),
  tq AS (SELECT {keys}, sum(exp(l) * cos(theta) ** (2 * k + odd)) AS s FROM tz GROUP BY {keys}),
  p AS (SELECT {keys}, 1 - CASE WHEN odd = 1 THEN 2 / pi() * (theta + sin(theta) * coalesce(s, 0)) ELSE sin(theta) * s END AS p FROM tk LEFT JOIN tq USING ({keys}))"""


@query(ORACLES["ttest_stat"].removeprefix(WITH).replace("SELECT cell, n0 + n1 - 2 AS df, round((m0", "SELECT cell, n0 + n1 - 2 AS df, ((m0").replace(", 6) AS t FROM g", ") AS t FROM g").replace("SELECT cell, n0", ", tt AS (SELECT cell, n0") + "), " + tails("tt", "cell") + " SELECT cell, round(p, 6) AS p FROM p")
def ttest_pvalue(spark, sf_dir):
    return rates.reactive_test(testdata.spikes(spark, sf_dir), _crossing(spark, sf_dir), 5).select("cell", r6("p").alias("p"))


T95 = ", ".join(f"({d}, {t_quantile(0.975, d)!r}::DOUBLE)" for d in range(1, 31))
CI = "round(avg({v}), 6) AS mean, round(avg({v}) - stddev_samp({v}) / sqrt(count(*)) * any_value(q), 6) AS lower, round(avg({v}) + stddev_samp({v}) / sqrt(count(*)) * any_value(q), 6) AS upper"


@query(f"""SELECT stim, t, {CI.format(v="x")} FROM (SELECT *, count(*) OVER (PARTITION BY stim, t) - 1 AS df FROM kin) LEFT JOIN (VALUES {T95}) v(d, q) ON d = df GROUP BY stim, t""")
def mean_ci(spark, sf_dir):
    ci = stats.mean_ci(testdata.kinematics(spark, sf_dir), ["stim", "t"], "x")
    return ci.select("stim", "t", *[r6(c).alias(c) for c in ("mean", "lower", "upper")])


@query(f""", {RATE}, a AS (SELECT stim, cell, t, avg(rate) AS rate FROM rate GROUP BY ALL), pos AS (SELECT stim, CAST(t AS INTEGER) AS t, avg(x) AS x FROM cut GROUP BY ALL),
  f AS (SELECT stim, cell, regr_slope(rate, x) AS slope, regr_intercept(rate, x) AS intercept, count(*) AS n_rows, sqrt((regr_syy(rate, x) - regr_sxy(rate, x) ** 2 / regr_sxx(rate, x)) / (count(*) - 2) / regr_sxx(rate, x)) AS std_err
        FROM a JOIN pos USING (stim, t) WHERE t >= 10 GROUP BY ALL),
  tt AS (SELECT stim, cell, slope / std_err AS t, n_rows - 2 AS df FROM f), {tails("tt", "stim, cell")}
  SELECT stim, cell, CASE WHEN slope < 0 THEN 'pauser' ELSE 'burster' END AS kind, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n_rows, round(h, 6) AS h, round(std_err, 6) AS std_err, round(p, 6) AS p
  FROM f JOIN p USING (stim, cell) JOIN model_h ON i = cell WHERE slope <> 0 AND NOT isnan(slope)""")
def pauser_burster(spark, sf_dir):
    """Cells by the slope of their mean rate over the mean position: the flagship query."""
    rate = rates.rolling_rate_all_reach(testdata.spikes(spark, sf_dir), 10)
    position = kinematics.average_position(_numbered(spark, sf_dir))
    h, _ = _model(spark, sf_dir, 8)
    stim = rate.select("session", "stim").distinct()
    found = rates.classify_cells(rate, position, stim.crossJoin(F.broadcast(h.select(F.col("i").alias("cell"), "h"))), skip=10)  # one row a cell
    return found.select("stim", "cell", "kind", r6("slope").alias("slope"), r6("intercept").alias("intercept"), F.col("rows").alias("n_rows"), r6("h").alias("h"), r6("std_err").alias("std_err"), r6("p").alias("p"))


@query("SELECT i, CAST(NULL AS INTEGER) AS j, round(mean, 6) AS mean FROM m1 UNION ALL SELECT i, j, round(mean, 6) FROM m2")
def moments_1_2(spark, sf_dir):
    return stats.moments(testdata.spins(spark, sf_dir)).select("i", "j", r6("mean").alias("mean"))


@query("""SELECT [a.i, b.i, c.i] AS subset, round(avg(a.s * b.s * c.s), 6) AS corr FROM spin a JOIN spin b ON a.state = b.state AND a.i < b.i JOIN spin c ON a.state = c.state AND b.i < c.i GROUP BY ALL""")
def k_corr_3(spark, sf_dir):
    return stats.k_corr(testdata.spins(spark, sf_dir), 3).select("subset", r6("corr").alias("corr"))


@query("""SELECT [a.i, b.i, c.i, d.i] AS subset, round(avg(a.s * b.s * c.s * d.s), 6) AS corr FROM spin a JOIN spin b ON a.state = b.state AND a.i < b.i
  JOIN spin c ON a.state = c.state AND b.i < c.i JOIN spin d ON a.state = d.state AND c.i < d.i GROUP BY ALL""")
def k_corr_4(spark, sf_dir):
    return stats.k_corr(testdata.spins(spark, sf_dir), 4).select("subset", r6("corr").alias("corr"))


@query(""", few AS (SELECT * FROM spin WHERE i < 16) SELECT [a.i, b.i, c.i, d.i, e.i] AS subset, round(avg(a.s * b.s * c.s * d.s * e.s), 6) AS corr FROM few a JOIN few b ON a.state = b.state AND a.i < b.i
  JOIN few c ON a.state = c.state AND b.i < c.i JOIN few d ON a.state = d.state AND c.i < d.i JOIN few e ON a.state = e.state AND d.i < e.i GROUP BY ALL""")
def k_corr_5(spark, sf_dir):
    return stats.k_corr(testdata.spins(spark, sf_dir, 16), 5).select("subset", r6("corr").alias("corr"))


ENERGY = """SELECT {k}, round(sum(e), 6) AS energy FROM (
  SELECT {k}, -h * s AS e FROM {t} JOIN model_h USING (i) UNION ALL
  SELECT {ka}, -cpl * a.s * b.s FROM {t} a JOIN {t} b ON {on} AND a.i < b.i JOIN model_j m ON m.i = a.i AND m.j = b.i) GROUP BY ALL"""


@query(ENERGY.format(k="state", ka="a.state", t="spin", on="a.state = b.state"))
def ising_energy_pm1(spark, sf_dir):
    h, j = _model(spark, sf_dir)
    return energy.ising_energy_sql(testdata.spins(spark, sf_dir), h, j).select("state", r6("energy").alias("energy"))


@query(ENERGY.format(k="state", ka="a.state", t="spin", on="a.state = b.state"))
def ising_energy_array(spark, sf_dir):
    h, j = _model(spark, sf_dir)
    states = testdata.spins(spark, sf_dir).groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"].cast("double")).alias("s"))
    model = energy.model_arrays(h, j)  # one row
    return states.crossJoin(F.broadcast(model)).select("state", r6(energy.ising_energy("s", "h", "cpl")).alias("energy"))


@query(", s01 AS (SELECT stim, reach, t, cell AS i, CASE WHEN n > 0 THEN 1 ELSE 0 END AS s FROM spike) " + ENERGY.format(k="stim, reach, t", ka="a.stim, a.reach, a.t", t="s01", on="a.reach = b.reach AND a.t = b.t"))
def ising_energy_01(spark, sf_dir):
    h, j = _model(spark, sf_dir, 8)
    return energy.energy_time(testdata.spikes(spark, sf_dir), h, j, ()).select("stim", "reach", "t", r6("energy").alias("energy"))


@query("SELECT stim, reach, CAST(t AS INTEGER) AS t, round(x, 6) AS x FROM cut")
def position_time(spark, sf_dir):
    return kinematics.position_time(_numbered(spark, sf_dir)).select("stim", "reach", "t", r6("x").alias("x"))


@query(", s01 AS (SELECT stim, reach, t, cell AS i, CASE WHEN n > 0 THEN 1 ELSE 0 END AS s FROM spike), et AS (" + ENERGY.format(k="stim, reach, t", ka="a.stim, a.reach, a.t", t="s01", on="a.reach = b.reach AND a.t = b.t").replace("round(sum(e), 6)", "sum(e)")
       + f") SELECT stim, t, {CI.format(v='energy')} FROM (SELECT *, count(*) OVER (PARTITION BY stim, t) - 1 AS df FROM et) LEFT JOIN (VALUES {T95}) v(d, q) ON d = df GROUP BY stim, t")
def energy_time_ci(spark, sf_dir):
    h, j = _model(spark, sf_dir, 8)
    ci = stats.mean_ci(energy.energy_time(testdata.spikes(spark, sf_dir), h, j, ()), ["stim", "t"], "energy")
    return ci.select("stim", "t", *[r6(c).alias(c) for c in ("mean", "lower", "upper")])


REGULAR = "tg AS (SELECT CAST(k AS INTEGER) AS temp_idx, 0.1::DOUBLE + k * 0.1::DOUBLE AS temp FROM range(29) g(k))"
BOLTZMANN = f""", st AS (SELECT state, CAST(i AS INTEGER) AS i, 2 * ((state >> i) & 1) - 1 AS s FROM range(256) g(state), range(8) p(i)),
  en AS (SELECT state, sum(e) AS e FROM (SELECT state, -h * s AS e FROM st JOIN model_h USING (i) UNION ALL
         SELECT a.state, -cpl * a.s * b.s FROM st a JOIN st b ON a.state = b.state AND a.i < b.i JOIN model_j m ON m.i = a.i AND m.j = b.i) GROUP BY state),
  {REGULAR},
  bz AS (SELECT temp_idx, temp, sum(w) AS z, sum(w * e) / sum(w) AS mean_e, sum(w * e * e) / sum(w) - (sum(w * e) / sum(w)) ** 2 AS var_e
         FROM (SELECT *, exp(-(e - (SELECT min(e) FROM en)) / temp) AS w FROM en, tg) GROUP BY ALL)"""


def _boltzmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, j = _model(spark, sf_dir, 8)
    return energy.boltzmann_exact(h, j, sampling.grid(spark, sampling.regular_temperatures()), 8)


@query(BOLTZMANN + " SELECT temp_idx, round(temp, 6) AS temp, round(mean_e, 6) AS mean_e FROM bz")
def boltzmann_exact(spark, sf_dir):
    return _boltzmann(spark, sf_dir).select("temp_idx", r6("temp").alias("temp"), r6("mean_e").alias("mean_e"))


@query(BOLTZMANN + " SELECT temp_idx, round(var_e, 6) AS heat_capacity FROM bz")
def heat_capacity_exact(spark, sf_dir):
    return _boltzmann(spark, sf_dir).select("temp_idx", r6("var_e").alias("heat_capacity"))


@query(BOLTZMANN + " SELECT 'exact' AS session, temp_idx AS tc_idx, round(temp, 6) AS tc, round(var_e, 6) AS hc, round(mean_e, 6) AS ec FROM bz ORDER BY var_e DESC, temp_idx LIMIT 1")
def critical_point(spark, sf_dir):
    at = reports.critical_point(_boltzmann(spark, sf_dir).withColumn("session", F.lit("exact")), ["session"])
    return at.select("session", "tc_idx", *[r6(c).alias(c) for c in ("tc", "hc", "ec")])


EXACT_TC = "tc AS (SELECT round(temp, 6) AS tc, round(mean_e, 6) AS ec FROM bz ORDER BY var_e DESC, temp_idx LIMIT 1)"


@query(BOLTZMANN + ", " + EXACT_TC + ", s01 AS (SELECT stim, reach, t, cell AS i, CASE WHEN n > 0 THEN 1 ELSE 0 END AS s FROM spike), et AS (" + ENERGY.format(k="stim, reach, t", ka="a.stim, a.reach, a.t", t="s01", on="a.reach = b.reach AND a.t = b.t").replace("round(sum(e), 6)", "sum(e)")
       + f"""), both_series AS (SELECT 'energy' AS series, stim, CAST(t AS INTEGER) AS t, energy AS v FROM et UNION ALL SELECT 'position', stim, CAST(t AS INTEGER), x FROM cut)
  SELECT stim, series, t, {CI.format(v='v')}, any_value(tc) AS tc, any_value(ec) AS ec, any_value(ec) AS spline_ec
  FROM (SELECT *, count(*) OVER (PARTITION BY series, stim, t) - 1 AS df FROM both_series) LEFT JOIN (VALUES {T95}) v(d, q) ON d = df, tc GROUP BY series, stim, t""")  # fmt: skip
def energy_position_report(spark, sf_dir):
    """Energy and position with confidence bands, and the critical lines. The spline goes through the table's points, so
    at the critical temperature, which is one of them, it has the table's energy; the SQL says so."""
    h, j = _model(spark, sf_dir, 8)
    of = F.lit("events").alias("session")
    sweep = _boltzmann(spark, sf_dir).withColumn("session", of)
    report = reports.energy_position_report(testdata.spikes(spark, sf_dir), _numbered(spark, sf_dir), h.select(of, "i", "h"), j.select(of, "i", "j", "cpl"), sweep=sweep)
    return report.select("stim", "series", "t", *[r6(c).alias(c) for c in ("mean", "lower", "upper", "tc", "ec", "spline_ec")])


@query(f"SELECT stim, t, {CI.format(v='x')} FROM (SELECT *, count(*) OVER (PARTITION BY stim, t) - 1 AS df FROM kin) LEFT JOIN (VALUES " + ", ".join(f"({d}, {t_quantile(0.9, d)!r}::DOUBLE)" for d in range(1, 31)) + ") v(d, q) ON d = df GROUP BY stim, t")
def mean_ci_80(spark, sf_dir):
    ci = stats.mean_ci(testdata.kinematics(spark, sf_dir), ["stim", "t"], "x", 0.8)
    return ci.select("stim", "t", *[r6(c).alias(c) for c in ("mean", "lower", "upper")])


@query(BOLTZMANN + ", f AS (SELECT *, row_number() OVER (ORDER BY temp_idx DESC) AS r FROM bz) SELECT round(avg(mean_e), 6) AS mean_e_tail FROM f WHERE r <= 10")
def tail_mean(spark, sf_dir):
    curve = _boltzmann(spark, sf_dir).withColumn("session", F.lit("exact"))
    return reports.tail_mean(curve, ["session"], "mean_e").select(r6("mean_e_tail").alias("mean_e_tail"))


def _branch_sql(name: str, net: str) -> str:
    """SQL like bz for the states whose net spin is over or under 0."""
    return f"""{name}_s AS (SELECT en.state, en.e FROM en JOIN (SELECT state, sum(s) AS net FROM st GROUP BY state) USING (state) WHERE net {net} 0),
  {name} AS (SELECT temp_idx, temp, sum(w * e) / sum(w) AS mean_e, sum(w * e * e) / sum(w) - (sum(w * e) / sum(w)) ** 2 AS var_e FROM (SELECT *, exp(-(e - (SELECT min(e) FROM {name}_s)) / temp) AS w FROM {name}_s, tg) GROUP BY ALL)"""


@query(f"""{BOLTZMANN}, {_branch_sql("up", ">")}, {_branch_sql("down", "<")}
  SELECT up.temp_idx AS tc_idx, round(up.temp, 6) AS tc, round((up.mean_e + down.mean_e) / 2, 6) AS ec FROM up JOIN down USING (temp_idx) ORDER BY up.var_e DESC, up.temp_idx LIMIT 1""")
def two_branch_critical(spark, sf_dir):
    """The branches of states that are mostly up and mostly down, each summed up exactly."""
    h, j = _model(spark, sf_dir, 8)
    up, down = (energy.boltzmann_exact(h, j, sampling.grid(spark, sampling.regular_temperatures()), 8, branch).withColumn("session", F.lit("exact")) for branch in ("up", "down"))
    at = reports.two_branch_critical(up, down, ["session"])
    return at.select("tc_idx", r6("tc").alias("tc"), r6("ec").alias("ec"))


@query(BOLTZMANN + ", tc AS (SELECT temp AS tc, mean_e AS ec FROM bz ORDER BY var_e DESC, temp_idx LIMIT 1) SELECT temp_idx, round(temp, 6) AS temp, round(mean_e, 6) AS mean_e, round(tc, 6) AS tc, round(ec, 6) AS ec FROM bz, tc")
def energy_curve(spark, sf_dir):
    curve = reports.energy_curve(_boltzmann(spark, sf_dir).withColumn("session", F.lit("exact")), ["session"])
    return curve.select("temp_idx", *[r6(c).alias(c) for c in ("temp", "mean_e", "tc", "ec")])


@query(f"""{BOLTZMANN}, pt AS (SELECT 0 AS g, temp_idx AS k, temp AS x, mean_e AS y, count(*) OVER () AS n FROM bz), {spline_sql("pt", "sp")},
  pc AS (SELECT k, x, y, h, m, lead(y) OVER w AS y1, lead(m) OVER w AS m1, unnest([0.25::DOUBLE, 0.5::DOUBLE]) AS f FROM sp_m WINDOW w AS (ORDER BY k)),
  pl AS (SELECT *, (1 - f) * h AS a, f * h AS b FROM pc WHERE y1 IS NOT NULL)
  SELECT round(x + b, 6) AS temp, round((m * a ** 3 + m1 * b ** 3) / (6 * h) + (y / h - m * h / 6) * a + (y1 / h - m1 * h / 6) * b, 6) AS spline_e FROM pl""")
def spline_between(spark, sf_dir):
    """The energy at a quarter and at half of the way between the temperatures of a sweep."""
    sweep = _boltzmann(spark, sf_dir).withColumn("session", F.lit("exact"))
    step = F.lead("temp").over(Window.partitionBy("session").orderBy("temp_idx")) - F.col("temp")
    places = sweep.withColumn("_step", step).where("_step is not null").select("session", F.explode(F.array(F.col("temp") + F.col("_step") / 4, F.col("temp") + F.col("_step") / 2)).alias("temp"))
    return reports.spline_at(sweep, places, ["session"]).select(r6("temp").alias("temp"), r6("spline_e").alias("spline_e"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, kind and day (six digits) of every event, each once."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.date_format("ts", "yyMMdd").alias("day")).distinct()


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


@query("""SELECT mouse, name, CAST(row_number() OVER (PARTITION BY mouse ORDER BY user_id, event_type COLLATE "C") AS INTEGER) AS place
  FROM (SELECT DISTINCT user_id % 7 AS mouse, user_id, event_type, 's' || user_id || '_' || event_type AS name FROM events)""")
def natural_sort(spark, sf_dir):
    """Names of sessions by natural order within a mouse: the numbers in them in order of size."""
    names = _users(spark, sf_dir).select((F.col("user") % 7).alias("mouse"), _text("s", F.col("user"), "_", F.col("kind")).alias("name")).distinct()
    order = Window.partitionBy("mouse").orderBy(sessions.natural_key(F.col("name")))
    return names.select("mouse", "name", F.row_number().over(order).alias("place"))


@query("""SELECT DISTINCT CASE WHEN user_id % 11 = 0 THEN 'bad' || user_id ELSE 'mouse_' || (user_id % 7) || '_' || strftime(ts, '%y%m%d') || '_x' || user_id || CASE WHEN user_id % 3 = 0 THEN '_NPresults.mat' ELSE '.npy' END END AS file,
    CASE WHEN user_id % 11 = 0 THEN '' ELSE 'mouse_' || (user_id % 7) END AS name, CASE WHEN user_id % 11 = 0 THEN '' ELSE strftime(ts, '%y%m%d') END AS date, CASE WHEN user_id % 11 = 0 THEN '' ELSE 'x' || user_id END AS identifier,
    CASE WHEN user_id % 11 = 0 THEN left('bad' || user_id, 4) ELSE 'mous' END AS label FROM events""")
def parse_session_name(spark, sf_dir):
    """File names put together from users and days, and taken apart again; the SQL has the parts themselves."""
    user = F.col("user")
    good = _text("mouse_", user % 7, "_", F.col("day"), "_x", user, F.when(user % 3 == 0, "_NPresults.mat").otherwise(".npy"))
    names = _users(spark, sf_dir).select(F.when(user % 11 == 0, _text("bad", user)).otherwise(good).alias("file")).distinct()
    return names.select("file", sessions.parse_session_name(F.col("file")).alias("p"), sessions.session_label(F.col("file")).alias("label")).select("file", "p.name", "p.date", "p.identifier", "label")


PATHS = """ss AS (SELECT DISTINCT 'm' || (user_id % 5) AS mouse, ['Non_P_Cells', 'All_Cells', 'P_Cells', 'Other'][CAST(user_id // 5 % 4 AS INTEGER) + 1] AS cell_group, user_id // 20 % 3 + 8 AS width, user_id FROM events)"""


@query(f""", {PATHS}, fs AS (SELECT *, min(width) OVER (PARTITION BY mouse, cell_group) AS first FROM ss WHERE cell_group <> 'Other')
  SELECT '/data/' || mouse || '/' || cell_group || '/bin' || width || '/s' || user_id || '.mat' AS path, mouse, cell_group, 'bin' || width AS bin, 's' || user_id || '.mat' AS file,
         CAST(row_number() OVER (PARTITION BY mouse, cell_group ORDER BY user_id) - 1 AS INTEGER) AS place FROM fs WHERE width = first""")
def report_sessions(spark, sf_dir):
    """Paths of sessions, a user each; of every mouse and cell group those in the first bin folder."""
    user = F.col("user")
    group = F.element_at(F.array(*[F.lit(g) for g in (*sessions.CELL_GROUPS, "Other")]), (F.floor(user / 5) % 4 + 1).cast("int"))
    path = _text("/data/m", user % 5, "/", group, "/bin", F.floor(user / 20) % 3 + 8, "/s", user, ".mat")
    return sessions.report_sessions(_users(spark, sf_dir).select(path.alias("path")).distinct()).select("path", "mouse", "cell_group", "bin", "file", "place")


@query("""SELECT mouse, cell_group, session, CASE WHEN d AND m THEN 'both' WHEN d THEN 'data_only' ELSE 'model_only' END AS side FROM (
  SELECT 'm' || (user_id % 5) AS mouse, CASE WHEN user_id % 2 = 0 THEN 'P_Cells' ELSE 'All_Cells' END AS cell_group, strftime(ts, '%y%m%d') || '_x' || user_id AS session,
         bool_or(event_type IN ('click', 'view')) AS d, bool_or(event_type = 'purchase') AS m FROM events GROUP BY ALL) WHERE d OR m""")
def pair_sessions(spark, sf_dir):
    """Sessions of users and days, with data where there are clicks and views, and with a model where there is a purchase."""
    user = F.col("user")
    named = _users(spark, sf_dir).select("kind", _text("m", user % 5).alias("mouse"), F.when(user % 2 == 0, "P_Cells").otherwise("All_Cells").alias("cell_group"), _text(F.col("day"), "_x", user).alias("session"))
    return sessions.pair_sessions(named.where("kind in ('click', 'view')").drop("kind"), named.where("kind = 'purchase'").drop("kind"))


@query("SELECT stim, reach, t, cell, n FROM spike WHERE t < 40")
def first_rows(spark, sf_dir):
    """The first 400 rows of a reach, on the scale of the test tables, whose reaches have 96 rows."""
    return binning.head(testdata.spikes(spark, sf_dir), 40).select("stim", "reach", "t", "cell", "n")


def _central(column: str, table: str) -> str:
    """SQL for central differences of a column of (reach, t, ...), one-sided at the ends, by the reach's first step."""
    return f"""CASE WHEN lag({column}) OVER w IS NULL THEN (lead({column}) OVER w - {column}) / step WHEN lead({column}) OVER w IS NULL THEN ({column} - lag({column}) OVER w) / step
      ELSE (lead({column}) OVER w - lag({column}) OVER w) / (2 * step) END"""


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinematics with three velocities made from the position."""
    x = F.col("x")
    return testdata.kinematics(spark, sf_dir).withColumns({"vx": x / 7, "vy": x * x / 97, "vz": x * F.col("t") / 11})


MOVING = "mv AS (SELECT stim, reach, t, x / 7 AS vx, x * x / 97 AS vy, x * t / 11 AS vz, nth_value(t, 2) OVER f - min(t) OVER f AS step FROM kin WINDOW f AS (PARTITION BY reach ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
W_REACH = "WINDOW w AS (PARTITION BY reach ORDER BY t)"


@query(f""", {MOVING}, ac AS (SELECT *, {_central('vx', 'mv')} AS ax, {_central('vy', 'mv')} AS ay, {_central('vz', 'mv')} AS az FROM mv {W_REACH}),
  jk AS (SELECT *, {_central('ax', 'ac')} AS jerk_x, {_central('ay', 'ac')} AS jerk_y, {_central('az', 'ac')} AS jerk_z, {_central('vz', 'ac')} AS jerk_pos_x FROM ac {W_REACH})
  SELECT stim, reach, t, round(ax, 6) AS ax, round(ay, 6) AS ay, round(az, 6) AS az, round(jerk_x, 6) AS jerk_x, round(jerk_y, 6) AS jerk_y, round(jerk_z, 6) AS jerk_z, round(jerk_pos_x, 6) AS jerk_pos_x,
         round(jerk_x, 6) AS jerk_pos_y, round(jerk_y, 6) AS jerk_pos_z FROM jk""")
def with_accelerations(spark, sf_dir):
    moving = kinematics.with_accelerations(_moving(spark, sf_dir))
    return moving.select("stim", "reach", "t", *[r6(c).alias(c) for c in ("ax", "ay", "az", "jerk_x", "jerk_y", "jerk_z", "jerk_pos_x", "jerk_pos_y", "jerk_pos_z")])


def _heads(column: str) -> str:
    return f"p_{column} AS (SELECT reach AS g, row_number() OVER (PARTITION BY reach ORDER BY t) - 1 AS k, t::DOUBLE AS x, {column} AS y, count(*) OVER (PARTITION BY reach) AS n FROM mv WHERE t < 40), {spline_slopes(f'p_{column}', f's_{column}')}"


@query(f""", {MOVING}, {", ".join(map(_heads, ("vx", "vy", "vz")))}
  SELECT stim, reach, t, round(a.slope, 6) AS ax, round(b.slope, 6) AS ay, round(c.slope, 6) AS az FROM mv JOIN s_vx a ON a.g = reach AND a.x = t JOIN s_vy b ON b.g = reach AND b.x = t JOIN s_vz c ON c.g = reach AND c.x = t""")
def head_with_accelerations(spark, sf_dir):
    """Spline accelerations of the first rows of every reach."""
    moving = kinematics.head_with_accelerations(_moving(spark, sf_dir), 40)
    return moving.select("stim", "reach", "t", *[r6(c).alias(c) for c in ("ax", "ay", "az")])


#: Raw tables of one session from events: every quarter of an hour is a row of one clock, even cells are PC, every tenth
#: reach has no label, and kinematic times lie a quarter of a row after those of the clock.
RAW = """cb AS (SELECT CAST(c AS INTEGER) AS cell, CAST((r - 1) * 96 + g AS INTEGER) AS t_idx, coalesce(n, 0)::DOUBLE AS n
  FROM range(1, 31) a(r), range(96) b(g), range(8) d(c) LEFT JOIN (SELECT reach, t, cell, count(*) AS n FROM ev GROUP BY ALL) k ON k.reach = r AND k.t = g AND k.cell = c),
rk AS (SELECT reach, stim, (reach - 1) * 96 + t + 0.25::DOUBLE AS time, t, x FROM kin WHERE reach % 10 <> 0),
sp AS (SELECT reach, stim, min(time) AS lo, max(time) AS hi FROM rk GROUP BY ALL),
st AS (SELECT stim AS label, CAST(row_number() OVER (ORDER BY min(reach)) - 1 AS INTEGER) AS stim FROM rk GROUP BY stim),
rw AS (SELECT st.stim, reach, t_idx, CAST(row_number() OVER (PARTITION BY reach ORDER BY t_idx) - 1 AS INTEGER) AS t
  FROM (SELECT DISTINCT t_idx FROM cb) c JOIN sp ON t_idx > lo AND t_idx < hi JOIN st ON st.label = sp.stim)"""


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = testdata.spikes(spark, sf_dir).withColumn("t_idx", ((F.col("reach") - 1) * testdata.ROWS + F.col("t")).cast("int"))
    kind = F.when(F.col("cell") % 2 == 0, F.lit("PC")).otherwise(F.lit(""))
    cell_bins = counts.select("session", "cell", kind.alias("cell_type"), "t_idx", F.col("t_idx").cast("double").alias("time"), "n")
    label = F.when(F.col("reach") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("stim"), F.col("stim").cast("string")))
    columns = [(F.col("x") * i if i % 2 else F.col("x") + i * F.col("t")).alias(f"k{i}") for i in range(1, 8)]
    time = ((F.col("reach") - 1) * testdata.ROWS + F.col("t") + 0.25).cast("double")
    reaches = testdata.kinematics(spark, sf_dir).select("session", "reach", label.alias("stim"), F.col("t").alias("row"), time.alias("time"), *columns)
    return cell_bins, reaches


def _compiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sessions.compile_sessions(*_raw(spark, sf_dir))


@query(f", {RAW} SELECT stim, reach, t, cell, n FROM rw JOIN cb USING (t_idx) WHERE cell % 2 = 0")
def compile_spikes(spark, sf_dir):
    return _compiled(spark, sf_dir)[0].select("stim", "reach", "t", "cell", "n")


def _scaled(k: int, name: str) -> str:
    """SQL for the k-th kinematic column at a row of the clock, scaled as it is."""
    v = f"v{k}"
    part = f"CASE WHEN max({v}) OVER q = min({v}) OVER q THEN 0 ELSE ({v} - min({v}) OVER q) / (max({v}) OVER q - min({v}) OVER q) END"
    return f"round({part if k <= 4 else f'2 * ({part}) - 1'}, 6) AS {name}"


@query(f", {RAW}, " + "kk AS (SELECT *, " + ", ".join(f"{f'x * {i}' if i % 2 else f'x + {i} * t'} AS k{i}" for i in range(1, 8)) + """ FROM rk),
  bk AS (SELECT rw.*, kk.time AS t0, """ + ", ".join(f"k{i} AS b{i}" for i in range(1, 8)) + """ FROM rw ASOF JOIN kk ON rw.reach = kk.reach AND rw.t_idx >= kk.time),
  ah AS (SELECT bk.*, kk.time AS t1, """ + ", ".join(f"k{i} AS a{i}" for i in range(1, 8)) + """ FROM bk ASOF JOIN kk ON bk.reach = kk.reach AND bk.t_idx <= kk.time),
  iv AS (SELECT stim, reach, t, """ + ", ".join(f"b{i} + (a{i} - b{i}) * (t_idx - t0) / (t1 - t0) AS v{i}" for i in range(1, 8)) + """ FROM ah)
  SELECT stim, reach, t, """ + ", ".join(_scaled(i + 1, name) for i, name in enumerate(("x", "y", "z", "speed", "vx", "vy", "vz"))) + " FROM iv WINDOW q AS (PARTITION BY reach)")
def compile_kinematics(spark, sf_dir):
    return _compiled(spark, sf_dir)[1].select("stim", "reach", "t", *[r6(c).alias(c) for c in ("x", "y", "z", "speed", "vx", "vy", "vz")])


@query(f", {RAW} SELECT 'events' AS session, count(DISTINCT cell) FILTER (cell % 2 = 0) AS n_pc FROM cb")
def pc_count(spark, sf_dir):
    kind = F.when(F.col("cell") % 2 == 0, F.lit("PC"))
    cells = testdata.spikes(spark, sf_dir).select("session", "cell", kind.alias("cell_type"))
    return sessions.pc_count(cells)


@query()
def temperature_grid(spark, sf_dir):
    """The adaptive grid of temperatures, and the exact mean energy at each."""
    h, j = _model(spark, sf_dir, 8)
    return energy.boltzmann_exact(h, j, sampling.grid(spark, sampling.adaptive_temperatures()), 8).select("temp_idx", r6("temp").alias("temp"), r6("mean_e").alias("mean_e"))


_STEP = "CASE WHEN temp >= 0.7::DOUBLE AND temp < 1.7::DOUBLE THEN 0.01::DOUBLE ELSE 0.1::DOUBLE END"
ADAPTIVE = f"tg(temp_idx, temp) AS (SELECT 0, 0.1::DOUBLE UNION ALL SELECT temp_idx + 1, temp + {_STEP} FROM tg WHERE temp + {_STEP} < 3)"
ORACLES["temperature_grid"] = (WITH + BOLTZMANN.replace(REGULAR, ADAPTIVE)).replace("WITH ev", "WITH RECURSIVE ev", 1) + " SELECT temp_idx, round(temp, 6) AS temp, round(mean_e, 6) AS mean_e FROM bz"


@query("""SELECT mouse, CAST(job AS INTEGER) AS job, segment FROM (SELECT DISTINCT 'm' || (user_id % 6) AS mouse FROM events), range(1, 11) j(job), (VALUES ('pre'), ('mid'), ('active'), ('full')) s(segment)""")
def run_matrix(spark, sf_dir):
    return sessions.run_matrix(_users(spark, sf_dir).select(_text("m", F.col("user") % 6).alias("mouse")), 10, list(binning.SEGMENTS))


@query(f", {RAW} SELECT 'stim' || stim AS session, stim, reach, t, cell, n FROM rw JOIN cb USING (t_idx) WHERE cell % 2 = 0")
def stored_spikes(spark, sf_dir):
    """Compiled spikes written session by session into one store, the last time with those that it has, and read back."""
    spike = _compiled(spark, sf_dir)[0].withColumn("session", _text("stim", F.col("stim")))
    path = new_path(spark, "spikes")
    for part in (spike.where("stim = 1"), spike.where("stim <> 1"), spike):
        sessions.add_sessions(part, path)
    return sessions.read_spikes(spark, path).select("session", "stim", "reach", "t", "cell", "n")


@query(f", {RAW} SELECT stim, reach, t, cell, n FROM rw JOIN cb USING (t_idx) WHERE cell % 2 = 0")
def mat_spikes(spark, sf_dir):
    """The raw session as a MAT file, written and read back, and compiled."""
    path = new_path(spark, "mat")
    mat.write_sessions(*_raw(spark, sf_dir), path)
    cells, reaches, _ = mat.read_sessions(spark, path)
    return sessions.compile_sessions(cells, reaches)[0].select("stim", "reach", "t", "cell", "n")


for _name in ("derivative_spline", "head_with_accelerations", "spline_between"):
    recursive(_name)
