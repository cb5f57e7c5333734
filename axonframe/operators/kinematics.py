"""Kinematics of reaches: alignment with the neural clock, scaling, derivatives, crossings, averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.spline import parabola_slopes, slopes, with_second_derivatives
from axonframe.operators.binning import head, positions
from axonframe.schema import REACH


def mask_to_reach(clock: DataFrame, kin: DataFrame, keys: Sequence[str] = REACH, time: str = "time", on: Sequence[str] = ()) -> DataFrame:
    """Rows of the clock that lie strictly between the first and last kinematic time of a reach, with the reach's keys.

    clock has time (and the columns of `on`, such as session, that it shares with the reaches). Each reach gives one
    interval, which is what is joined; kinematic rows are not. Both sides go to buckets of time as wide as a reach is on
    average, so a clock row meets only the reaches of its own bucket; of the whole table one number reaches the driver.
    """
    span = kin.groupBy(*keys).agg(F.min(time).cast("double").alias("_lo"), F.max(time).cast("double").alias("_hi"))
    wide = span.agg(F.avg(F.col("_hi") - F.col("_lo")).alias("w")).first()["w"] or 1.0
    bucket = lambda c: F.floor(F.col(c).cast("double") / wide)
    span = span.where("_lo < _hi").withColumn("_bucket", F.explode(F.sequence(bucket("_lo"), bucket("_hi"))))
    clock = clock.withColumn("_bucket", bucket(time))
    inside = (F.col("c._bucket") == F.col("s._bucket")) & (F.col(f"c.{time}") > F.col("s._lo")) & (F.col(f"c.{time}") < F.col("s._hi"))
    for k in on:
        inside &= F.col(f"c.{k}") == F.col(f"s.{k}")
    rest = [F.col(f"c.{c}") for c in clock.columns if c not in keys and c != "_bucket"]
    return clock.alias("c").join(span.alias("s"), inside).select(*[F.col(f"s.{k}") for k in keys], *rest)


#: Kinematic rows of a stretch of a reach, within which one task looks back and ahead.
STRETCH_ROWS = 8192


def interpolate(clock: DataFrame, kin: DataFrame, cols: Sequence[str], keys: Sequence[str] = REACH, time: str = "time", stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Linear interpolation of columns of kin at the times of clock, both with keys and time; null outside of a reach.

    Both are put on one line of time, and each clock row looks back and ahead for the kinematic rows beside it. Looking
    ahead is looking back on the line turned round, so that both frames grow row by row. A reach is cut
    into stretches of equal time, about stretch_rows kinematic rows each, and what stretches know at their ends is carried
    on to those after and before, a row a stretch; so a long reach is split over tasks. A row at a time that is null or
    NaN is left out of kin, and has nulls in the result.
    """
    at = F.col(time).cast("double")
    usable = kin.where(at.isNotNull() & ~F.isnan(at))
    span = usable.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.ceil(F.count(F.lit(1)) / stretch_rows).alias("_cuts"))
    marked = usable.select(*keys, F.col(time).alias("_at"), F.lit(0).alias("_clock"), *[F.col(c).cast("double").alias(c) for c in cols])
    asked = clock.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_clock"), *[F.lit(None).cast("double").alias(c) for c in cols])
    place = F.floor((F.col("_at").cast("double") - F.col("_lo")) * F.col("_cuts") / (F.col("_hi") - F.col("_lo")))
    inside = F.when(F.col("_hi") > F.col("_lo"), F.greatest(F.lit(-1), F.least(place, F.col("_cuts")))).otherwise(F.signum(F.col("_at").cast("double") - F.col("_lo")))
    known = lambda c: F.when(F.col("_clock") == 0, F.struct(F.col("_at").alias("t"), F.col(c).alias("v")))
    line = marked.unionByName(asked).join(span, list(keys), "left").withColumn("_stretch", F.coalesce(inside.cast("long"), F.lit(0)))
    line = line.select(*keys, "_stretch", "_at", "_clock", *[known(c).alias(c) for c in cols])

    ends = line.groupBy(*keys, "_stretch").agg(*[F.max(c).alias(f"_last_{c}") for c in cols], *[F.min(c).alias(f"_first_{c}") for c in cols])
    order = Window.partitionBy(*keys).orderBy("_stretch")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.col("_stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_stretch", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_from_{c}") for c in cols], *[F.last(f"_first_{c}", ignorenulls=True).over(after).alias(f"_to_{c}") for c in cols])

    back, ahead = (Window.partitionBy(*keys, "_stretch").orderBy(t, "_clock").rowsBetween(Window.unboundedPreceding, 0) for t in (F.col("_at"), F.col("_at").desc()))
    looked = line.withColumns({f"_b_{c}": F.last(c, ignorenulls=True).over(back) for c in cols}).withColumns({f"_a_{c}": F.last(c, ignorenulls=True).over(ahead) for c in cols})
    rows = looked.where(F.col("_clock") == 1).join(carried, [*keys, "_stretch"])

    def value(c: str) -> Column:
        b, a = F.coalesce(f"_b_{c}", f"_from_{c}"), F.coalesce(f"_a_{c}", f"_to_{c}")
        return F.when(b["t"] == a["t"], b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * F.try_divide(F.col("_at") - b["t"], a["t"] - b["t"]))

    return rows.select(*keys, F.col("_at").alias(time), *[value(c).alias(c) for c in cols])


def rescale(df: DataFrame, col: str, lo: float = 0.0, hi: float = 1.0, keys: Sequence[str] = REACH) -> DataFrame:
    """Scale a column to [lo, hi] within each reach; a constant column becomes lo."""
    reach = Window.partitionBy(*keys)
    low, high = F.min(col).over(reach), F.max(col).over(reach)
    return df.withColumn(col, F.when(high == low, F.lit(float(lo))).otherwise(lo + F.try_divide(F.col(col) - low, high - low) * (hi - lo)))


def derivative(df: DataFrame, col: str, method: str = "central", keys: Sequence[str] = REACH, time: str = "time", out: str | None = None) -> DataFrame:
    """Add the derivative of col by time as `out` (default d_<col>).

    central: central differences with the reach's first time step throughout, one-sided at the ends; null for reaches of
    one row. spline: derivative of the interpolating cubic spline.
    """
    out = out or f"d_{col}"
    if method == "central":
        rows = Window.partitionBy(*keys).orderBy(time)
        step = F.nth_value(time, 2).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.min(time).over(Window.partitionBy(*keys))
        before, after, here = F.lag(col).over(rows), F.lead(col).over(rows), F.col(col)
        slope = F.when(before.isNull(), F.try_divide(after - here, step)).when(after.isNull(), F.try_divide(here - before, step)).otherwise(F.try_divide(after - before, 2 * step))
        return df.withColumn(out, slope)
    if method != "spline":
        raise ValueError(f"no method {method!r}; there are central and spline")
    return spline_derivatives(df, {col: out}, keys, time)


#: Points of a reach whose spline is solved at once, and points beyond them on either side that it also looks at.
SPLINE_ROWS, SPLINE_BEYOND = 256, 48


def spline_derivatives(df: DataFrame, outs: dict[str, str], keys: Sequence[str] = REACH, time: str = "time", rows: int = SPLINE_ROWS, beyond: int = SPLINE_BEYOND) -> DataFrame:
    """Add derivatives of the cubic splines through a reach's points: outs says under which name, by column.

    A reach is cut into blocks of points, which are solved each with some points of its neighbours: the influence of a
    point on the spline falls to a quarter or so with each point between, so 48 of them leave nothing of it in a double.
    So a long reach is split over tasks, and all is done by expressions over arrays. Under four points the polynomial
    through them is taken, and the derivative of one point is NaN. Times must differ and not be null.
    """
    at, names = F.col(time).cast("double"), [f"_y{k}" for k in range(len(outs))]
    span = df.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    cut = df.select(*keys, F.col(time).alias("_time"), at.alias("_x"), *[F.col(c).cast("double").alias(y) for c, y in zip(outs, names)]).join(span, list(keys))
    stretch = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_x") - F.col("_lo")) * F.ceil(F.col("_n") / STRETCH_ROWS) / (F.col("_hi") - F.col("_lo")))).otherwise(F.lit(0))
    placed = positions(cut.withColumn("_stretch", stretch), keys, ("_stretch", "_x"), None)
    place, last = F.col("_pos") % rows, F.floor((F.col("_n") - 1) / rows)
    block = F.floor(F.col("_pos") / rows)
    to = F.array_compact(F.array(block, F.when((place < beyond) & (block > 0), block - 1), F.when((place >= rows - beyond) & (block < last), block + 1)))
    dealt = placed.withColumn("_block", F.explode(to)).withColumn("_own", F.col("_block") == block)
    lines = dealt.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("_pos", "_x", *names, "_own", "_time"))).alias("_p"), F.max("_n").alias("_n"))
    part = lambda name: F.transform("_p", lambda p: p[name])
    start, end, bent = F.get("_p", 0)["_pos"] == 0, F.element_at("_p", -1)["_pos"] == F.col("_n") - 1, F.col("_n") >= 4
    lines = lines.withColumns({"_x": part("_x"), "_start": start, "_end": end, **{y: part(y) for y in names}})
    for y in names:
        lines = with_second_derivatives(lines, "_x", y, F.col("_start"), F.col("_end"), "_m")
        lines = lines.withColumn(f"_s{y}", F.when(bent, slopes(F.col("_x"), F.col(y), F.col("_m"))).otherwise(parabola_slopes(F.col("_x"), F.col(y))))
    solved = lines.select(*keys, F.inline(F.arrays_zip(part("_own").alias("own"), part("_time").alias("_time"), *[F.col(f"_s{y}") for y in names]))).where("own")
    a, b = df.alias("a"), solved.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col(f"a.{time}") == F.col("b._time")]
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in df.columns if c not in outs.values()], *[F.col(f"b._s{y}").alias(out) for y, out in zip(names, outs.values())])


def with_accelerations(kin: DataFrame, method: str = "central") -> DataFrame:
    """Accelerations of vx, vy and vz; their derivatives as jerk; and as jerk_pos the derivatives of the columns that
    stand where accelerations would if the first column were missing (vz, ax, ay)."""
    for v, a in (("vx", "ax"), ("vy", "ay"), ("vz", "az")):
        kin = derivative(kin, v, method, out=a)
    for a, v, axis in (("ax", "vz", "x"), ("ay", "ax", "y"), ("az", "ay", "z")):
        kin = derivative(derivative(kin, a, method, out=f"jerk_{axis}"), v, method, out=f"jerk_pos_{axis}")
    return kin


def head_with_accelerations(kin: DataFrame, rows: int = 400) -> DataFrame:
    """The first rows of every reach with the spline accelerations ax, ay and az of vx, vy and vz, and no jerk."""
    return spline_derivatives(head(kin, rows), {"vx": "ax", "vy": "ay", "vz": "az"})


def first_crossing(kin: DataFrame, col: str = "x", threshold: float = 0.99, keys: Sequence[str] = REACH, t: str = "t") -> DataFrame:
    """First row of each reach at which col is over threshold; reaches without one are left out."""
    return kin.groupBy(*keys).agg(F.min(F.when(F.col(col) > threshold, F.col(t))).alias("t_cross")).where("t_cross is not null")


def numbered(df: DataFrame, keys: Sequence[str] = REACH, order: str = "t") -> DataFrame:
    """t becomes the place of a row in its reach, from 0."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("int"))


def average_position(kin: DataFrame, cols: Sequence[str] = ("x",)) -> DataFrame:
    """Mean of columns over a stimulus' reaches, row by row, as far as the shortest reach goes."""
    from axonframe.operators.binning import truncate_to_shortest

    return truncate_to_shortest(kin).groupBy("session", "stim", "t").agg(*[F.avg(c).alias(c) for c in cols])


def position_time(kin: DataFrame, col: str = "x") -> DataFrame:
    """Position by reach and row, every reach cut to the shortest of its stimulus."""
    from axonframe.operators.binning import truncate_to_shortest

    return truncate_to_shortest(kin).select("session", "stim", "reach", "t", col)
