"""Occupancy of sliding windows, spins, time segments and what is counted on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time segments by row: first row, and the row after the last (None: to the end).
SEGMENTS = {"pre": (0, "onset"), "active": ("onset", None), "mid": ("onset", "mid_end"), "full": (0, None)}


#: Rows of a segment, into which the rows of a group are cut: the most that one task has to hold in order.
SEGMENT_ROWS = 4096


def with_segments(df: DataFrame, order: Sequence[str], rows: int | None = SEGMENT_ROWS) -> tuple[DataFrame, list[str]]:
    """df with _segment, and the columns that make a segment: all of `order` but the last, and _segment, the last one cut
    into stretches of `rows`. The last column of the order must be a number, at best that of the row. Without `rows` the
    columns before the last are the segment."""
    if rows is None:
        return df.withColumn("_segment", F.lit(0)), [*order[:-1], "_segment"]
    return df.withColumn("_segment", F.floor(F.col(order[-1]) / rows)), [*order[:-1], "_segment"]


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], rows: int | None = SEGMENT_ROWS) -> DataFrame:
    """df with _pos: the place, from 0, of a row within its group by `order`.

    Rows are numbered within their segment, and the segments' lengths are summed up, a row a segment, so no task holds a
    group's rows in order. Segments and groups are as they are whatever the partitions of df.
    """
    cut, segment = with_segments(df, order, rows)
    numbered = cut.withColumn("_in", F.row_number().over(Window.partitionBy(*group, *segment).orderBy(*order)) - 1)
    lengths = cut.groupBy(*group, *segment).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    keys = [*group, *segment]
    a, b = numbered.alias("a"), before.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = a.join(b, same).select(*[F.col(f"a.{c}") for c in numbered.columns], F.col("b._before"))
    return joined.withColumn("_pos", F.col("_before") + F.col("_in")).drop("_in", "_before", "_segment")


def bin_or(spike: DataFrame, width: int, group: Sequence[str] = ("session", "stim", "reach", "cell"), order: Sequence[str] = ("t",), value: str = "n", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """group, pos and fired: whether any spike falls into the width rows from pos on. T rows give T - width + 1.

    Windows end with their group. For windows that run over the ends of reaches leave reach out of group and put it
    into order; the group then is a whole session's cell. Rows are put into blocks by their place in the group, and the
    first width - 1 rows of a block also go to the block before, so no task holds a group, and a longer group has more
    blocks. The last column of the order must be a number.
    """
    block_rows = max(segment_rows, width)
    placed = positions(spike.select(*dict.fromkeys([*group, *order, value])), group, order, segment_rows)
    place = F.col("_pos") % block_rows
    blocks = F.when((place < width - 1) & (F.col("_pos") >= block_rows), F.array(F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0)))
    dealt = placed.select(*group, "_pos", F.col(value).alias("_value"), F.explode(blocks).alias("_guest")).withColumn("_block", F.floor(F.col("_pos") / block_rows) + F.col("_guest"))
    ahead = Window.partitionBy(*group, "_block").orderBy("_pos").rowsBetween(0, width - 1)
    kept = dealt.withColumns({"_sum": F.sum("_value").over(ahead), "_rows": F.count(F.lit(1)).over(ahead)})
    return kept.where((F.col("_rows") == width) & (F.col("_guest") == 0)).select(*group, F.col("_pos").cast("int").alias("pos"), (F.col("_sum") > 0).cast("int").alias("fired"))


def to_spin(fired: Column) -> Column:
    """0 and 1 to -1 and +1."""
    return 2 * fired - 1


def binarize(value: Column) -> Column:
    return F.when(value > 0, 1).otherwise(0)


def segment(df: DataFrame, name: str, onset: int = 451, mid_end: int = 601, t: str = "t") -> DataFrame:
    """Rows of a time segment: pre, active, mid or full."""
    if name not in SEGMENTS:
        raise ValueError(f"no segment {name!r}; there are {', '.join(SEGMENTS)}")
    marks = {"onset": onset, "mid_end": mid_end}
    lo, hi = (marks.get(x, x) for x in SEGMENTS[name])
    kept = df.where(F.col(t) >= lo)
    return kept if hi is None else kept.where(F.col(t) < hi)


def segments_of(t: Column, onset: int = 451, mid_end: int = 601) -> Column:
    """The names of all time segments that a row is in; to take them all in one pass."""
    marks = {"onset": onset, "mid_end": mid_end}
    within = []
    for name, ends in SEGMENTS.items():
        lo, hi = (marks.get(x, x) for x in ends)
        within.append(F.when((t >= lo) if hi is None else (t >= lo) & (t < hi), F.lit(name)))
    return F.array_compact(F.array(*within))


def head(df: DataFrame, rows: int = 400, t: str = "t") -> DataFrame:
    """The first rows of every reach, by their number."""
    return df.where(F.col(t) < rows)


def purkinje_only(cells: DataFrame, all_cells: bool = False) -> DataFrame:
    """Cells of type PC, or all, with a flag is_pc; a null or empty type is not PC."""
    flag = F.coalesce(F.col("cell_type") == "PC", F.lit(False))
    return cells.withColumn("is_pc", flag).where(F.lit(all_cells) | F.col("is_pc"))


def labelled_reaches(reaches: DataFrame) -> DataFrame:
    """Reaches with a stimulus label that is not empty."""
    return reaches.where("stim IS NOT NULL AND stim <> ''")


def min_cells(spike: DataFrame, n: int = 20, session: Sequence[str] = ("session",)) -> DataFrame:
    """Rows of sessions with at least n cells."""
    enough = spike.groupBy(*session).agg(F.countDistinct("cell").alias("_cells")).where(F.col("_cells") >= n)
    return spike.join(enough, list(session), "left_semi")


def truncate_to_shortest(df: DataFrame, group: Sequence[str] = ("session", "stim"), reach: str = "reach", t: str = "t") -> DataFrame:
    """Cut all reaches of a group to the length of its shortest, the length being the reach's last row plus one."""
    length = df.groupBy(*group, reach).agg((F.max(t) + 1).alias("_len")).groupBy(*group).agg(F.min("_len").alias("_len"))
    return df.join(length, list(group)).where(F.col(t) < F.col("_len")).drop("_len")


def perturbation_number(spike: DataFrame, width: int, session: Sequence[str] = ("session",), order: Sequence[str] = ("reach", "t")) -> DataFrame:
    """1 / (mean occupancy of windows x width); infinite where nothing fires."""
    binned = bin_or(spike, width, (*session, "cell"), order)
    mean = binned.groupBy(*session).agg(F.avg("fired").alias("_m"))
    return mean.select(*session, F.lit(width).alias("width"), _number(F.col("_m"), F.lit(width)).alias("n_c"))


def _number(mean: Column, width: Column) -> Column:
    return F.when(mean == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), mean * width))


def silent_runs(spike: DataFrame, group: Sequence[str], order: Sequence[str], value: str = "n", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """group and _len: the length of every stretch of rows without a spike, within the group.

    Within a segment the stretches between two spikes are whole. What is silent at a segment's start and end goes on in
    its neighbours: a segment without any spike lengthens a stretch, any other ends one and begins one. So those are put
    together from one row a segment.
    """
    cut, segment = with_segments(spike, order, segment_rows)
    rows = Window.partitionBy(*group, *segment).orderBy(*order)
    marked = cut.withColumn("_run", F.sum((F.col(value) > 0).cast("int")).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*group, *segment, "_run").agg(F.count_if(~F.coalesce(F.col(value) > 0, F.lit(False))).alias("_len"))
    whole = Window.partitionBy(*group, *segment)
    runs = runs.withColumn("_spikes", F.max("_run").over(whole))
    inner = runs.where("_run > 0 and _run < _spikes").select(*group, "_len")
    ends = runs.groupBy(*group, *segment).agg(F.max("_spikes").alias("_spikes"), F.sum(F.when(F.col("_run") == 0, F.col("_len"))).alias("_lead"), F.sum(F.when((F.col("_run") == F.col("_spikes")) & (F.col("_run") > 0), F.col("_len"))).alias("_trail"))
    earlier = Window.partitionBy(*group).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    stretch = F.coalesce(F.sum((F.col("_spikes") > 0).cast("int")).over(earlier), F.lit(0))
    parts = ends.withColumn("_stretch", stretch).select(*group, F.explode(F.array(F.struct("_stretch", F.coalesce("_lead", F.lit(0)).alias("n")), F.struct((F.col("_stretch") + 1).alias("_stretch"), F.coalesce("_trail", F.lit(0)).alias("n")))).alias("p"))
    outer = parts.groupBy(*group, "p._stretch").agg(F.sum("p.n").alias("_len")).select(*group, "_len")
    return inner.unionByName(outer).where("_len > 0")


def bin_size_scan(spike: DataFrame, start: int = 1, end: int = 200, session: Sequence[str] = ("session",), order: Sequence[str] = ("reach", "t"), value: str = "n", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """perturbation_number for every width from start to end - 1, from one pass over the spikes.

    A window is empty if it lies within a silent run, and a run of length L holds L - width + 1 empty windows. So the
    lengths of silent runs say it for all widths; windows are never formed, and no task holds a cell's rows.
    """
    runs = silent_runs(spike, (*session, "cell"), order, value, segment_rows).groupBy(*session, "_len").agg(F.count(F.lit(1)).alias("_times"))
    sizes = spike.groupBy(*session, "cell").agg(F.count(F.lit(1)).alias("_t")).groupBy(*session, "_t").agg(F.count(F.lit(1)).alias("_cells"))
    widths = spike.sparkSession.range(start, end).select(F.col("id").alias("width"))
    # the widths are at most end - start rows
    over = lambda df, length, times, name: df.join(F.broadcast(widths), F.col(length) >= F.col("width")).groupBy(*session, "width").agg(F.sum(F.col(times) * (F.col(length) - F.col("width") + 1)).alias(name))
    both = over(sizes, "_t", "_cells", "_all").join(over(runs, "_len", "_times", "_empty"), [*session, "width"], "left")
    mean = 1 - F.coalesce("_empty", F.lit(0)) / F.col("_all")
    return both.select(*session, F.col("width").cast("int").alias("width"), _number(mean, F.col("width")).alias("n_c"))


def zero_based(states: DataFrame, value: str = "s") -> DataFrame:
    """-1 to 0 if the smallest value of the whole table is exactly -1, else unchanged."""
    low = states.agg(F.min(value).alias("_low"))
    return states.crossJoin(F.broadcast(low)).withColumn(value, F.when((F.col("_low") == -1) & (F.col(value) == -1), 0).otherwise(F.col(value))).drop("_low")


def q_histogram(states: DataFrame, bins: int = 100, state: str = "state", value: str = "s") -> DataFrame:
    """Density of q = sum / (2 N) + 1/2 over states, in equal bins from the least to the largest q; the last is closed.

    The table is read once: states are counted by their number of cells, their sum of values, their number of -1 and their
    least value, of which there are few, and all else follows from those counts.
    """
    shape = states.groupBy(state).agg(F.count(F.lit(1)).alias("cells"), F.sum(value).alias("total"), F.count_if(F.col(value) == -1).alias("minus"), F.min(value).alias("low"))
    counts = shape.groupBy("cells", "total", "minus", "low").agg(F.count(F.lit(1)).alias("states"))
    every = Window.partitionBy()  # a row for each of the few sums
    sums = counts.withColumn("low", F.min("low").over(every))
    total = F.when(F.col("low") == -1, F.col("total") + F.col("minus")).otherwise(F.col("total"))
    q = sums.withColumn("q", total / (2.0 * F.col("cells")) + 0.5)
    edge = q.withColumns({"lo": F.min("q").over(every), "hi": F.max("q").over(every), "n": F.sum("states").over(every)})
    edge = edge.withColumn("_one", F.col("lo") == F.col("hi")).withColumns({"lo": F.when(F.col("_one"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("_one"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("q") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    found = edge.groupBy(place.alias("bin"), "lo", "hi", "n").agg(F.sum("states").alias("count"))
    return found.select("bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), "count", (F.col("count") / (F.col("n") * width)).alias("density"))
