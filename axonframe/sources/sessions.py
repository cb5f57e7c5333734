"""Where sessions and models come from and go to: raw files, compiled sessions, models, result tables."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonframe.operators.binning import labelled_reaches, purkinje_only
from axonframe.operators.kinematics import interpolate, mask_to_reach, rescale
from axonframe.schema import CELL_BINS, KIN, KINEMATIC_COLUMNS, MODEL, REACH_KINEMATICS, SPIKE, UNIT_SCALED

#: Cell groups that reports are made for, and the pattern of a session's file name. Raw files end in
#: _NPresults, which is no part of the identifier; compiled sessions and models do not.
CELL_GROUPS = ("Non_P_Cells", "All_Cells", "P_Cells")
NAME_PATTERN = r"^(\w+)_(\d{6})_(\w+?)(?:_NPresults)?(?!\w)"


def parse_session_name(name: Column) -> Column:
    """name, date (six digits), identifier and key (date_identifier) of a session's file name; empty where it does not fit."""
    part = lambda k: F.regexp_extract(name, NAME_PATTERN, k)
    key = F.when(part(2) == "", F.lit("")).otherwise(F.concat_ws("_", part(2), part(3)))
    return F.struct(part(1).alias("name"), part(2).alias("date"), part(3).alias("identifier"), key.alias("key"))


def natural_key(name: Column, digits: int = 20) -> Column:
    """A key that sorts names with their runs of digits as numbers: s2 before s10."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), digits, "0")).otherwise(x))


def session_label(name: Column, length: int = 4) -> Column:
    """The start of a file's name by which a session is called in plots."""
    return F.substring(name, 1, length)


def path_keys(path: Column) -> Column:
    """mouse, cell_group, bin and file of a path that ends in mouse/cell_group/bin/file; empty where folders are missing."""
    parts = F.split(path, "/")
    at = lambda k: F.coalesce(F.get(parts, F.size(parts) - k), F.lit(""))
    return F.struct(at(4).alias("mouse"), at(3).alias("cell_group"), at(2).alias("bin"), at(1).alias("file"))


def report_sessions(files: DataFrame, groups: tuple[str, ...] = CELL_GROUPS) -> DataFrame:
    """files (path, ...) of the cell groups that reports are made for, with mouse, cell_group, bin, file and place: the
    files of a mouse's and cell group's first bin folder by natural order, numbered by natural order from 0."""
    keyed = files.withColumn("_k", path_keys(F.col("path"))).select("*", "_k.mouse", "_k.cell_group", "_k.bin", "_k.file").drop("_k")
    keyed = keyed.where(F.col("cell_group").isin(*groups)).withColumn("_bin", natural_key(F.col("bin")))
    first = keyed.groupBy("mouse", "cell_group").agg(F.min("_bin").alias("_bin"))
    order = Window.partitionBy("mouse", "cell_group").orderBy(natural_key(F.col("file")), "path")
    return keyed.join(first, ["mouse", "cell_group", "_bin"], "left_semi").drop("_bin").withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def try_int(text: Column) -> Column:
    return text.try_cast("int")


def read_raw(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple]], schema: str, glob: str = "*.mat") -> tuple[DataFrame, DataFrame]:
    """Rows of raw session files, and (path, error) of files that could not be parsed.

    parse turns the bytes of one file into rows of schema; files are listed and read by Spark and parsed on the
    executors, a file at a time. Each row gets the file's session key and its path, from which path_keys and
    report_sessions tell mouse, cell group and bin. Parsers for other formats are passed in.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    keyed = files.select("path", "content", parse_session_name(F.element_at(F.split("path", "/"), -1))["key"].alias("session"))
    fields = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at, content, session in part.itertuples(index=False):
                try:
                    rows = pd.DataFrame(parse(content), columns=fields)
                    rows.insert(0, "session", session)
                    rows.insert(1, "path", at)
                    yield rows.assign(error=None)
                except Exception as e:  # one bad file does not stop the others; it is reported
                    yield pd.DataFrame({"session": [session], "path": [at], **{f: [None] for f in fields}, "error": [f"{type(e).__name__}: {e}"]})

    read = keyed.mapInPandas(run, f"session string, path string, {schema}, error string")
    return read.where("error is null").drop("error"), read.where("error is not null").select("path", "error")


def parse_npy(content: bytes) -> list[tuple]:
    """A model file: one vector of N fields and N (N - 1) / 2 couplings, as one row (h, cpl)."""
    v = np.load(io.BytesIO(content), allow_pickle=False).astype(float).ravel()
    n = int((np.sqrt(8 * len(v) + 1) - 1) / 2)
    if n * (n + 1) // 2 != len(v):
        raise ValueError(f"{len(v)} numbers are no fields and pair couplings")
    return [(v[:n].tolist(), v[n:].tolist())]


def read_model_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Models from .npy files, with the session of the file's name, and the files that failed."""
    return read_raw(spark, path, parse_npy, "h array<double>, cpl array<double>", "*.npy")


def compile_sessions(cell_bins: DataFrame, reaches: DataFrame, all_cells: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spikes and kinematics by reach from raw tables.

    cell_bins: session, cell, cell_type, t_idx, time, n. reaches: session, reach, stim (label), row, time, k1..k7. Cells
    that are not PC go, unless all are wanted, and so do reaches without a label. The clock is that of a session's
    first cell; a reach has its rows strictly between the first and the last kinematic time, and each kinematic column
    is interpolated there and scaled. stim becomes the place, from 0, of the label among a session's labels by first
    reach.
    """
    reaches = labelled_reaches(reaches)
    labels = reaches.groupBy("session", "stim").agg(F.min("reach").alias("_first"))
    numbered = labels.withColumn("_stim", (F.row_number().over(Window.partitionBy("session").orderBy("_first")) - 1).cast("int")).select("session", "stim", "_stim")
    reaches = reaches.join(numbered, ["session", "stim"]).drop("stim").withColumnRenamed("_stim", "stim")
    first = cell_bins.groupBy("session").agg(F.min("cell").alias("cell"))
    clock = cell_bins.join(first, ["session", "cell"]).select("session", "t_idx", "time")
    keys = ["session", "stim", "reach"]
    rows = mask_to_reach(clock, reaches, keys, on=["session"])
    at = Window.partitionBy(*keys).orderBy("t_idx")
    rows = rows.withColumn("t", (F.row_number().over(at) - 1).cast("int"))
    raw = [f"k{i}" for i in range(1, len(KINEMATIC_COLUMNS) + 1)]
    kin = interpolate(rows, reaches, raw, keys).withColumnsRenamed(dict(zip(raw, KINEMATIC_COLUMNS)))
    for name, unit in zip(KINEMATIC_COLUMNS, UNIT_SCALED):
        kin = rescale(kin, name, 0.0 if unit else -1.0, 1.0, keys)
    kin = kin.join(rows.select(*keys, "time", "t"), [*keys, "time"]).select(*keys, "t", "time", *KINEMATIC_COLUMNS)
    cells = purkinje_only(cell_bins, all_cells).select("session", "cell", "t_idx", "n")
    spike = rows.select(*keys, "t", "t_idx").join(cells, ["session", "t_idx"]).select(*keys, "t", "cell", "n")
    return spike, kin


def pc_count(cell_bins: DataFrame) -> DataFrame:
    """Number of PC cells of each session."""
    return cell_bins.select("session", "cell", "cell_type").distinct().groupBy("session").agg(F.count_if(F.coalesce(F.col("cell_type") == "PC", F.lit(False))).alias("n_pc"))


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = ("session",)) -> None:
    """A compiled table, model or result as Parquet, in folders by session. The folders that df has rows for are replaced,
    all others stay. Files are staged and moved when all tasks have ended, so a task that dies leaves the folders as they
    were."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


MANIFEST = "session string, rows long"


def finished_sessions(spark: SparkSession, path: str) -> DataFrame:
    """session and rows of the sessions that add_sessions has written to path; none where nothing was."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}.finished").select("session", "rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def add_sessions(df: DataFrame, path: str, partitions: tuple[str, ...] = ("session",), again: bool = False) -> None:
    """write_table, of the sessions alone that are not finished (or of all with again=True), and their names and rows into
    the manifest beside the table once they are written. A run that was broken off can be started again as it was: what it
    had finished is passed over, and what it had not is written anew."""
    spark = df.sparkSession
    if not again:
        df = df.join(finished_sessions(spark, path), "session", "left_anti")
    write_table(df, path, partitions)
    written = spark.read.schema(df.schema).parquet(path).join(df.select("session").distinct(), "session", "left_semi")
    rows = written.groupBy("session").agg(F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(f"{path.rstrip('/')}.finished")


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPIKE).parquet(path)


def read_kinematics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KIN).parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def read_raw_tables(spark: SparkSession, cells: str, reaches: str) -> tuple[DataFrame, DataFrame]:
    """Raw sessions that were converted to Parquet."""
    return spark.read.schema(CELL_BINS).parquet(cells), spark.read.schema(REACH_KINEMATICS).parquet(reaches)


def write_classification(classified: DataFrame, path: str) -> None:
    """Pausers and bursters as CSV, a folder a stimulus: cell (from 1), p or b, h-val."""
    named = classified.select("session", "stim", (F.col("cell") + 1).alias("cell"), F.col("kind").alias("p or b"), F.col("h").cast("string").alias("h-val"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("session", "stim").csv(path)


def pair_sessions(data: DataFrame, models: DataFrame, keys: tuple[str, ...] = ("mouse", "cell_group", "session")) -> DataFrame:
    """Data sessions with their models by key, and which of the two sides lacks one: both, data_only, model_only."""
    joined = data.select(*keys, F.lit(1).alias("_d")).distinct().join(models.select(*keys, F.lit(1).alias("_m")).distinct(), list(keys), "full")
    side = F.when(F.col("_m").isNull(), "data_only").when(F.col("_d").isNull(), "model_only").otherwise("both")
    return joined.select(*keys, side.alias("side"))


def run_matrix(mice: DataFrame, jobs: int, segments: list[str]) -> DataFrame:
    """Every mouse (of a table with a column mouse) with every job (from 1) and segment: the runs of a batch of fits."""
    spark = mice.sparkSession
    segment = spark.createDataFrame([(s,) for s in segments], "segment string")
    job = spark.range(1, jobs + 1).select(F.col("id").cast("int").alias("job"))
    return mice.select("mouse").distinct().crossJoin(F.broadcast(job.crossJoin(segment)))  # jobs x segments rows
