"""Ingest, round trips and names."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.sources import sessions


def raw(spark):
    cells = [("s", c, kind, t, t / 10, float((t + c) % 3 == 0)) for c, kind in ((0, "MLI"), (1, "PC"), (2, "PC")) for t in range(40)]
    reaches = [("s", r, stim, i, 0.5 + r + i * 0.2, *[float(i * k) for k in range(1, 8)]) for r, stim in ((0, "2"), (1, ""), (2, "0")) for i in range(5)]
    cells = spark.createDataFrame(cells, sessions.CELL_BINS)
    return cells, spark.createDataFrame(reaches, sessions.REACH_KINEMATICS)


def test_compile_and_round_trip(spark, tmp_path):
    cells, reaches = raw(spark)
    spike, kin = sessions.compile_sessions(cells, reaches)
    assert {(r.stim, r.reach) for r in kin.select("stim", "reach").distinct().collect()} == {(0, 0), (1, 2)}  # stimuli by first reach
    assert {r.cell for r in spike.select("cell").distinct().collect()} == {1, 2}
    rows = kin.where("reach = 0").orderBy("t").collect()
    assert [round(r.time, 1) for r in rows] == [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2]
    assert (rows[0].x, rows[-1].x, rows[0].vz, rows[-1].vz) == (0, 1, -1, 1)
    assert spike.where("reach = 0").count() == 14
    assert sessions.compile_sessions(cells, reaches, all_cells=True)[0].select("cell").distinct().count() == 3
    sessions.write_table(spike, f"{tmp_path}/spike")
    back = sessions.read_spikes(spark, f"{tmp_path}/spike")
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r) for r in spike.select(*back.columns).collect())
    assert sessions.pc_count(cells).first().n_pc == 2


def test_model_files_and_bad_files(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.array([0.1, 0.2, 0.3, 1.0, 2.0, 3.0]))
    (tmp_path / "Joker_060102_x10.npy").write_bytes(buffer.getvalue())
    (tmp_path / "Joker_060102_bad.npy").write_bytes(b"nothing")
    models, errors = sessions.read_model_files(spark, str(tmp_path))
    r = models.first()
    assert (r.session, r.h, r.cpl) == ("060102_x10", [0.1, 0.2, 0.3], [1.0, 2.0, 3.0]) and models.count() == 1
    assert "bad" in errors.first().path and errors.count() == 1
    with pytest.raises(ValueError):
        buffer = io.BytesIO()
        np.save(buffer, np.zeros(4))
        sessions.parse_npy(buffer.getvalue())


def test_classification_csv(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, 0, "pauser", 0.5)], "session string, stim int, cell int, kind string, h double")
    sessions.write_classification(df, f"{tmp_path}/out")
    r = spark.read.option("header", True).csv(f"{tmp_path}/out").first()
    assert (r.cell, r["p or b"], float(r["h-val"])) == ("1", "pauser", 0.5)


def test_pairing_and_names(spark):
    data = spark.createDataFrame([("m", "P", "a"), ("m", "P", "b")], "mouse string, cell_group string, session string")
    sides = {r.session: r.side for r in sessions.pair_sessions(data, data.where("session = 'b'").union(spark.createDataFrame([("m", "P", "c")], data.schema))).collect()}
    assert sides == {"a": "data_only", "b": "both", "c": "model_only"}
    names = spark.createDataFrame([(n,) for n in ("s10", "s2", "s1_b", "s1_a")], "n string")
    assert [r.n for r in names.orderBy(sessions.natural_key(F.col("n"))).collect()] == ["s1_a", "s1_b", "s2", "s10"]
    assert [r[0] for r in spark.createDataFrame([("12",), ("x",)], "v string").select(sessions.try_int(F.col("v"))).collect()] == [12, None]


def test_sessions_are_added_and_replaced(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "session string, stim int, n double")
    path = f"{tmp_path}/store"
    assert sessions.finished_sessions(spark, path).count() == 0
    sessions.add_sessions(df([("a", 0, 1.0), ("a", 1, 2.0)]), path)
    sessions.add_sessions(df([("b", 0, 3.0)]), path)
    read = lambda: sorted((r.session, r.stim, r.n) for r in spark.read.schema("session string, stim int, n double").parquet(path).collect())
    assert read() == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]
    sessions.add_sessions(df([("a", 0, 9.0), ("c", 0, 4.0)]), path)  # a is finished
    assert read() == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0), ("c", 0, 4.0)]
    sessions.add_sessions(df([("a", 0, 9.0)]), path, again=True)
    assert read() == [("a", 0, 9.0), ("b", 0, 3.0), ("c", 0, 4.0)]
    assert sorted(map(tuple, sessions.finished_sessions(spark, path).collect())) == [("a", 1), ("b", 1), ("c", 1)]

    def dies(n):
        raise RuntimeError("the task dies")

    with pytest.raises(Exception, match="the task dies"):
        sessions.add_sessions(df([("b", 0, 7.0), ("d", 0, 7.0)]).withColumn("n", F.udf(dies, "double")("n")), path, again=True)
    assert read() == [("a", 0, 9.0), ("b", 0, 3.0), ("c", 0, 4.0)] and sessions.finished_sessions(spark, path).count() == 3
    sessions.write_classification(spark.createDataFrame([("s", 0, 0, "pauser", 0.5)], "session string, stim int, cell int, kind string, h double"), f"{tmp_path}/csv")
    sessions.write_classification(spark.createDataFrame([("s", 1, 0, "burster", 0.5)], "session string, stim int, cell int, kind string, h double"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
