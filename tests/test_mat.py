"""MAT files: decoding, the data source, sessions that are written, read back and compiled."""

import struct

import numpy as np
import pytest

from axonframe.sources import mat, sessions


def tables(spark, session="s"):
    cells = [(session, c, kind, t, t / 10, float((t + c) % 3 == 0)) for c, kind in ((0, ""), (1, "PC"), (3, "PC")) for t in range(40)]
    reaches = [(session, r, stim, i, 0.5 + r + i * 0.2, *[float(i * k) for k in range(1, 8)]) for r, stim in ((0, "2"), (1, ""), (2, "stim 0")) for i in range(5)]
    return spark.createDataFrame(cells, sessions.CELL_BINS), spark.createDataFrame(reaches, sessions.REACH_KINEMATICS)


VALUE = {"text": "héllo  ", "numbers": np.arange(24.0).reshape(2, 3, 4).astype(float)[:, :, 0], "one": 3.5, "nothing": np.zeros((0, 0)), "nested": {"a": {"b": [1.0, "x", {"c": "y"}]}}, "rows": ({"k": 1.0}, {"k": "z"}), "none": ()}


@pytest.mark.parametrize("compress", [True, False])
def test_values_round_trip(compress):
    got = mat.decode(mat.file_of(VALUE, compress))
    assert set(got) == set(VALUE) and got["text"] == VALUE["text"] and np.array_equal(got["numbers"], VALUE["numbers"]) and got["one"].item() == 3.5
    assert got["nested"]["a"]["b"][1:] == ["x", {"c": "y"}] and got["rows"][1] == {"k": "z"} and got["none"] == [] and got["nothing"].size == 0
    assert list(mat.decode(mat.file_of(VALUE, compress), {"one", "absent"})) == ["one"]


def test_other_writers_layouts():
    """Small elements, other number types, the other byte order, text in rows, sparse arrays, logical values."""
    for order, mark in (("<", b"IM"), (">", b"MI")):
        element = lambda kind, body, o=order: struct.pack(o + "II", kind, len(body)) + body + bytes(-len(body) % 8)
        small = lambda kind, body, o=order: struct.pack(o + "I", len(body) << 16 | kind) + body.ljust(4, b"\0")
        array = lambda cls, dims, name, rest, o=order: element(14, element(6, struct.pack(o + "II", cls | 1 << 9, 0)) + element(5, struct.pack(f"{o}{len(dims)}i", *dims)) + small(1, name) + rest)
        body = array(6, (2, 2), b"d", small(2, bytes([1, 2, 3, 4]))) + array(4, (2, 2), b"c", element(17, "acbd".encode("utf-16-le" if order == "<" else "utf-16-be")))
        body += array(5, (3, 2), b"s", element(5, struct.pack(order + "2i", 0, 2)) + element(5, struct.pack(order + "3i", 0, 1, 2)) + element(9, struct.pack(order + "2d", 1.5, -2.0))) + array(10, (1, 3), b"i", element(3, struct.pack(order + "3h", -1, 0, 7)))
        got = mat.decode(b"x" * 124 + struct.pack(order + "H", 0x100) + mark + body)
        assert got["d"].tolist() == [[1, 3], [2, 4]] and got["c"] == ["ab", "cd"] and got["s"].tolist() == [[1.5, 0], [0, 0], [0, -2.0]] and got["i"].tolist() == [[-1, 0, 7]]


def test_damaged_files_are_errors():
    whole = mat.file_of({mat.CELLS: ({mat.CELL_TYPE: "PC", mat.BINS: np.ones((30, 2))},)}, False)
    for cut in (0, 50, 130, 140, 200, len(whole) - 9):
        with pytest.raises(Exception):  # noqa: B017  any error is one row
            decoded = mat.decode(whole[:cut])
            list(mat.cell_rows("s", decoded))
    with pytest.raises(ValueError):
        mat.decode(bytes(200))


def test_sessions_end_as_compiled_spikes(spark, tmp_path):
    cells, reaches = tables(spark, "060102_x1")
    more = tables(spark, "other")
    mat.write_sessions(cells.unionByName(more[0]), reaches.unionByName(more[1]), str(tmp_path / "raw"))
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["060102_x1.mat", "other.mat"]
    a, b, errors = mat.read_sessions(spark, f"file://{tmp_path}/raw")
    assert errors.count() == 0
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(a.where("session = 'other'")) == key(more[0]) and key(b.where("session = 'other'")) == key(more[1])
    spike, kin = sessions.compile_sessions(a, b)
    wanted = sessions.compile_sessions(cells, reaches)
    assert key(spike.where("session <> 'other'").drop("session")) == key(wanted[0].drop("session")) and kin.count() == 2 * wanted[1].count()


def test_names_bad_files_and_options(spark, tmp_path):
    good = mat.file_of({mat.CELLS: {mat.CELL_TYPE: "PC", mat.BINS: np.array([[0.1, 1.0]])}, mat.REACHES: {mat.KINEMATICS: np.array([[0.5, 1.0, 2.0]]), mat.LABEL: 2.0}, "extra": {"deep": [1.0, "t"]}})
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "Joker_060102_x10_NPresults.mat").write_bytes(good)
    (tmp_path / "Joker_060102_bad.mat").write_bytes(good[:-40])
    (tmp_path / "notes.txt").write_text("no session")
    cells, reaches, errors = mat.read_sessions(spark, str(tmp_path))
    assert [tuple(r) for r in cells.collect()] == [("060102_x10", 0, "PC", 0, 0.1, 1.0)]
    r = reaches.first()
    assert (r.session, r.stim, r.time, r.k1, r.k2, r.k3) == ("060102_x10", "2", 0.5, 1.0, 2.0, None)
    bad = errors.collect()
    assert len(bad) == 1 and bad[0].path.endswith("Joker_060102_bad.mat") and bad[0].error
    with pytest.raises(Exception, match="Joker_060102_bad"):
        mat.read_table(spark, str(tmp_path), "cells", mode="fail").count()
    nested = mat.read_table(spark, str(tmp_path / "below"), "variables", variables="extra").collect()
    assert sorted((x.place, x.kind, x.numbers, x.text) for x in nested) == [("extra.deep[0]", "numbers", [1.0], None), ("extra.deep[1]", "text", None, "t")]
    assert mat.read_table(spark, str(tmp_path), "cells", pathGlobFilter="*.none").count() == 0
    with pytest.raises(Exception, match="no table"):
        mat.read_table(spark, str(tmp_path), "something").count()
