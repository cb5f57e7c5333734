"""Sessions as MAT files (level 5): a Spark data source that reads them, and a writer.

    spark.dataSource.register(MatSessions)
    spark.read.format("matsession").option("table", "cells").load(folder)

Files are level 5 of the format: a header, then one element a variable, compressed or not; structs, struct arrays, cells,
text, numbers of any width, logical, complex (the real part) and sparse arrays are decoded.
"""

from __future__ import annotations

import fnmatch
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import basename

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from axonframe.schema import CELL_BINS, REACH_KINEMATICS
from axonframe.sources.sessions import NAME_PATTERN

#: Types of elements that hold numbers, classes of arrays, and the types of other elements.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHAR, SPARSE, DOUBLE, FIRST_NUMBER, LAST_NUMBER = 1, 2, 3, 4, 5, 6, 6, 15
#: Bytes of a compressed variable that are looked at to learn its name.
NAME_BYTES = 512
#: Names of the variables and fields of a raw session.
CELLS, REACHES, CELL_TYPE, BINS, LABEL, KINEMATICS = "cellData", "ReachS", "cellID", "Bin10", "stim", "filt_kin"


class Element:
    """One element of a buffer: its type, its bytes, and where the next one begins."""

    def __init__(self, data: memoryview, at: int, order: str):
        if at + 8 > len(data):
            raise ValueError(f"the file ends within a tag, at byte {at} of {len(data)}")
        first, size = struct.unpack_from(order + "II", data, at)
        if first >> 16:  # a small element: type, size and up to four bytes share the eight of a tag
            self.kind, size, begin = first & 0xFFFF, first >> 16, at + 4
            self.next = at + 8
        else:
            self.kind, begin = first, at + 8
            self.next = begin + size + (-size % 8 if self.kind != COMPRESSED else 0)
        if begin + size > len(data) or first >> 16 and size > 4:
            raise ValueError(f"an element of {size} bytes at byte {at} does not fit into {len(data)}")
        self.body = data[begin : begin + size]


def _inside(data: memoryview, order: str) -> Iterator[Element]:
    at = 0
    while at < len(data):
        element = Element(data, at, order)
        at = element.next
        yield element


def _numbers(element: Element, order: str) -> np.ndarray:
    if element.kind not in NUMBERS:
        raise ValueError(f"element type {element.kind} holds no numbers")
    return np.frombuffer(element.body, order + NUMBERS[element.kind])


def _text(element: Element, order: str) -> str:
    if element.kind in TEXTS:
        return bytes(element.body).decode(TEXTS[element.kind] + ("" if element.kind == 16 else "-le" if order == "<" else "-be"))
    return "".join(map(chr, _numbers(element, order).tolist()))


def _array_head(parts: Iterator[Element], order: str) -> tuple[int, tuple[int, ...], str]:
    flags, dims, name = next(parts), next(parts), next(parts)
    return int(_numbers(flags, order)[0]) & 0xFF, tuple(_numbers(dims, order).tolist()), bytes(name.body).decode("latin-1")


def _value(body: memoryview, order: str):
    """A variable's value: numbers as an array, text as a string (a list of them for several rows), a cell as a list, a
    struct as a dict, or a list of dicts if it is an array of several or none."""
    if not len(body):
        return np.zeros((0, 0))
    parts = _inside(body, order)
    kind, dims, _ = _array_head(parts, order)
    count = int(np.prod(dims))
    if kind == CELL:
        return [_value(x.body, order) for _, x in zip(range(count), parts, strict=False)]
    if kind in (STRUCT, OBJECT):
        if kind == OBJECT:
            next(parts)  # the name of its class
        width = int(_numbers(next(parts), order)[0])
        names = bytes(next(parts).body)
        fields = [names[at : at + width].split(b"\0")[0].decode("latin-1") for at in range(0, len(names), width)] if width else []
        every = [{field: _value(next(parts).body, order) for field in fields} for _ in range(count)]
        return every[0] if count == 1 else every
    if kind == CHAR:
        element = next(parts, None)
        text = _text(element, order) if element is not None and count else ""
        if len(dims) == 2 and dims[0] > 1:
            return ["".join(text[row :: dims[0]]) for row in range(dims[0])]
        return text
    if kind == SPARSE:
        rows, starts, values = (_numbers(next(parts), order) for _ in range(3))
        out = np.zeros(dims)
        columns = np.repeat(np.arange(dims[1]), np.diff(starts[: dims[1] + 1]))
        out[rows[: len(columns)], columns] = values[: len(columns)]
        return out
    if FIRST_NUMBER <= kind <= LAST_NUMBER:
        element = next(parts, None)
        values = _numbers(element, order) if element is not None else np.zeros(0)
        if len(values) != count:
            raise ValueError(f"{len(values)} numbers for an array of {dims}")
        return values.reshape(dims, order="F")
    raise ValueError(f"arrays of class {kind} are not read")


def decode(content: bytes, wanted: set[str] | None = None) -> dict[str, object]:
    """The variables of a file by name, all or those wanted. Of others no more than the start is unpacked."""
    if len(content) < 128:
        raise ValueError("the file is shorter than a header")
    mark = content[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("the file is not of level 5")
    order, data, at, out = "<" if mark == b"IM" else ">", memoryview(content), 128, {}
    while at < len(data):
        outer = Element(data, at, order)
        at = outer.next
        if outer.kind == COMPRESSED:
            head = memoryview(zlib.decompressobj().decompress(outer.body, NAME_BYTES))
            if len(head) >= 8 and struct.unpack_from(order + "I", head)[0] != MATRIX:
                continue
            body, whole = head[8:], lambda raw=outer.body: Element(memoryview(zlib.decompress(raw)), 0, order).body
        elif outer.kind == MATRIX:
            body, whole = outer.body, lambda raw=outer.body: raw
        else:
            continue
        name = _name(body, order)
        if wanted is None or name in wanted:
            out[name] = _value(whole(), order)
    return out


def _name(body: memoryview, order: str) -> str:
    """A variable's name from the start of its array."""
    at = 0
    for _ in range(2):
        at = Element(body, at, order).next
    return bytes(Element(body, at, order).body).decode("latin-1")


# -- tables of a file


def _listed(value: object) -> list[dict]:
    if isinstance(value, dict):
        return [value]
    if isinstance(value, list) and all(isinstance(x, dict) for x in value):
        return value
    raise ValueError("a struct or an array of structs was expected")


def _label(value: object) -> str:
    """Text, or a number as text; whole numbers without a point; empty arrays are empty."""
    if isinstance(value, str):
        return value
    flat = np.asarray(value).ravel()
    if not flat.size:
        return ""
    return str(int(flat[0])) if float(flat[0]).is_integer() else str(float(flat[0]))


def _columns(value: object, width: int) -> np.ndarray:
    """A matrix of at least two columns as float; an empty one, or a single row, as it is meant."""
    table = np.asarray(value, dtype=float)
    if not table.size:
        return np.zeros((0, width))
    if table.ndim == 1:
        table = table[None, :]
    if table.ndim != 2:
        raise ValueError(f"a matrix was expected, not an array of {table.shape}")
    return table


def cell_rows(session: str, variables: dict[str, object]) -> Iterator[pa.RecordBatch]:
    """Rows of CELL_BINS: cells and rows by their place, from 0."""
    for k, cell in enumerate(_listed(variables[CELLS])):
        table = _columns(cell[BINS], 2)
        n = len(table)
        if n and table.shape[1] < 2:
            raise ValueError(f"{BINS} of cell {k} has {table.shape[1]} column")
        kind = _label(cell.get(CELL_TYPE, ""))
        yield pa.RecordBatch.from_arrays([pa.array([session] * n, pa.string()), pa.array(np.full(n, k, dtype=np.int32)), pa.array([kind] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(table[:, 0]), pa.array(table[:, 1])], names=CELL_BINS.names)


def reach_rows(session: str, variables: dict[str, object]) -> Iterator[pa.RecordBatch]:
    """Rows of REACH_KINEMATICS: reaches and rows by their place, from 0; columns that a file lacks are null."""
    width = len(REACH_KINEMATICS.names) - 5
    for k, reach in enumerate(_listed(variables[REACHES])):
        table = _columns(reach[KINEMATICS], 1 + width)
        n, label = len(table), _label(reach.get(LABEL, ""))
        numbers = [pa.array(table[:, c]) if c < table.shape[1] else pa.nulls(n, pa.float64()) for c in range(1 + width)]
        yield pa.RecordBatch.from_arrays([pa.array([session] * n, pa.string()), pa.array(np.full(n, k, dtype=np.int32)), pa.array([label] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *numbers], names=REACH_KINEMATICS.names)


def leaves(value: object, place: str) -> Iterator[tuple[str, str, list[int], list[float] | None, str | None]]:
    """(place, kind, dims, numbers, text) of what a nested value holds, such as ReachS[3].filt_kin; numbers by column."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from leaves(inner, f"{place}.{name}")
    elif isinstance(value, list):
        for k, inner in enumerate(value):
            yield from leaves(inner, f"{place}[{k}]")
    elif isinstance(value, str):
        yield place, "text", [1, len(value)], None, value
    else:
        array = np.asarray(value)
        yield place, "numbers", list(array.shape), array.ravel(order="F").astype(float).tolist(), None


_STRING, _DOUBLES, _LONGS = T.StringType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
VARIABLES = T.StructType([T.StructField("path", _STRING), T.StructField("session", _STRING), T.StructField("variable", _STRING), T.StructField("place", _STRING), T.StructField("kind", _STRING), T.StructField("dims", _LONGS), T.StructField("numbers", _DOUBLES), T.StructField("text", _STRING)])
ERRORS = T.StructType([T.StructField("path", _STRING), T.StructField("session", _STRING), T.StructField("error", _STRING)])
#: Table: its schema, and the variables that it is made of (None: all).
TABLES = {"cells": (CELL_BINS, {CELLS}), "reaches": (REACH_KINEMATICS, {REACHES}), "variables": (VARIABLES, None), "errors": (ERRORS, {CELLS, REACHES})}


def session_of(path: str) -> str:
    """date_identifier of a file that is named as sessions are, of any other its name without the ending."""
    name = basename(path)
    found = re.match(NAME_PATTERN, name, re.ASCII)
    return f"{found[2]}_{found[3]}" if found else name.rpartition(".")[0] or name


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


@dataclass
class MatPartition(InputPartition):
    """One file."""

    path: str
    shown: str


class MatReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*.mat")
        self.table, self.fails = options.get("table", "cells"), options.get("mode", "skip") == "fail"
        names = options.get("variables")
        self.wanted = {x.strip() for x in names.split(",")} if names else TABLES[self.table][1]

    def partitions(self) -> list[MatPartition]:
        """A partition a file; files are found in all folders below, by name."""
        system, root = _located(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else [x for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file]
        start = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        return [MatPartition(x.path, start + x.path) for x in sorted(files, key=lambda x: x.path) if fnmatch.fnmatch(basename(x.path), self.glob)] or [MatPartition("", "")]

    def read(self, partition: MatPartition) -> Iterator[pa.RecordBatch]:
        schema = TABLES[self.table][0]
        if not partition.path:
            return
        session = session_of(partition.path)
        try:
            with _located(self.path)[0].open_input_stream(partition.path) as stream:
                variables = decode(stream.read(), self.wanted)
            if self.table == "variables":
                rows = [(partition.shown, session, name, *leaf) for name, value in variables.items() for leaf in leaves(value, name)]
                found = [pa.RecordBatch.from_arrays([pa.array(c, _arrow(f.dataType)) for c, f in zip(zip(*rows), schema)], names=schema.names)] if rows else []
            elif self.table == "errors":
                found = [*cell_rows(session, variables), *reach_rows(session, variables)] and []
            else:
                found = list((cell_rows if self.table == "cells" else reach_rows)(session, variables))
        except Exception as e:  # one bad file does not stop the others, unless that is asked for
            if self.fails:
                raise ValueError(f"{partition.shown}: {type(e).__name__}: {e}") from e
            found = [pa.RecordBatch.from_arrays([pa.array([partition.shown]), pa.array([session]), pa.array([f"{type(e).__name__}: {e}"])], names=ERRORS.names)] if self.table == "errors" else []
        yield from found


def _arrow(kind: T.DataType) -> pa.DataType:
    return {_STRING: pa.string(), _DOUBLES: pa.list_(pa.float64()), _LONGS: pa.list_(pa.int64())}[kind]


class MatSessions(DataSource):
    """Format matsession. Options: path (a file or a folder), table (cells, reaches, variables or errors), variables (names
    with commas between, for the table variables), pathGlobFilter, and mode: skip (the default: files that cannot be
    decoded give no rows but in the table errors, one each) or fail.

    A file is read whole by one task, and of it only the variables that the table is made of are unpacked."""

    @classmethod
    def name(cls) -> str:
        return "matsession"

    def schema(self) -> T.StructType:
        table = self.options.get("table", "cells")
        if table not in TABLES:
            raise ValueError(f"no table {table!r}; there are {', '.join(TABLES)}")
        return TABLES[table][0]

    def reader(self, schema: T.StructType) -> MatReader:
        return MatReader({k.lower(): v for k, v in self.options.items()})


def read_table(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    spark.dataSource.register(MatSessions)
    return spark.read.format("matsession").option("table", table).options(**options).load(path)


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, reaches and errors of the MAT files in a folder; compile_sessions takes the first two."""
    return tuple(read_table(spark, path, table) for table in ("cells", "reaches", "errors"))


# -- writing


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)


def _array(kind: int, dims: tuple[int, ...], name: str, rest: bytes) -> bytes:
    return _element(MATRIX, _element(6, struct.pack("<II", kind, 0)) + _element(5, np.array(dims, "<i4").tobytes()) + _element(1, name.encode("latin-1")) + rest)


def encoded(value: object, name: str = "") -> bytes:
    """A value as an array element: text, numbers (as double), a list (as a cell), a dict (as a struct), or a tuple of dicts
    with the same fields (as a row of structs)."""
    if isinstance(value, str):
        return _array(CHAR, (1 if value else 0, len(value)), name, _element(17, value.encode("utf-16-le")) if ord(max(value, default="a")) < 0x10000 else _element(16, value.encode()))
    if isinstance(value, list):
        return _array(CELL, (1, len(value)), name, b"".join(map(encoded, value)))
    if isinstance(value, (dict, tuple)):
        rows = (value,) if isinstance(value, dict) else value
        fields = list(rows[0]) if rows else []
        width = max((len(f) for f in fields), default=0) + 1
        names = b"".join(f.encode("latin-1").ljust(width, b"\0") for f in fields)
        return _array(STRUCT, (1, len(rows)), name, _element(5, struct.pack("<i", width)) + _element(1, names) + b"".join(encoded(row[f]) for row in rows for f in fields))
    numbers = np.atleast_2d(np.asarray(value, dtype="<f8"))
    return _array(DOUBLE, numbers.shape, name, _element(9, numbers.tobytes(order="F")))


def file_of(variables: dict[str, object], compress: bool = True) -> bytes:
    """A file of level 5 with these variables."""
    out = [b"MATLAB 5.0 MAT-file".ljust(124), struct.pack("<H", 0x0100), b"IM"]
    for name, value in variables.items():
        body = encoded(value, name)
        packed = zlib.compress(body)
        out.append(struct.pack("<II", COMPRESSED, len(packed)) + packed if compress else body)
    return b"".join(out)


def write_sessions(cell_bins: DataFrame, reaches: DataFrame, path: str) -> None:
    """Raw tables (CELL_BINS, REACH_KINEMATICS) as MAT files, one a session, named by it. A session is put together in one
    task, as its file holds it whole. Cells and reaches stand at the place that is their number; those between that are
    missing are empty. A file is written under another name and moved once it is whole."""

    def write(key: tuple, cells, kin):
        import pandas as pd

        def tables(part, number: str, order: str, label: str, columns: list[str]) -> list[tuple[str, np.ndarray]]:
            out = [("", np.zeros((0, len(columns))))] * (int(part[number].max()) + 1 if len(part) else 0)
            for k, rows in part.groupby(number):
                out[int(k)] = (rows[label].iloc[0] or "", rows.sort_values(order)[columns].to_numpy(dtype=float))
            return out

        cell_tables = tables(cells, "cell", "t_idx", "cell_type", ["time", "n"])
        reach_tables = tables(kin, "reach", "row", "stim", REACH_KINEMATICS.names[4:])
        body = file_of({CELLS: tuple({CELL_TYPE: label, BINS: table} for label, table in cell_tables), REACHES: tuple({KINEMATICS: table, LABEL: label} for label, table in reach_tables)})
        system, root = _located(path)
        system.create_dir(root, recursive=True)
        name = f"{root}/{key[0]}.mat"
        with system.open_output_stream(f"{name}.part") as stream:
            stream.write(body)
        system.move(f"{name}.part", name)
        return pd.DataFrame({"session": [key[0]], "bytes": [len(body)]})

    a = cell_bins.select(*CELL_BINS.names).groupBy("session")
    b = reaches.select(*REACH_KINEMATICS.names).groupBy("session")
    a.cogroup(b).applyInPandas(write, "session string, bytes long").write.format("noop").mode("overwrite").save()
