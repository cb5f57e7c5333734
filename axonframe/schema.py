"""Schemas of the canonical tables. Long form: one row for each cell or column and time bin."""

from pyspark.sql import types as T

REACH = ["session", "stim", "reach"]

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "doubles": T.ArrayType(T.DoubleType())}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


SPIKE = _schema("session string, stim int, reach int, t int, cell int, n double")
KIN = _schema("session string, stim int, reach int, t int, time double, x double, y double, z double, speed double, vx double, vy double, vz double")
CELL_BINS = _schema("session string, cell int, cell_type string, t_idx int, time double, n double")
REACH_KINEMATICS = _schema("session string, reach int, stim string, row int, time double, k1 double, k2 double, k3 double, k4 double, k5 double, k6 double, k7 double")
MODEL = _schema("session string, stim int, segment string, job int, h doubles, cpl doubles")

#: Columns of a compiled reach in order, and whether each is scaled to [0, 1] (else to [-1, 1]).
KINEMATIC_COLUMNS = ("x", "y", "z", "speed", "vx", "vy", "vz")
UNIT_SCALED = (True, True, True, True, False, False, False)
