"""Names of types in pipelines and the Spark types they stand for."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..errors import unknown

#: The spellings that pipelines may use.
NAMES: dict[str, T.DataType] = {
    "Boolean": T.BooleanType(),
    "Bool": T.BooleanType(),
    "bool": T.BooleanType(),
    "Int32": T.IntegerType(),
    "i32": T.IntegerType(),
    "Int64": T.LongType(),
    "i64": T.LongType(),
    "Float32": T.FloatType(),
    "f32": T.FloatType(),
    "Float64": T.DoubleType(),
    "f64": T.DoubleType(),
    "Utf8": T.StringType(),
    "String": T.StringType(),
    "Binary": T.BinaryType(),
    "bytes": T.BinaryType(),
    "Date": T.DateType(),
    "Date64": T.TimestampType(),
    "Timestamp": T.TimestampType(),
    "Decimal128": T.DecimalType(38, 10),
}


def parse_type(name: str) -> T.DataType:
    """The Spark type of a spelling; also ``Decimal(p,s)``.  Unknown names are an error, never silently text."""
    if m := re.fullmatch(r"Decimal(?:128)?\((\d+),\s*(\d+)\)", str(name)):
        return T.DecimalType(int(m[1]), int(m[2]))
    if name not in NAMES:
        raise unknown("type", name, NAMES)
    return NAMES[name]


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (*INTEGERS, *FLOATS, T.DecimalType))
