"""Scans.  Paths may be local, ``file://`` or of any store that Spark's Hadoop file systems reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, SourceError, missing_column, unknown
from ..functions.types import FLOATS, INTEGERS, parse_type

#: File name endings and formats.
ENDINGS = {".parquet": "parquet", ".parq": "parquet", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "jsonl"}

Fields = Sequence[tuple[str, str] | tuple[str, str, bool]]


def detect_format(path: str) -> str:
    lower = path.lower().rstrip("/")
    return next((f for e, f in ENDINGS.items() if lower.endswith(e)), "csv")


def struct_of(fields: Fields) -> T.StructType:
    names = [f[0] for f in fields]
    if len(set(names)) < len(names):
        raise SchemaError("two fields of the schema have one name")
    return T.StructType([T.StructField(f[0], parse_type(f[1]), f[2] if len(f) > 2 else True) for f in fields])


def _strict(text: Column, kind: T.DataType) -> Column:
    """A cell as a value, null where it isn't written exactly as the type is: no padding, no other words for true and false."""
    if isinstance(kind, INTEGERS):
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(kind))
    if isinstance(kind, FLOATS):
        named = F.lower(text).rlike(r"^[+-]?(inf|infinity|nan)$")
        plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        return F.when(plain | named, text.try_cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.when(text == "true", True).when(text == "false", False)
    if isinstance(kind, T.StringType):
        return F.coalesce(text, F.lit(""))
    if isinstance(kind, T.BinaryType):
        return F.coalesce(text, F.lit("")).cast("binary")
    return text.try_cast(kind)


def _raw_csv(spark: SparkSession, path: str, header: bool, delimiter: str, multi_line: bool) -> DataFrame:
    options = {"header": header, "inferSchema": False, "mode": "PERMISSIVE", "sep": delimiter, "escape": '"', "quote": '"', "multiLine": multi_line, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spark.read.options(**options).csv(path)


def read_csv(spark: SparkSession, path: str, schema: Fields | None = None, header: bool = True, delimiter: str = ",", need_rows: bool = False, multi_line: bool = True) -> DataFrame:
    """With a header, columns are matched by name (after trimming the header), in the schema's order; others are left out
    and a missing one is an error.  Cells that don't read as their type are null; text cells are never null, short rows give
    empty text.  Without a schema all columns are text.  Without a header the schema names the columns by place, and short
    rows give nulls.  ``need_rows`` makes an empty file an error, for the price of looking into it.

    A quoted cell may hold line breaks, so a file is read by one task; without ``multi_line`` large files are read in splits,
    and no cell may hold one."""
    raw = _raw_csv(spark, path, header, delimiter, multi_line)
    if need_rows and not raw.limit(1).count():
        raise SourceError(f"no data in CSV file '{path}'")
    if not header:
        if schema is None:
            raise SchemaError("a CSV file without a header needs a schema")
        want = struct_of(schema)
        have = raw.columns
        cells = [F.col(f"`{have[i]}`") if i < len(have) else F.lit(None).cast("string") for i in range(len(want))]
        return raw.select(*[F.when(c.isNotNull(), _strict(c, f.dataType)).alias(f.name) for c, f in zip(cells, want.fields, strict=True)])
    names = [c.strip() for c in raw.columns]
    raw = raw.toDF(*[f"__c{i}" for i in range(len(names))])
    want = struct_of(schema) if schema else T.StructType([T.StructField(n, T.StringType()) for n in names])
    out = []
    for f in want.fields:
        if f.name not in names:
            raise missing_column(f.name, names)
        out.append(_strict(F.col(f"__c{names.index(f.name)}"), f.dataType).alias(f.name))
    return raw.select(*out)


def read_jsonl(spark: SparkSession, path: str, schema: Fields | None = None) -> DataFrame:
    """One object per line.  Columns are the union of the keys in sorted order, whole numbers bigint, other numbers double,
    nested values as JSON text; a missing key is null and blank lines are skipped.  A line that isn't JSON fails the read."""
    if schema is not None:
        return spark.read.option("mode", "FAILFAST").schema(struct_of(schema)).json(path)
    raw = spark.read.option("mode", "FAILFAST").json(path)
    cells = []
    for c in sorted(raw.columns):
        nested = isinstance(raw.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))
        cells.append((F.to_json(F.col(f"`{c}`")) if nested else F.col(f"`{c}`")).alias(c))
    return raw.select(*cells)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """The named columns in the order given, or all.  Filters and pruning reach the files through Catalyst."""
    df = spark.read.parquet(path)
    for c in columns:
        if c not in df.columns:
            raise missing_column(c, df.columns)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def scan(spark: SparkSession, source: str, schema: Fields = (), format: str | None = None) -> DataFrame:
    """A source by its ending or by name of its format.  For Parquet the schema's names are the projection, and its types are cast to."""
    kind = format or detect_format(source)
    if kind == "csv":
        return read_csv(spark, source, schema or None)
    if kind == "jsonl":
        return read_jsonl(spark, source, schema or None)
    if kind == "parquet":
        df = read_parquet(spark, source, [f[0] for f in schema])
        want = struct_of(schema)
        return df.select(*[F.col(f"`{f.name}`") if df.schema[f.name].dataType == f.dataType else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want.fields]) if schema else df
    raise unknown("source format", kind, ("csv", "jsonl", "parquet"))
