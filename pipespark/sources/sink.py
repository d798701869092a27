"""Sinks.  A destination is a folder of part files, or with ``single`` one file, written by one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError, unknown

#: Codecs of Parquet files.
CODECS = ("none", "uncompressed", "snappy", "gzip", "zstd", "lz4")


def _flat(df: DataFrame) -> DataFrame:
    """CSV cells: null as empty, binary as a note of its length."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.concat(F.lit("[binary "), F.octet_length(c).cast("string"), F.lit(" bytes]"))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _write(df: DataFrame, destination: str, kind: str, options: dict, single: bool, mode: str) -> None:
    """Rows are written beside the destination first and then moved there, so a destination that the plan still reads is whole until all is written."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target = path(destination.rstrip("/"))
    fs = target.getFileSystem(conf)
    exists = fs.exists(target)
    if mode not in ("overwrite", "error", "append"):
        raise unknown("write mode", mode, ("overwrite", "error", "append"))
    if mode == "error" and exists:
        raise SourceError(f"destination '{destination}' already exists")
    if mode == "append":
        if single:
            raise SourceError("a single file can't be appended to")
        return getattr(df.write.mode("append").options(**options), kind)(destination)
    parent = target.getParent()
    aside = path(f"{parent.toString()}/.{target.getName()}-{uuid.uuid4().hex}")
    try:
        getattr((df.coalesce(1) if single else df).write.options(**options), kind)(aside.toString())
        new = aside
        if single:
            parts = [s.getPath() for s in fs.listStatus(aside) if s.getPath().getName().startswith("part-")]
            if not parts:
                raise SourceError("nothing was written", hints=["an empty frame without partitions gives no file"])
            new = parts[0]
        if exists:
            fs.delete(target, True)
        if not fs.rename(new, target):
            raise SourceError(f"can't move the result to '{destination}'")
    finally:
        fs.delete(aside, True)
    return None


def write_csv(df: DataFrame, destination: str, single: bool = False, mode: str = "overwrite", delimiter: str = ",") -> None:
    """With a header; null is an empty cell."""
    options = {"header": True, "sep": delimiter, "nullValue": "", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _write(_flat(df), destination, "csv", options, single, mode)


def write_jsonl(df: DataFrame, destination: str, single: bool = False, mode: str = "overwrite") -> None:
    """One object per line, keys in sorted order, nulls written as null, binary as text."""
    cells = [F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in sorted(df.schema.fields, key=lambda f: f.name)]
    _write(df.select(*cells), destination, "json", {"ignoreNullFields": False}, single, mode)


def write_parquet(df: DataFrame, destination: str, codec: str = "snappy", row_group_bytes: int | None = None, single: bool = False, mode: str = "overwrite") -> None:
    if codec.lower() not in CODECS:
        raise unknown("codec", codec, CODECS)
    options = {"compression": codec.lower()} | ({"parquet.block.size": row_group_bytes} if row_group_bytes else {})
    _write(df, destination, "parquet", options, single, mode)


def sink(df: DataFrame, destination: str, format: str = "csv", **options) -> None:
    """``stdout`` shows rows instead of writing them."""
    if destination == "stdout":
        return df.show(truncate=False)
    kinds = {"csv": write_csv, "jsonl": write_jsonl, "parquet": write_parquet}
    if format not in kinds:
        raise unknown("sink format", format, kinds)
    return kinds[format](df, destination, **options)
