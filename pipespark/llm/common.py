"""What the operators share: Arrow access and small helpers.

A text column goes to Python as binary (its UTF-8 bytes), so that a batch is one contiguous
buffer with offsets and most kernels never build a Python string per row.
"""

from __future__ import annotations

import contextlib
import ctypes
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Workspace as Workspace
from ..sources.storage import Storage

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Bytes of text that a kernel works on at once; bounds its temporary arrays.
CHUNK_BYTES = 4 << 20

#: Rows of an Arrow batch, where the session doesn't say: texts of some kilobytes then make batches of megabytes.
BATCH_ROWS = 512


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each application: their Python imports it, wherever the driver found it."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = f"{Workspace(spark, lasting=True).path('code')}/pipespark_sources.zip"
    Storage(spark).write(path, packed.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small enough for rows that hold texts, and whose executors have the package."""
    ship(df.sparkSession)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not df.sparkSession._jsparkSession.conf().contains(name):  # a value that was set is left alone
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def tidy() -> None:
    """Gives freed memory back to the system, so that an idle Python worker holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with ``tidy`` after its last batch."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return both


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in bounded batches, by a function that leaves no memory behind."""
    return bounded(df).mapInArrow(tidied(run), schema)


def regrouped(batches: Iterator[pa.RecordBatch], rows: int, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows`` rows or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """The UTF-8 bytes of a text, empty for null."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary")


def text_at(df: DataFrame, text: str) -> tuple[DataFrame, int, int]:
    """(frame, place of the text as a string column, number of columns to hand on).

    A text that is a string already is read where it stands, so that it isn't sent to Python twice.
    """
    if isinstance(df.schema[text].dataType, T.StringType):
        return df, df.columns.index(text), len(df.columns)
    return df.withColumn("__text", F.col(text).cast("string")), len(df.columns), len(df.columns)


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column, without copying; bytes[offsets[i]:offsets[i+1]] is row i, empty for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0), cut so that each has about ``size`` bytes or one row."""
    data, at = buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(text: bytes) -> list[bytes]:
    """The `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased: bytes.split cuts at exactly those six bytes."""
    return text.translate(LOWER).split()


def blobs(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
