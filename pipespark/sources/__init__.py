"""Readers and writers of CSV, JSON lines and Parquet."""

from .scan import detect_format, read_csv, read_jsonl, read_parquet, scan
from .sink import sink, write_csv, write_jsonl, write_parquet
from .storage import Storage

__all__ = ["Storage", "detect_format", "read_csv", "read_jsonl", "read_parquet", "scan", "sink", "write_csv", "write_jsonl", "write_parquet"]
