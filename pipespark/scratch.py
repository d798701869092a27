"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_own: list[str] = []
_lasting: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where there is but one machine, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='pipespark-')}")
    return _own[0]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables written under the shared folder to cut lineage: a lost executor costs a task, not the plan.

    What a result still reads must stay, so tables live until ``drop``, the end of the ``scope`` that the workspace was made
    in, or the end of the session.
    """

    def __init__(self, spark: SparkSession, lasting: bool = False):
        """``lasting``: not of any scope."""
        self.spark = spark
        self.root = f"{shared_root(spark)}/pipespark-{uuid.uuid4().hex}"
        self._n = 0
        _made[self.root] = spark
        if lasting:
            _lasting.add(self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns a frame that reads it."""
        path = self.path(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._workspace_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Deletes what ``keep`` wrote; for tables that no result reads any more."""
        _delete(self.spark, df._workspace_path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Workspaces made inside are deleted at its end; results that must live on are written to one made before."""
    before = set(_made)
    try:
        yield
    finally:
        for root in [r for r in _made if r not in before and r not in _lasting]:
            _delete(_made.pop(root), root)


@atexit.register
def _clean() -> None:
    for root, spark in _made.items():
        try:
            _delete(spark, root)
        except Exception:  # the session may be gone by now; the folder is then the cluster's to clear
            pass
    for own in _own:
        shutil.rmtree(own.removeprefix("file://"), ignore_errors=True)
