"""Cut lineage with a table written to the shared checkpoint folder.

A written table survives the loss of any executor, carries its real size (so broadcast
decisions rest on it) and gives the next step a plan with no history. The last point
matters in loops: a plan that remembers its constraints grows with every round.

An operator that writes many steps opens a scope, ``with steps(spark) as scope``, and returns
``scope.keep(result)``: the result is written and all else that was written inside is deleted.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only for local runs."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="phrasegraph-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/phrasegraph-{name}-{uuid.uuid4().hex}"


class Steps:
    """The tables that :func:`durable` wrote inside one scope of :func:`steps`."""

    def __init__(self, spark: SparkSession, outer: Steps | None):
        self.spark = spark
        self.outer = outer
        self.paths: list[str] = []

    def keep(self, df: DataFrame, large_rows: bool = False) -> DataFrame:
        """``df`` written so that it outlives this scope; an enclosing scope still deletes it."""
        return _written(df, self.outer, large_rows)

    def drop(self, df: DataFrame) -> None:
        """Delete a written step of this scope whose last reader has run."""
        path = getattr(df, "_step_path", None)
        if path in self.paths:
            self.paths.remove(path)
            _delete(self.spark, path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    """Delete the steps written inside on leaving, also after a failure.

    Only :meth:`Steps.keep` gives a frame that may be read afterwards: a frame that still reads a step of the
    scope loses its files.
    """
    outer = getattr(_scopes, "top", None)
    scope = _scopes.top = Steps(spark, outer)
    try:
        yield scope
    finally:
        _scopes.top = outer
        for path in scope.paths:
            _delete(spark, path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


#: Whether Spark deletes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries inside go when a query ends; else they stay until the driver happens to collect their owners.

    Each write plans its frame anew, so no later query could have read them.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Row groups for rows of megabytes. Reader and writer hold a whole group, by default 128 MB and never less than 100 rows.
_SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def _written(df: DataFrame, scope: Steps | None, large_rows: bool = False) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    if scope is not None:
        scope.paths.append(path)
    with _shuffles_deleted(spark):
        df.write.options(**(_SMALL_GROUPS if large_rows else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def written_bytes(df: DataFrame) -> int | None:
    """Size of a written step on disk; None for any other frame."""
    path = getattr(df, "_step_path", None)
    if path is None:
        return None
    fs, target = _file_system(df.sparkSession, path)
    return fs.getContentSummary(target).getLength()


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it, and continue from the written table."""
    return _written(df, getattr(_scopes, "top", None))


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` returns, written; the steps it took are deleted."""
    with steps(spark) as scope:
        return scope.keep(make())
