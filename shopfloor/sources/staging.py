"""Shared-folder tables that pin down an intermediate result.

An intermediate is staged where it must not be evaluated twice (its row
numbering depends on sampled range bounds) or where recomputing it after a lost
executor would be too dear. Staged data lives in the folder the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


class Scope:
    """The tables staged by one run, so that it can delete its own and no other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def release(self, spark: SparkSession) -> int:
        """Delete the tables of this scope; call when the results made from them are written."""
        jvm, removed = spark.sparkContext._jvm, 0
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            removed += bool(path.getFileSystem(conf).delete(path, True))
        return removed


_scope: ContextVar[Scope | None] = ContextVar("staging_scope", default=None)


@contextmanager
def scope() -> Iterator[Scope]:
    """Record what is staged inside the block. Without a scope staged tables stay."""
    token = _scope.set(Scope())
    try:
        yield _scope.get()
    finally:
        _scope.reset(token)


def workspace(spark: SparkSession) -> str:
    """Folder for staged tables, on storage all executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/") + "/shopfloor"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="shopfloor-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return "file://" + _local_root[0]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and continue from the written table."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    if _scope.get():
        _scope.get().paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage frames that do not depend on each other, as concurrent jobs."""
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        # Each thread gets a copy of the context, so it records in the caller's scope.
        jobs = {name: pool.submit(copy_context().run, stage, frame, name) for name, frame in frames.items()}
        return {name: job.result() for name, job in jobs.items()}
