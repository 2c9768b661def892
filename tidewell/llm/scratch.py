"""Intermediate tables, written where every executor can read them.

A written table cuts lineage and outlives the executor that wrote it, so a lost
executor never forces the work before it to be repeated.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: ContextVar[list["Scratch"] | None] = ContextVar("made", default=None)


class ScratchError(RuntimeError):
    """There is no folder that every executor can read."""


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark is local, one that goes at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ScratchError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _OWN[app] = tempfile.mkdtemp(prefix=f"{app}-", dir="/tmp/checkpoints")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


class Scratch:
    """Tables of one operator run, in a folder of their own below the shared root.

    An operator drops its tables as soon as nothing reads them; what its lazy result still reads is one table, or
    a few, that go with clear(), or with the block of collected() that the operator ran in.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        if (made := _MADE.get()) is not None:
            made.append(self)

    def only(self, result: DataFrame, name: str, **options: str | int) -> DataFrame:
        """Write result, delete all other tables of this run, and return it read back."""
        before = self.path
        self.path = f"{self.path}-result"
        kept = self.keep(result, name, **options)
        self._delete(before)
        return kept

    def keep(self, df: DataFrame, name: str, **options: str | int) -> DataFrame:
        """Write df as Parquet, with the writer's options, and return the table read back."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.options(**options).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *kept: DataFrame | None) -> None:
        """Delete tables that nothing lazy reads any more."""
        for df in kept:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def clear(self) -> None:
        """Delete all tables of this run."""
        self._delete(self.path)


def free_heaps(spark: SparkSession) -> None:
    """Executors collect their garbage and give back the heap that is free then.

    A heap grows with the garbage of short-lived rows, up to its limit, and keeps what it has until it is next collected
    whole, which can be stages later. A task for each core: on all executors, unless Spark finds some of them busy.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


@contextmanager
def collected() -> Iterator[None]:
    """Whatever operators write in this block is deleted at its end: write their results in it."""
    made: list[Scratch] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for scratch in made:
            scratch.clear()
