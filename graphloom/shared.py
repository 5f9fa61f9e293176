"""Materialised intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing each round as Parquet below ``spark.checkpoint.dir`` and reading it
back: the next round starts from files that outlive a lost executor, and the old round can be removed at once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_scopes: list[list[Scratch]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by the session; only where none is set, a temporary one for local tests."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator run. ``cut`` writes and reads back, ``drop`` removes a table that is no longer read.

    Results are lazy and may read the tables, so these live until the ``scratch_scope`` around the run is left, or, without
    one, until the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._next = 0
        if _scopes and not lasting:
            _scopes[-1].append(self)
        else:
            atexit.register(self.clear)

    def path(self) -> str:
        self._next += 1
        return f"{self.base}/t{self._next}"

    def cut(self, df: DataFrame, by: str | None = None, **counters) -> tuple[DataFrame, dict, str]:
        """Write ``df``, in folders of the column ``by`` if there is one; returns it as read back, the named aggregate
        columns seen while writing, and the path."""
        path = self.path()
        watch = Observation() if counters else None
        out = df.observe(watch, *[c.alias(k) for k, c in counters.items()]) if watch else df
        writer = out.write.partitionBy(by) if by else out.write
        writer.parquet(path)
        seen = {k: v or 0 for k, v in watch.get.items()} if watch else {}
        return self.spark.read.schema(df.schema).parquet(path), seen, path

    def exists(self) -> bool:
        """Whether the tables are still there; someone else may have emptied the folder."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def drop(self, path: str) -> None:
        _delete(self.spark, path)

    def clear(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # the JVM is gone: nothing is left to clean with
            pass


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes the tables of all operators run inside when it is left: for services, which consume each result at once."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.clear()


def modified(spark: SparkSession, path: str) -> int:
    """When the newest file of a table was written, in milliseconds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    newest = 0
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
