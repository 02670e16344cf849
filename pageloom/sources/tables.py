"""Tables written once because several later steps read them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of the scope that this thread (or context) is in, innermost.
_scope: ContextVar[list | None] = ContextVar("scope", default=None)
#: Where written tables lie.
_places: WeakKeyDictionary[DataFrame, tuple] = WeakKeyDictionary()
#: Rows of a table of more bytes than this are dealt in parts, so many at most.
PART_BYTES, MOST_PARTS = 64 << 20, 4
#: Spark's setting that a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside = threading.Lock(), {}


@contextmanager
def scope() -> Iterator[None]:
    """Tables written within it, by the same thread, go at its end."""
    own: list = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for fs, path in own:
            fs.delete(path, True)


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="pageloom-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and there is but one machine (tests), a local temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = _own_dir()
    return at.rstrip("/")


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are run within it go at their end. Threads may be in it together; the last one sets the setting back."""
    key = str(spark._jsparkSession.sessionUUID())
    with _lock:
        n, before = _inside.get(key) or (0, spark.conf.get(CLEANUP, None))
        _inside[key] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _inside.pop(key)
            if n > 1:
                _inside[key] = n - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, *more: DataFrame) -> DataFrame:
    """The rows of df, and of more parts with its columns, from Parquet in the folder that all machines share.

    The plan ends there, so what follows doesn't plan or compute it again, and
    a lost executor costs nothing. Parts are written one after the other, each with its shuffles only. The files go
    with `dropped`, at the end of the scope, else when the session's JVM ends.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pageloom-table-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    if (own := _scope.get()) is not None:
        own.append((fs, path))
    with _shuffles_go(spark):
        for part in (df, *more):
            part.write.mode("append").option("compression", "zstd").parquet(path.toString())
    table = spark.read.schema(df.schema).parquet(path.toString())
    _places[table] = fs, path
    return table


def dropped(*tables: DataFrame) -> None:
    """Written tables go now; nothing can read them any more."""
    for table in tables:
        fs, path = _places.pop(table)
        fs.delete(path, True)


def parts(table: DataFrame, key: str = "document_id") -> list[Column]:
    """Conditions on the key that deal the rows of a written table (and of others with that key) in parts. Each row meets one."""
    fs, path = _places[table]
    n = min(MOST_PARTS, 1 + fs.getContentSummary(path).getLength() // PART_BYTES)
    return [F.pmod(F.xxhash64(key), F.lit(n)) == k for k in range(n)] if n > 1 else [F.lit(True)]
