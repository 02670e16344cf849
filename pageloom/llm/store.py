"""Intermediate tables of a run: written to the folder that all share, or held by the executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that go to Python at once. Texts may be long, and a batch is held by the JVM and by Python.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
#: Bytes of a table that go to all executors.
BROADCAST_BYTES = 16 << 20

#: The tables of the scope that this thread (or context) is in, innermost.
_scope: ContextVar[list | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Within it, results of the operators that the same thread calls can be used; at its end their intermediate tables go and the session has its settings again."""
    before = {name: spark.conf.get(name) for name in BATCHES}
    own: list[Scratch] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for scratch in own:
            scratch.close()
        for name, value in before.items():
            spark.conf.set(name, value)


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes; a lower setting stays."""
    for name, most in BATCHES.items():
        now = spark.conf.get(name)
        bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) if now[:1].isdigit() else 0
        if not 0 < bound <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and there is but one machine (tests), a local temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = _own_dir()
    return at.rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="pageloom-")


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """The table, sent to all executors if its rows come to at most BROADCAST_BYTES (counted, strings and arrays by their own length)."""
    fixed, sizes = 16, []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            sizes.append(F.octet_length(field.name))
        elif isinstance(field.dataType, T.ArrayType):
            sizes.append(8 * F.size(field.name))
        else:
            fixed += 16 if isinstance(field.dataType, T.StructType) else 8
    total = sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(fixed))
    found = df.agg(F.sum(total.cast("long"))).first()[0] or 0
    return F.broadcast(df) if found <= (BROADCAST_BYTES if most is None else most) else df


def passed(keep, made) -> tuple[str, ...]:
    """The columns to pass on: those in keep without names of the result (case ignored), whose columns the operator makes."""
    return tuple(x for x in keep if x.lower() not in {y.lower() for y in made})


def fresh(names, made) -> None:
    """ValueError if a column that is passed on has the name of one that the operator makes (case ignored)."""
    clash = sorted({x.lower() for x in names} & {x.lower() for x in made})
    if clash:
        raise ValueError(f"columns that are passed on have names of the result: {', '.join(clash)}")


class Scratch:
    """Tables of one run. Kept ones are Parquet in the shared folder: their lineage ends, and a lost executor costs
    nothing. Held ones lie on the executors' disks and are computed again from their lineage if one is lost; they
    must not depend on the order of rows. What is left goes at the end of the scope, else when the session's JVM
    ends; as a context, a run that breaks off leaves nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/pageloom-{name}-{uuid.uuid4().hex}"
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)
        self.held: dict[str, DataFrame] = {}
        if (own := _scope.get()) is not None:
            own.append(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.close()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def hold(self, df: DataFrame, name: str) -> DataFrame:
        """Compute df now, and once."""
        self.held[name] = df.persist(StorageLevel.DISK_ONLY)
        self.held[name].count()
        return self.held[name]

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.held:
                self.held.pop(name).unpersist()
            else:
                self.fs.delete(self._path(name), True)

    def close(self) -> None:
        self.drop(*list(self.held))
        self.fs.delete(self._path(""), True)
