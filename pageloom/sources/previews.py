"""The preview store: documents by id, written by any number of writers.

A write puts its rows in a folder of its own and is committed by a manifest with
the next free version number, which is created only if no one else has it; who
comes second takes the number after. What has no manifest doesn't count, so a
writer that dies leaves no half of a write. Of a document's rows those of the
highest version hold; deletes are rows that say so. A snapshot holds what is
visible at a version, a file a bucket, and stands for all versions up to it.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Commits that a writer tries, each on the number after the one that another took.
TRIES = 1000
OWN = ("deleted", "bucket")


class Version(NamedTuple):
    version: int
    folder: str
    buckets: int
    #: the version that a snapshot stands for, None: no snapshot
    upto: int | None


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """A file with the text at the path, whole and at once; False if there is one."""
    from py4j.protocol import Py4JJavaError

    fs, at = _fs(spark, path)
    data = bytearray(text.encode())
    try:
        if fs.getUri().getScheme() == "file":  # creation of local files isn't exclusive there; a second name for a whole file is
            files, local = spark._jvm.java.nio.file.Files, lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
            fs.mkdirs(at.getParent())
            files.write(local(draft), data, spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.OpenOption, 0))
            try:
                files.createLink(local(at), local(draft))
            finally:
                files.delete(local(draft))
        else:
            out = fs.create(at, False)
            out.write(data)
            out.close()
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "AlreadyBeingCreatedException"):
            return False
        raise
    return True


def versions(spark: SparkSession, path: str) -> list[Version]:
    """What is committed, in order; ValueError if a manifest can't be read."""
    fs, at = _fs(spark, f"{path}/_versions")
    if not fs.exists(at):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(at))
    names = [x for x in names if re.fullmatch(r"\d{12}\.json", x)]
    if not names:
        return []
    reader = spark.read.schema("value string").text(f"{path}/_versions", wholetext=True).where(F.col("_metadata.file_name").rlike(r"^\d{12}\.json$"))
    texts = {r.name: r.value for r in reader.select(F.col("_metadata.file_name").alias("name"), "value").toLocalIterator()}
    out = []
    for name in names:
        try:
            x = json.loads(texts[name])
            out.append(Version(int(name[:12]), str(x["folder"]), int(x["buckets"]), x.get("upto")))
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"{path}: manifest {name} can't be read") from e
    return out


def _commit(spark: SparkSession, path: str, folder: str, buckets: int, upto: int | None = None) -> int:
    at = max((v.version for v in versions(spark, path)), default=-1) + 1
    text = json.dumps({"folder": folder, "buckets": buckets, "upto": upto})
    for version in range(at, at + TRIES):
        if _create(spark, f"{path}/_versions/{version:012d}.json", text):
            return version
    raise RuntimeError(f"{path}: {TRIES} versions were taken by others")


def _bucket(document_id: Column, buckets: int) -> Column:
    return F.pmod(F.hash(document_id.cast("long")), F.lit(buckets))


def _agreed(known: list[Version], buckets: int | None) -> int:
    have = {v.buckets for v in known}
    if len(have) > 1 or (have and buckets not in (None, *have)):
        raise ValueError(f"the store has {sorted(have)} buckets, not {buckets}")
    return have.pop() if have else buckets or BUCKETS


def write_previews(spark: SparkSession, previews: DataFrame, path: str, *, deleted: bool = False, buckets: int | None = None) -> int:
    """Put documents into the store, or take them away, as one version, whose number is returned. buckets: folders by a hash of the id, fixed by the first write."""
    buckets = _agreed(versions(spark, path), buckets)
    folder = f"write-{uuid.uuid4().hex}"
    rows = previews.withColumns({"deleted": F.lit(deleted), "bucket": _bucket(F.col("document_id"), buckets)})
    rows.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    return _commit(spark, path, folder, buckets)


def _visible(spark: SparkSession, path: str, known: list[Version]) -> DataFrame:
    """Rows of the last snapshot and the versions after it, with version, deleted and bucket."""
    snapshot = max((v for v in known if v.upto is not None), key=lambda v: (v.upto, v.version), default=None)
    taken = [(v.folder, v.version) for v in known if v.upto is None and (snapshot is None or v.version > snapshot.upto)]
    taken += [(snapshot.folder, snapshot.upto)] if snapshot else []
    for folder, _ in taken:
        fs, at = _fs(spark, f"{path}/{folder}")
        if not fs.exists(at):
            raise ValueError(f"{path}: {folder} is committed but not there")
    rows = spark.read.option("basePath", path).option("mergeSchema", True).option("recursiveFileLookup", False)
    parts = None
    for folder, version in taken:
        # one folder a version: no more than were written since the last snapshot
        part = rows.option("basePath", f"{path}/{folder}").parquet(f"{path}/{folder}").withColumn("version", F.lit(version).cast("long"))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts


def read_previews(spark: SparkSession, path: str, document_id: int | None = None) -> DataFrame:
    """All documents of the store, or one (no row if it isn't known); of one only its bucket is read. FileNotFoundError if nothing was ever committed."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(path)
    rows = _visible(spark, path, known)
    if document_id is not None:
        rows = rows.where((F.col("bucket") == _bucket(F.lit(document_id), _agreed(known, None))) & (F.col("document_id") == document_id))
    last = rows.groupBy("document_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["document_id", "version"]).where("not deleted").drop("version", *OWN)


def compact_previews(spark: SparkSession, path: str) -> int:
    """Write a snapshot of what is visible now, a file a bucket; writes that others commit meanwhile come after it. Returns its version."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(path)
    buckets, folder = _agreed(known, None), f"snapshot-{uuid.uuid4().hex}"
    rows = read_previews(spark, path).withColumns({"deleted": F.lit(False), "bucket": _bucket(F.col("document_id"), buckets)})
    rows.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    return _commit(spark, path, folder, buckets, max(v.upto if v.upto is not None else v.version for v in known))


def vacuum_previews(spark: SparkSession, path: str) -> list[str]:
    """Delete folders and manifests that the last snapshot stands for; for times when no one reads by an older state. Returns the folders."""
    known = versions(spark, path)
    snapshot = max((v for v in known if v.upto is not None), key=lambda v: (v.upto, v.version), default=None)
    old = [v for v in known if snapshot is not None and v.version != snapshot.version and (v.version if v.upto is None else v.upto) <= snapshot.upto]
    for v in old:  # the manifest first: what is committed is there
        for name in (f"_versions/{v.version:012d}.json", v.folder):
            fs, at = _fs(spark, f"{path}/{name}")
            fs.delete(at, True)
    return [v.folder for v in old]
