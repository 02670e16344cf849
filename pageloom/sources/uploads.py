"""The upload store: contents by their hash, each once, and an index of the uploads that have them.

    <path>/contents/shard=<s>/    sha, content
    <path>/uploads/bucket=<b>/    document_id, file_path, size, sha, received

Contents go in folders by a hash of their digest, uploads by one of the document's
id, so an original is fetched from two folders without a look at the others.
Uploads are only ever added: of a document's the last received one counts.
Retention drops uploads received before a time, and contents that then no upload
has; it writes the folders that change anew, so it is for times without uploads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 256
CONTENTS, UPLOADS = "sha string, content binary, shard int", "document_id bigint, file_path string, size bigint, sha string, received timestamp, bucket int"


def _place(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(SHARDS)).cast("int")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _table(spark: SparkSession, path: str, kind: str, only: int | None = None) -> DataFrame:
    """contents or uploads, or one folder of it; a table that isn't there has no rows."""
    schema, name = (CONTENTS, "shard") if kind == "contents" else (UPLOADS, "bucket")
    at = f"{path}/{kind}" if only is None else f"{path}/{kind}/{name}={only}"
    fs, where = _fs(spark, at)
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(at)


def store_uploads(spark: SparkSession, uploads: DataFrame, path: str) -> None:
    """Add uploads (document_id, file_path, size, content and error, as read_uploads gives them); those with an error aren't stored. Contents that the store has aren't written."""
    rows = uploads.where("error is null and content is not null").withColumn("sha", F.sha2("content", 256))
    known = _table(spark, path, "contents").select("sha")
    fresh = rows.select("sha", "content").join(known, "sha", "left_anti").groupBy("sha").agg(F.first("content").alias("content"))
    fresh.withColumn("shard", _place(F.col("sha"))).repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{path}/contents")
    # after its contents: what the index names is there
    index = rows.select("document_id", "file_path", "size", "sha", F.current_timestamp().alias("received"), _place(F.col("document_id")).alias("bucket"))
    index.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/uploads")


def original(spark: SparkSession, path: str, document_id: int) -> bytes | None:
    """The content last uploaded for a document, None if it isn't known; one folder of uploads and one of contents are read."""
    places = spark.range(1).select(_place(F.lit(document_id).cast("long")).alias("b")).first().b
    found = _table(spark, path, "uploads", places).where(F.col("document_id") == document_id).orderBy(F.desc("received"), F.desc("sha")).first()
    if found is None:
        return None
    shard = spark.range(1).select(_place(F.lit(found.sha)).alias("s")).first().s
    row = _table(spark, path, "contents", shard).where(F.col("sha") == found.sha).first()
    if row is None:
        raise ValueError(f"{path}: the content {found.sha} of document {document_id} is missing")
    return bytes(row.content)


def drop_stale(spark: SparkSession, path: str, before) -> None:
    """Take away the uploads received before a time (a timestamp), and the contents that no other upload has. Only folders with something to drop are written."""
    uploads = _table(spark, path, "uploads")
    stale = F.col("received") < F.lit(before).cast("timestamp")
    _rewrite(spark, path, "uploads", uploads, stale, "bucket")
    needed = _table(spark, path, "uploads").select(F.col("sha").alias("__needed")).distinct()
    contents = _table(spark, path, "contents").join(needed, F.col("sha") == F.col("__needed"), "left")
    _rewrite(spark, path, "contents", contents, F.col("__needed").isNull(), "shard")


def _rewrite(spark: SparkSession, path: str, kind: str, rows: DataFrame, drop: Column, folder: str) -> None:
    """Write the folders that have rows to drop beside the store, then put them in place of the old ones."""
    touched = [r[0] for r in rows.where(drop).select(folder).distinct().collect()]  # SHARDS at most
    if not touched:
        return
    names = [c for c in rows.columns if not c.startswith("__")]
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    rows.where(F.col(folder).isin(touched) & ~drop).select(*names).repartition(folder).write.partitionBy(folder).parquet(draft)
    for x in touched:
        fs, old = _fs(spark, f"{path}/{kind}/{folder}={x}")
        _, new = _fs(spark, f"{draft}/{folder}={x}")
        fs.delete(old, True)
        if fs.exists(new):
            fs.rename(new, old)
    fs, at = _fs(spark, draft)
    fs.delete(at, True)
