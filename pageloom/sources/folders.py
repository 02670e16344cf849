"""A folder of parser output: for each document the JSON of two passes and the page-information text, by the names of their files.

    <folder>/<kind>/<stem>.json    kinds default and struct: the passes
    <folder>/<kind>/<stem>.txt     kind info: page information

The folder is listed once and read by Spark's own file source, so it may lie in
any store that Spark reads. Texts are brought together by stem with one
shuffle. A document is a stem of any kind: what it lacks is null and named in
`missing`. Spark's file sources don't list files of no bytes, so these are
missing too. Files of other names are left alone; of a stem's files of one kind
(in folders below) the last path counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of a file and the column that its text goes to.
KINDS = {"info": "page_info", "default": "pass_1", "struct": "pass_2"}
#: Kind and stem in a path.
PLACE = r"/(info|default|struct)/(?:.*/)?([^/]+)\.(?:json|txt)$"
#: Fixed value: what is said of documents that no parser was there for.
NO_PARSER = "找不到 Java 11+ 環境（JAVA_HOME 未設定，/opt/homebrew/opt/openjdk 也不存在）。OpenDataLoader 無法執行。"


def read_parser_output(spark: SparkSession, folder: str) -> DataFrame:
    """document_id (hash of the stem), stem, page_info, pass_1 and pass_2 (texts, null: no file) and missing (kinds without a file)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,txt}").load(folder)
    path = F.col("path")
    rows = files.select(F.col("content").cast("string").alias("value"), "path", F.regexp_extract(path, PLACE, 1).alias("kind"), F.url_decode(F.replace(F.regexp_extract(path, PLACE, 2), F.lit("+"), F.lit("%2B"))).alias("stem")).where("kind != ''")
    texts = rows.groupBy("stem").agg(*(F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("path"))).alias(v) for k, v in KINDS.items()), F.collect_set("kind").alias("__kinds"))
    known = F.array(*(F.lit(k) for k in KINDS))
    return texts.select(F.xxhash64("stem").alias("document_id"), "stem", *KINDS.values(), F.array_except(known, "__kinds").alias("missing"))


def parser_missing(documents: DataFrame) -> DataFrame:
    """document_id, warning: what a run without a parser says of its documents, which have no items."""
    return documents.select("document_id", F.lit(NO_PARSER).alias("warning")).distinct()
