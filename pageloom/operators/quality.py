"""Quality of the extraction, and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.5


def page_quality(blocks: DataFrame, detections: DataFrame) -> DataFrame:
    """Per page the number and mean confidence of its blocks, and whether it is empty or of low confidence."""
    found = blocks.groupBy("document_id", "page").agg(F.count("*").alias("n_blocks"), F.avg("confidence").alias("avg_confidence"))
    rows = detections.select("document_id", "page", "has_extractable_text").join(found, ["document_id", "page"], "left")
    n = F.coalesce("n_blocks", F.lit(0))
    return rows.select("document_id", "page", n.alias("n_blocks"), "avg_confidence", ((n == 0) & F.col("has_extractable_text")).alias("is_empty"), ((n > 0) & (F.col("avg_confidence") < LEAST_CONFIDENCE)).alias("is_low"))


def quality_report(blocks: DataFrame, detections: DataFrame) -> DataFrame:
    """Per document: requires_fallback, low_confidence_pages, empty_pages, warnings (in page order)."""
    p = F.col("page").cast("string")
    empty = F.concat(F.lit("第 "), p, F.lit(" 頁偵測到可解析文字但 blocks 為空，可能需要 fallback 解析。"))
    low = F.concat(F.lit("第 "), p, F.lit(" 頁平均 confidence ("), F.format_string("%.2f", F.col("avg_confidence")), F.lit(") 低於閾值，建議 fallback。"))
    pages = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("page"))))
    warning = F.when(F.col("is_empty"), empty).when(F.col("is_low"), low)
    grouped = page_quality(blocks, detections).groupBy("document_id").agg(pages("is_low").alias("low_confidence_pages"), pages("is_empty").alias("empty_pages"), F.transform(F.array_sort(F.collect_list(F.when(warning.isNotNull(), F.struct("page", warning.alias("w"))))), lambda x: x["w"]).alias("warnings"))
    return grouped.withColumn("requires_fallback", (F.size("low_confidence_pages") + F.size("empty_pages")) > 0)


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """document_id, ord, warning: each warning of a document once, where it first came."""
    first = warnings.groupBy("document_id", "warning").agg(F.min("ord").alias("at"))
    order = Window.partitionBy("document_id").orderBy("at", "warning")
    return first.select("document_id", (F.row_number().over(order) - 1).alias("ord"), "warning")
