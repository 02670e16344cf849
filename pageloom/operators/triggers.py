"""Which pages need repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.labels import is_skipped
from pageloom.functions.text import has_text
from pageloom.operators.stats import needs_scan
from pageloom.plans.options import IngestOptions


def _hole():
    kind = F.lower(F.col("type"))
    no_rows = F.col("rows_json").isNull() | (F.col("rows_json") == "[]")
    return ~is_skipped(F.col("type")) & ~has_text(F.col("content")) & ((kind != "table") | no_rows)


def structural_holes(items: DataFrame) -> DataFrame:
    """Pages with an item that isn't skipped and has neither text nor table rows."""
    return items.where(_hole()).select("document_id", "page").distinct()


def repair_triggers(stats: DataFrame, items: DataFrame, options: IngestOptions) -> DataFrame:
    """document_id, page, triggers of known pages with any, in their fixed order."""
    table = (F.lower(F.col("type")) == "table") & F.col("rows_json").isNotNull() & (F.col("rows_json") != "[]")
    flags = items.groupBy("document_id", "page").agg(F.max(_hole()).alias("hole"), F.max(table).alias("rows"))
    rows = stats.join(flags, ["document_id", "page"], "left")
    on = lambda option, when, name: F.when(F.lit(option) & F.coalesce(when, F.lit(False)), name)
    reasons = F.array(
        on(options.repair_on_scan_or_low_text, needs_scan(F.col("char_count"), F.col("has_extractable_text")), "scan_or_low_text"),
        on(options.repair_on_structural_hole, F.col("hole"), "structural_hole"),
        on(options.enable_complex_table_parsing or options.enable_ocr_repair, F.col("rows"), "table_layout"),
    )
    found = rows.select("document_id", "page", F.filter(reasons, lambda x: x.isNotNull()).alias("triggers")).where(F.size("triggers") > 0)
    return found if options.enable_ocr_repair else found.where(F.lit(False))


def cap_pages(triggered: DataFrame, max_pages: int | None) -> DataFrame:
    """The first max_pages pages of each document; None: all."""
    if max_pages is None:
        return triggered
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("page"))
    return triggered.withColumn("rank", rank).where(F.col("rank") <= max_pages).drop("rank")


def cap_warnings(triggered: DataFrame, options: IngestOptions) -> DataFrame:
    most = options.max_pages
    counts = triggered.groupBy("document_id").agg(F.count("*").alias("n")).where(F.lit(most is not None) & (F.col("n") > (most or 0)))
    return counts.select("document_id", F.concat(F.lit(f"OCR repair 使用 {options.profile} profile，僅處理前 {most} / "), F.col("n").cast("string"), F.lit(" 個觸發頁面。")).alias("warning"))
