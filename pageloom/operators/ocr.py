"""Repair by recognised text: attempts, choice, blocks, merge with native blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.geometry import quad_normalized
from pageloom.functions.text import has_text, source_hash, trim
from pageloom.operators.blocks import block_id, drop_overlapping
from pageloom.operators.cleanup import cleaned
from pageloom.operators.layout import layout_rank, reconstruct

PARSER, VERSION, LEAST_MEAN = "esearch-ocr-repair", "esearch-ocr-8.5.0", 0.55


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def confidence(mean: Column) -> Column:
    return F.least(F.lit(0.99), F.greatest(F.lit(0.5), F.when(finite(mean), mean).otherwise(0.5)))


def attempt_label(stage: Column, dpi: Column) -> Column:
    return F.when(dpi.isNotNull() & (dpi != 0), F.concat_ws("_", stage, dpi.cast("string"))).otherwise(stage)


def attempt_summary(attempts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each attempt with the mean confidence (finite values; 0 if none) and number of its paragraphs."""
    keys = ["document_id", "page", "attempt_no"]
    found = paragraphs.groupBy(*keys).agg(F.avg(F.when(finite(F.col("mean")), F.col("mean"))).alias("mean_confidence"), F.count("*").alias("paragraph_count"))
    return attempts.join(found, keys, "left").withColumns({"mean_confidence": F.coalesce("mean_confidence", F.lit(0.0)), "paragraph_count": F.coalesce("paragraph_count", F.lit(0)).cast("long")})


def choose_attempt(summary: DataFrame) -> DataFrame:
    """Per page the first attempt that is good enough, else the last one, even if worse."""
    good = (F.col("mean_confidence") >= LEAST_MEAN) & (F.col("paragraph_count") > 0)
    return summary.groupBy("document_id", "page").agg(F.coalesce(F.min(F.when(good, F.col("attempt_no"))), F.max("attempt_no")).alias("attempt_no"), F.max("error").alias("error"))


STEPS = {1: "poppler_raster", 2: "preprocess_greyscale_normalize", 3: "reraster", 4: "fallback_rec_ppocr_v4_doc"}


def attempt_log(summary: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per page the labels of all steps up to the chosen attempt: each attempt has one when it starts and one for its result."""
    rows = summary.join(chosen.select("document_id", "page", F.col("attempt_no").alias("last")), ["document_id", "page"]).where("attempt_no <= last")
    n, dpi = F.col("attempt_no"), F.col("dpi")
    start = F.when(n == 1, attempt_label(F.lit(STEPS[1]), dpi)).when(n == 2, STEPS[2]).when(n == 3, attempt_label(F.lit(STEPS[3]), dpi)).otherwise(STEPS[4])
    steps = F.array(start, attempt_label(F.col("stage"), dpi))
    return rows.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("attempt_no", steps.alias("steps")))).alias("s")).select("document_id", "page", F.flatten(F.transform("s", lambda x: x["steps"])).alias("fallback_reasons"))


RASTER = ("width_px", "height_px", "dpi", "model_label")


def chosen_lines(lines: DataFrame, attempts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Lines of each page's chosen attempt, with what RASTER names of it; pages with an error have none. pages: only of these, others go before any window.

    Lines and attempts are dealt by page once; means, counts and the choice are windows over a page's rows.
    """
    rows = lines.withColumn("is_line", F.lit(True)).unionByName(attempts.select("document_id", "page", "attempt_no", *RASTER, "error", F.lit(False).alias("is_line")), allowMissingColumns=True)
    page = Window.partitionBy("document_id", "page")
    attempt = Window.partitionBy("document_id", "page", "attempt_no")
    known = F.coalesce(F.max(~F.col("is_line")).over(attempt), F.lit(False))
    mean, n = F.avg(F.when(F.col("is_line") & finite(F.col("mean")), F.col("mean"))).over(attempt), F.count(F.when(F.col("is_line"), 1)).over(attempt)
    rows = rows.repartition("document_id", "page")
    if pages is not None:
        # by hash, so that the lines aren't sorted for this
        rows = rows.join(pages.select("document_id", "page").hint("shuffle_hash"), ["document_id", "page"], "left_semi")
    rows = rows.withColumns({x: F.max(x).over(attempt) for x in RASTER} | {"good": (mean >= LEAST_MEAN) & (n > 0), "known": known})
    last = F.when(F.col("known"), F.col("attempt_no"))
    rows = rows.withColumns({"chosen": F.coalesce(F.min(F.when(F.col("known") & F.col("good"), F.col("attempt_no"))).over(page), F.max(last).over(page)), "failed": F.max("error").over(page)})
    return rows.where("is_line and attempt_no = chosen and failed is null").select(*(x for x in lines.columns if x not in RASTER), *RASTER)


def ocr_blocks(lines: DataFrame, attempts: DataFrame, page_infos: DataFrame, triggered: DataFrame, *, convert=None, through: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Blocks of the chosen attempts of triggered pages, in reading order. Pages with an error have none. through: what cleaned paragraphs go through (written: then the attempts' lines take no room any more)."""
    paragraphs = reconstruct(chosen_lines(lines, attempts, triggered), carry=RASTER)
    pages = triggered.select("document_id", "page", "triggers").join(page_infos, ["document_id", "page"])
    rows = paragraphs.join(pages.hint("shuffle_hash"), ["document_id", "page"])
    rows = rows.withColumn("clean", cleaned(F.col("text"), convert=convert)).where(has_text(F.col("clean.text")) | F.col("clean.error").isNotNull())
    rows = through(rows)
    rows = rows.withColumn("bbox", quad_normalized(*(F.col(x) for x in ("x1", "y1", "x2", "y2", "width_px", "height_px", "page_width", "page_height"))))
    order = Window.partitionBy("document_id", "page").orderBy(layout_rank(F.col("strategy"), F.col("role")), "bbox.y", "bbox.x", "seq")
    rows = rows.withColumn("seq", F.row_number().over(order) - 1)
    return rows.select("document_id", "page", "seq", block_id(PARSER).alias("id"), F.lit("paragraph").alias("block_type"), trim(F.col("clean.text")).alias("text"), "bbox", F.lit(PARSER).alias("parser"), F.lit(VERSION).alias("parser_version"), F.lit("ocr").alias("extraction_mode"), confidence(F.col("mean")).alias("confidence"), F.array().cast("array<string>").alias("warnings"), source_hash(F.col("page"), F.col("clean.text")).alias("source_hash"), "model_label", F.col("clean.error").alias("error"), "triggers", "strategy", "role", F.col("clean.fixes").alias("fixes"), F.col("text").alias("original_text"))


def failed_pages(attempts: DataFrame, triggered: DataFrame) -> DataFrame:
    """document_id, warning for triggered pages whose attempts failed."""
    errors = attempts.groupBy("document_id", "page").agg(F.max("error").alias("error")).where("error is not null").join(triggered, ["document_id", "page"], "left_semi")
    return errors.select("document_id", F.concat(F.lit("OCR repair 第 "), F.col("page").cast("string"), F.lit(" 頁失敗: "), "error").alias("warning"))


def merge_blocks(native: DataFrame, repair: DataFrame) -> DataFrame:
    """Native blocks, then repair blocks whose text overlaps no block before on the page; seq is the new order on the page."""
    columns = native.columns
    extra = [x for x in repair.columns if x not in columns]
    rows = native.withColumn("src", F.lit(0)).unionByName(repair.select(*columns, *extra).withColumn("src", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("document_id", "page").orderBy("src", "seq")
    rows = rows.withColumn("seq", F.row_number().over(order) - 1)
    return drop_overlapping(rows, F.col("src") == 0).drop("src")
