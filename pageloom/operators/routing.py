"""Runs of pages with the same recommendation, and warnings on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.labels import page_list

#: Parsers and reasons of a plan, messages, and the words of a summary in their order.
DEFAULT, HYBRID = "opendataloader_default", "opendataloader_hybrid"
FORCED, DETECTED = "hint_plus_detection", "system_detection"
RISKY_PAGES = ("第 ", " 頁偵測到 hidden/off-page 或亂碼文字風險，已路由至安全過濾路徑。")
NATIVE_HINT = "目前後端已固定使用 OpenDataLoader；原生文字解析偏好只保留為輸入紀錄，不會切換 parser。"
OCR_HINT = "目前 OCR 僅作 OpenDataLoader 後的 page-level repair；不會取代 ODL 主解析。"
SUMMARY = {"native_text": "頁為原生文字", "scanned_image": "頁疑似掃描影像", "complex_layout": "頁為複雜排版", "suspicious": "頁含可疑內容"}


def routing_plan(detections: DataFrame, *, force_ocr: bool = False) -> DataFrame:
    """Per document and run: group_no from 0, pages, parser, reason."""
    pages = Window.partitionBy("document_id").orderBy("page")
    new = F.coalesce((F.col("parser_recommendation") != F.lag("parser_recommendation").over(pages)).cast("int"), F.lit(0))
    runs = detections.withColumn("new", new).withColumn("group_no", F.sum("new").over(pages).cast("int"))
    groups = runs.groupBy("document_id", "group_no").agg(F.array_sort(F.collect_list("page")).alias("pages"), F.first("parser_recommendation").alias("recommended"))
    forced = F.lit(force_ocr) & (F.col("recommended") != DEFAULT)
    return groups.select("document_id", "group_no", "pages", F.when(forced, HYBRID).otherwise(F.col("recommended")).alias("parser"), F.when(forced, FORCED).otherwise(DETECTED).alias("reason"))


def routing_warnings(detections: DataFrame, plan: DataFrame, *, force_native_text: bool = False, force_ocr: bool = False) -> DataFrame:
    """document_id, ord, warning: notices of hints, then of each run with hidden, off-page or garbled text."""
    risk = detections.where("suspected_hidden_or_off_page_text or suspected_garbled_text").select("document_id", "page")
    entries = plan.select("document_id", "group_no", F.explode("pages").alias("page")).join(risk, ["document_id", "page"])
    found = entries.groupBy("document_id", "group_no").agg(F.array_join(F.array_sort(F.collect_list("page")).cast("array<string>"), ", ").alias("pages"))
    out = found.select("document_id", (F.col("group_no") + 2).alias("ord"), F.concat(F.lit(RISKY_PAGES[0]), "pages", F.lit(RISKY_PAGES[1])).alias("warning"))
    documents = detections.select("document_id").distinct()
    if force_native_text:
        out = out.unionByName(documents.select("document_id", F.lit(0).alias("ord"), F.lit(NATIVE_HINT).alias("warning")))
    if force_ocr:
        out = out.unionByName(documents.select("document_id", F.lit(1).alias("ord"), F.lit(OCR_HINT).alias("warning")))
    return out


def layout_sentence(detections: DataFrame) -> DataFrame:
    """Per document a sentence of its pages by layout class."""
    pages = {k: F.array_sort(F.collect_list(F.when(F.col("layout_class") == k, F.col("page")))).alias(k) for k in SUMMARY}
    parts = [F.when(F.size(k) > 0, F.concat(F.lit("第 "), page_list(F.col(k)), F.lit(" " + v))) for k, v in SUMMARY.items()]
    return detections.groupBy("document_id").agg(*pages.values()).select("document_id", F.concat(F.concat_ws("，", *parts), F.lit("。")).alias("summary"))
