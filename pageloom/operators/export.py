"""What a document is exported as: texts of pages and documents, previews, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import has_text, trim
from pageloom.sources.previews import read_previews as read_previews
from pageloom.sources.previews import write_previews as write_previews


def page_texts(blocks: DataFrame) -> DataFrame:
    """Per page its blocks' texts from top to bottom, a line each; blank ones left out."""
    line = F.when(has_text(F.col("text")), F.struct(F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), "seq", trim(F.col("text")).alias("t")))
    return blocks.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n").alias("text"))


def document_texts(blocks: DataFrame) -> DataFrame:
    """Per document its pages' texts under headings, with a blank line between."""
    part = F.struct("page", F.concat(F.lit("# 第 "), F.col("page").cast("string"), F.lit(" 頁\n"), "text").alias("t"))
    return page_texts(blocks).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), "\n\n").alias("text"))


def selections(blocks: DataFrame) -> DataFrame:
    return blocks.select("document_id", "id", "page", "bbox")


def highlights(blocks: DataFrame, viewport_width: float, viewport_height: float) -> DataFrame:
    """Rectangles in the viewport of blocks that have an area, and where a viewer scrolls to within the page."""
    w, h = F.lit(viewport_width), F.lit(viewport_height)
    return blocks.where("bbox.width > 0 and bbox.height > 0").select("document_id", "id", "page", (F.col("bbox.x") * w).alias("left"), (F.col("bbox.y") * h).alias("top"), (F.col("bbox.width") * w).alias("width"), (F.col("bbox.height") * h).alias("height"), F.greatest(F.lit(0.0), F.col("bbox.y") * h + 24 - 80).alias("scroll_top"))


def preview_documents(documents: DataFrame, blocks: DataFrame, detections: DataFrame, warnings: DataFrame) -> DataFrame:
    """One nested row per document: its blocks, detections and warnings in order."""
    own = F.struct(*(x for x in blocks.columns if x != "document_id"))
    nested = blocks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", F.struct(own.alias("b")).alias("v")))), lambda s: s["v"]["b"]).alias("blocks"))
    pages = detections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "layout_class", "parser_recommendation", "reasons", "has_extractable_text"))).alias("detections"))
    texts = warnings.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "warning"))), lambda s: s["warning"]).alias("warnings"))
    return documents.join(nested, "document_id", "left").join(pages, "document_id", "left").join(texts, "document_id", "left")
