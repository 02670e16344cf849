"""Items to blocks, and dedupe of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.geometry import normalized
from pageloom.functions.labels import block_type, is_skipped
from pageloom.functions.overlap import drop_overlapping_blocks, drop_overlapping_boxes, drop_overlapping_texts
from pageloom.functions.text import has_text, source_hash, trim

PARSER, VERSION, CONFIDENCE = "opendataloader-default", "1.10.1", 0.93


def block_id(parser: str) -> Column:
    """The same id for the same block in every run."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(parser), "document_id", "page", "seq"), 256), 1, 32)


def drop_overlapping(rows: DataFrame, given: Column) -> DataFrame:
    """Rows (document_id, page, seq, text) in order, without those whose text overlaps one kept before on the page; with their error, if any."""
    return drop_overlapping_texts(rows, ["document_id", "page"], ["seq"], F.col("text"), given)


def _items(merged: DataFrame, page_infos: DataFrame) -> DataFrame:
    """Items that have text, aren't skipped and lie on a known page."""
    return merged.where(has_text(F.col("content")) & ~is_skipped(F.col("type"))).join(page_infos, ["document_id", "page"]).withColumn("text", trim(F.col("content")))


def _blocks(items: DataFrame) -> DataFrame:
    box = normalized(F.col("left"), F.col("bottom"), F.col("right") - F.col("left"), F.col("top") - F.col("bottom"), F.col("page_width"), F.col("page_height"))
    return items.select("document_id", "page", "seq", block_id(PARSER).alias("id"), block_type(F.col("type")).alias("block_type"), "text", box.alias("bbox"), F.lit(PARSER).alias("parser"), F.lit(VERSION).alias("parser_version"), F.lit("native_text").alias("extraction_mode"), F.lit(CONFIDENCE).alias("confidence"), F.array().cast("array<string>").alias("warnings"), source_hash(F.col("page"), F.col("text")).alias("source_hash"), F.lit(f"OpenDataLoader {VERSION}").alias("model_label"), "error")


def candidates(merged: DataFrame, page_infos: DataFrame) -> DataFrame:
    """Blocks of items that have text, aren't skipped and lie on a known page, not yet compared with each other."""
    return _blocks(_items(merged, page_infos))


def native_blocks(merged: DataFrame, page_infos: DataFrame) -> DataFrame:
    """Blocks of items that have text, aren't skipped, lie on a known page and overlap no block before on their page."""
    return _blocks(drop_overlapping(_items(merged, page_infos), F.lit(False)))


def settle(native: DataFrame, repair: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """What native_blocks, merge_blocks (if there is repair) and dedupe (if there is a threshold) leave of candidates one after the other, in one fold.

    A fold over native blocks and then those of repair keeps what one of each would: native ones are all there before the first of repair. A row with an error (its document is rejected in the end) stays and is numbered, but what comes after isn't compared with it if it was to go.
    """
    page = ["document_id", "page"]
    if repair is None:
        return drop_overlapping_blocks(native, page, ["seq"], F.col("text"), F.lit(False), F.col("source_hash"), F.col("bbox"), threshold).drop("at")
    extra = [x for x in repair.columns if x not in native.columns]
    rows = native.withColumn("src", F.lit(0)).unionByName(repair.select(*native.columns, *extra).withColumn("src", F.lit(1)), allowMissingColumns=True)
    kept = drop_overlapping_blocks(rows, page, ["src", "seq"], F.col("text"), (F.col("src") == 1) | F.col("error").isNotNull(), F.col("source_hash"), F.col("bbox"), threshold)
    return kept.withColumn("seq", F.col("at").cast("int")).drop("src", "at")


THRESHOLD = 0.85


def dedupe(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """First of equal hashes on a page; of boxes that overlap by the threshold the one kept first. A block dropped for its box doesn't count as seen."""
    return drop_overlapping_boxes(blocks, ["document_id", "page"], ["seq"], F.col("source_hash"), F.col("bbox"), threshold)
