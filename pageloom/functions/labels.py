"""Column functions for names and labels. The words are fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED_TYPES = ("footer", "header", "image", "picture")
BLOCK_TYPES = {"heading": "heading", "paragraph": "paragraph", "table": "table", "list": "list", "image": "image_ocr", "picture": "image_ocr"}
LAYOUT_LABELS = {"native_text": "原生文字", "scanned_image": "掃描影像", "complex_layout": "複雜排版", "suspicious": "可疑內容", "mixed": "混合"}
LAYOUT_TAGS = {"suspicious": "danger", "scanned_image": "warning", "complex_layout": "warning", "native_text": "success"}
TYPE_LABELS = {"heading": "標題", "paragraph": "段落", "table": "表格", "list": "清單", "footer": "頁尾", "header": "頁首", "image_ocr": "OCR", "unknown": "未知"}


def lookup(x: Column, values: dict[str, str], other: Column) -> Column:
    found = F.lit(None).cast("string")
    for key, value in values.items():
        found = F.when(x == key, F.lit(value)).otherwise(found)
    return F.coalesce(found, other)


def block_type(item_type: Column) -> Column:
    return lookup(F.lower(item_type), BLOCK_TYPES, F.lit("unknown"))


def is_skipped(item_type: Column) -> Column:
    return F.coalesce(F.lower(item_type).isin(*SKIPPED_TYPES), F.lit(False))


def layout_label(layout_class: Column) -> Column:
    return lookup(layout_class, LAYOUT_LABELS, layout_class)


def layout_tag(layout_class: Column) -> Column:
    return lookup(layout_class, LAYOUT_TAGS, F.lit("info"))


def type_label(kind: Column) -> Column:
    return lookup(kind, TYPE_LABELS, kind)


def page_list(pages: Column) -> Column:
    """Up to five pages in full, more as first-last."""
    return F.when(F.size(pages) <= 5, F.array_join(pages.cast("array<string>"), "、")).otherwise(F.concat(pages[0].cast("string"), F.lit("-"), F.element_at(pages, -1).cast("string")))


def file_size(n: Column) -> Column:
    tenths = lambda per: F.format_string("%.1f", n / per)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(tenths(1024.0), F.lit(" KB"))).otherwise(F.concat(tenths(1048576.0), F.lit(" MB")))


def backend_label(parsers: Column) -> Column:
    """What parsed a document, from the set of its blocks' parsers."""
    native, repair = F.array_contains(parsers, "opendataloader-default"), F.array_contains(parsers, "esearch-ocr-repair")
    return F.when(native & repair, "OpenDataLoader + eSearch-OCR").when(repair, "eSearch-OCR").when(native | F.exists(parsers, lambda p: p.startswith("opendataloader")), "OpenDataLoader")


def text_file_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(F.coalesce(name, F.lit("pdf-parse-result")), r"(?i)\.pdf$", ""), F.lit(".txt"))
