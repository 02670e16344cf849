"""Page statistics and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.geometry import round_half_up
from pageloom.functions.text import COUNTS, census

MARGIN = 5.0


def item_measures(items: DataFrame, page_infos: DataFrame) -> DataFrame:
    """All pages with their items' measures; pages without items have one row of nulls. Items that have a census (as merged ones do) aren't counted again."""
    width, height = F.greatest(F.lit(0.0), F.col("right") - F.col("left")), F.greatest(F.lit(0.0), F.col("top") - F.col("bottom"))
    off = (F.col("left") < -MARGIN) | (F.col("bottom") < -MARGIN) | (F.col("right") > F.col("page_width") + MARGIN) | (F.col("top") > F.col("page_height") + MARGIN)
    rows = page_infos.join(items, ["document_id", "page"], "left")
    found = {x: F.col(f"census.{x}") for x in COUNTS} if "census" in items.columns else census(F.col("content"))
    counts = {k: F.when(F.col("type").isNotNull(), v).alias(k) for k, v in found.items()}
    return rows.select("document_id", "page", "page_width", "page_height", "seq", "type", "left", "bottom", "font_size", width.alias("width"), height.alias("height"), off.alias("off_page"), ((height > 0) & (height < 2)).alias("tiny"), *counts.values())


def page_stats(items: DataFrame, page_infos: DataFrame, lists: bool = True) -> DataFrame:
    """One row for each known page. Without lists it has, instead of those of edges and font sizes, what classify asks of them: repeated (see repeated_columns), which needs no order of the items."""
    add = lambda x: F.sum(x).alias(x)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    listed = lambda x, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", F.col(x).alias("v"))))), lambda s: s["v"]).alias(f"{x}s")
    there = F.col("type").isNotNull()
    sized = F.col("font_size") > 0
    page = ["document_id", "page"]
    sizes = [F.first(x).alias(x) for x in ("page_width", "page_height")]
    measures = {"text_item_count": there, "char_count": F.col("chars"), "cjk_char_count": F.col("cjk"), "whitespace_count": F.col("spaces"), "replacement_char_count": F.col("replaced"), "off_page_item_count": F.col("off_page"), "tiny_text_item_count": F.col("tiny"), "n_sized": sized}
    rows = item_measures(items, page_infos).withColumns({k: v.cast("long") for k, v in measures.items()} | {"sized": F.when(sized, F.col("font_size")), "covered": F.col("width") * F.col("height")})
    if lists:
        grouped = rows.groupBy(*page).agg(*sizes, *map(total, measures), add("sized"), add("covered"), listed("left", there), listed("bottom", there), listed("font_size", sized))
        grouped = grouped.withColumnsRenamed({"lefts": "x_coords", "bottoms": "y_coords"})
    else:
        # a row for each bucket first
        buckets = rows.groupBy(*page, F.when(there, _bucket(F.col("left"))).alias("bucket")).agg(*sizes, *map(total, measures), add("sized"), add("covered"))
        grouped = buckets.groupBy(*page).agg(*sizes, *map(total, measures), add("sized"), add("covered"), F.count(F.when(F.col("text_item_count") >= LEAST_REPEATED, 1)).cast("int").alias("repeated"))
    area = F.col("page_width") * F.col("page_height")
    return grouped.withColumns({
        "avg_font_size": F.try_divide(F.col("sized"), F.col("n_sized")),
        "bbox_coverage_ratio": F.when(area > 0, F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0.0)) / area)).otherwise(0.0),
        "whitespace_ratio": ratio(F.col("whitespace_count"), F.col("char_count") + F.col("whitespace_count")),
        "cjk_char_ratio": ratio(F.col("cjk_char_count"), F.col("char_count")),
        "replacement_char_ratio": ratio(F.col("replacement_char_count"), F.col("char_count")),
        "has_extractable_text": F.col("char_count") >= 10,
    }).drop("sized", "n_sized", "covered")


LEAST_REPEATED = 4


def _bucket(x: Column) -> Column:
    return round_half_up(x / 5)


def repeated_columns(x_coords: Column) -> Column:
    """How many 5-point buckets of left edges have four items or more."""
    buckets = F.transform(x_coords, _bucket)
    return F.size(F.filter(F.array_distinct(buckets), lambda b: F.size(F.filter(buckets, lambda c: c == b)) >= LEAST_REPEATED))


def needs_scan(chars: Column, extractable: Column) -> Column:
    return (chars < 20) | ~extractable


def classify(stats: DataFrame) -> DataFrame:
    """Flags, layout class, recommendation and reasons of each page."""
    c = F.col
    repeated = c("repeated") if "repeated" in stats.columns else repeated_columns(c("x_coords"))
    scanned = needs_scan(c("char_count"), c("has_extractable_text"))
    garbled = (c("whitespace_ratio") > 0.7) & (c("char_count") > 5)
    cid = (c("replacement_char_ratio") >= 0.3) & (c("char_count") >= 10)
    table = ~scanned & (c("text_item_count") >= 15) & (c("cjk_char_ratio") <= 0.3) & (c("char_count") <= 10 * c("text_item_count")) & (repeated >= 6)
    hidden = (c("off_page_item_count") > 0) | ((c("tiny_text_item_count") > 2) & (c("tiny_text_item_count") > c("text_item_count") * 0.1))
    rows = stats.withColumns({"suspected_scanned": scanned, "suspected_garbled_text": garbled, "suspected_cid_font_encoding": cid, "suspected_table_heavy": table, "suspected_hidden_or_off_page_text": hidden})
    suspicious = c("suspected_hidden_or_off_page_text") | c("suspected_garbled_text") | c("suspected_cid_font_encoding")
    rows = rows.withColumn("layout_class", F.when(suspicious, "suspicious").when(c("suspected_scanned"), "scanned_image").when(c("suspected_table_heavy"), "complex_layout").otherwise("native_text"))
    recommended = F.when(c("layout_class") == "suspicious", "opendataloader_safety").when(c("layout_class") == "scanned_image", "opendataloader_hybrid").otherwise("opendataloader_default")
    reason = F.when(c("layout_class") == "suspicious", "detected hidden/off-page text or garbled text").when(c("layout_class") == "scanned_image", "low extractable text count").when(c("layout_class") == "complex_layout", "table-heavy layout detected").otherwise("ODL-only parser path")
    share = F.concat(F.lit("CID font encoding issue: "), F.format_string("%.0f", c("replacement_char_ratio") * 100), F.lit("% replacement chars"))
    return rows.withColumn("parser_recommendation", recommended).withColumn("reasons", F.filter(F.array(reason, F.when(c("suspected_cid_font_encoding"), share)), lambda x: x.isNotNull()))
