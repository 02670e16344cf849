"""Boundaries of the column functions."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions import labels as L
from pageloom.functions import text as X
from pageloom.functions.overlap import Kept, keep_flags, overlap_ratio
from pageloom.operators.cleanup import AFTER_TRIM, BEFORE_TRIM, clean_text
from pageloom.plans.options import IngestOptions, parse_options


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_rounding_and_keys(spark):
    assert one(spark, *(G.round_half_up(F.lit(x)) for x in (-2.5, -0.5, 0.5, 2.5, 2.49))) == (-2, 0, 1, 3, 2)
    assert one(spark, G.block_key(F.lit(3), F.lit(-0.5), F.lit(1.5), F.lit(2.4), F.lit(9.0))) == ("3_0_2_2_9",)


def test_boxes(spark):
    box = one(spark, G.normalized(*(F.lit(float(x)) for x in (-10, 700, 700, 50, 600, 800))))[0]
    assert (box.x, box.width) == (0.0, 1.0) and box.y == pytest.approx(50 / 800) and box.height == pytest.approx(50 / 800)
    assert one(spark, G.normalized(*(F.lit(float(x)) for x in (1, 1, 1, 1, 0, 0))))[0].x is not None
    whole = F.struct(*(F.lit(v).alias(k) for k, v in (("x", 0.0), ("y", 0.0), ("width", 1.0), ("height", 1.0))), F.lit("normalized").alias("coordinate_system"))
    other = whole.withField("coordinate_system", F.lit("points"))
    beside = whole.withField("x", F.lit(1.0))
    assert one(spark, G.iou(whole, whole), G.iou(whole, other), G.iou(whole, beside), G.iou(whole, whole.withField("width", F.lit(0.0)))) == (1.0, 0.0, 0.0, 0.0)


def test_white_space_and_census(spark):
    text = F.lit("  　﻿A\tb\n條�")
    assert one(spark, X.collapse_ws(text), X.trim(F.lit("　x y﻿"))) == ("ab條�", "x y")
    assert one(spark, *X.census(text).values()) == (4, 6, 1, 1)
    assert one(spark, *X.census(F.lit(None).cast("string")).values()) == (0, 0, 0, 0)
    assert one(spark, X.has_text(F.lit(None).cast("string")), X.has_text(F.lit("　"))) == (False, False)


def test_overlap():
    assert keep_flags(["abcdefghijkl", "abcdefghzzzz", "abcdefghijzz", "zzzz", "", "q"], [True, False, False, False, False, False]) == [True, True, False, False, False, True]
    # a dropped text drops no other: b overlaps a, c overlaps b but not a
    a, b, c = "abcdefghijklmnop", "ijklmnopqrstuvwx"[:12] , "mnopqrstuvwx"
    assert keep_flags([a, "efghijklmnopqrst", "mnopqrstuvwxyz01"], [False] * 3) == [True, False, True]
    kept = Kept()
    assert not kept.overlaps("")
    kept.add("abcdefghi")
    assert kept.overlaps("") and kept.overlaps("cde") and not kept.overlaps("xyz")


def test_overlap_ratio(spark):
    r = one(spark, overlap_ratio(F.lit("abcdefghi"), F.lit("abcdefgh")), overlap_ratio(F.lit("abcdefg"), F.lit("xabcdefgx")), overlap_ratio(F.lit("abc"), F.lit("x")))
    assert r == (0.5, 1.0, 0.0)


def test_labels(spark):
    assert one(spark, L.block_type(F.lit("Picture")), L.block_type(F.lit("caption")), L.layout_tag(F.lit("mixed")), L.type_label(F.lit("zzz"))) == ("image_ocr", "unknown", "info", "zzz")
    assert one(spark, L.page_list(F.lit([1, 2, 3, 4, 5])), L.page_list(F.lit([1, 2, 3, 4, 5, 7]))) == ("1、2、3、4、5", "1-7")
    assert one(spark, L.file_size(F.lit(1023)), L.file_size(F.lit(1536)), L.file_size(F.lit(3 * 1048576))) == ("1023 B", "1.5 KB", "3.0 MB")
    assert one(spark, L.text_file_name(F.lit("a.PDF")), L.text_file_name(F.lit(None).cast("string"))) == ("a.txt", "pdf-parse-result.txt")


def test_cleanup_trail():
    text, fixes = clean_text("中 文 字 国家AI suchas ，x", BEFORE_TRIM, AFTER_TRIM)
    assert all(a["after"] == b["before"] for a, b in zip(fixes, fixes[1:], strict=False))
    assert "國家 AI such as，x" in text and text.startswith("中文 字")
    assert clean_text("plain", BEFORE_TRIM, AFTER_TRIM) == ("plain", [])
    assert clean_text("收国國家帶展", BEFORE_TRIM, AFTER_TRIM)[0] == "攸關國家發展"  # an earlier rule changes what a later one sees


def test_options():
    assert parse_options('{"enableOcrRepair": true, "maxOcrPages": 0, "other": 1}') == IngestOptions(enable_ocr_repair=True, max_ocr_pages=0)
    assert parse_options("{broken").max_pages is None and parse_options(None) == IngestOptions()
    assert IngestOptions(ocr_repair_profile="dev").max_pages == 2 and IngestOptions(max_ocr_pages=-1).max_pages is None
    with pytest.raises(ValueError):
        IngestOptions(max_ocr_pages="abc")
