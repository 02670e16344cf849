"""Operators on small tables made by hand."""

import pytest
from pyspark.sql import functions as F

from pageloom.operators import blocks, export, merge, ocr, quality, routing, stats, triggers
from pageloom.plans.ingest import ingest
from pageloom.plans.options import IngestOptions
from pageloom.sources import readers


def items(spark, rows):
    """rows: document, pass, seq, type, page, left, top, content, rows_json."""
    full = [(d, p, s, t, g, float(x), float(y) - 10, float(x) + 100, float(y), c, 11.0, r) for d, p, s, t, g, x, y, c, r in rows]
    return spark.createDataFrame(full, readers.ITEMS)


def infos(spark, *pages):
    return spark.createDataFrame([(d, p, 612.0, 792.0) for d, p in pages], "document_id bigint, page int, page_width double, page_height double")


def test_merge(spark):
    rows = items(spark, [
        (1, 1, 0, "paragraph", 1, 10, 700, None, None), (1, 1, 1, "paragraph", 1, 10, 600, "first text of the page", None),
        (1, 2, 0, "paragraph", 1, 10.2, 700, "earlier", None), (1, 2, 1, "paragraph", 1, 10.3, 700, "later wins", None),
        (1, 2, 2, "paragraph", 1, 50, 500, "only in the second pass", None), (1, 2, 3, "paragraph", 1, 60, 400, "first text of the page!", None),
        (1, 2, 4, "paragraph", 2, 60, 400, "page without a gap", None),
    ])
    merged = [(r.seq, r.content) for r in merge.merge_passes(rows).orderBy("seq").collect()]
    assert merged == [(0, "later wins"), (1, "first text of the page"), (2, "only in the second pass")]
    assert merge.filled_count(merge.merge_passes(rows)).first().n_filled == 2


def test_blocks_and_dedupe(spark):
    rows = items(spark, [(1, 1, 0, "Heading", 1, 10, 700, " Title ", None), (1, 1, 1, "footer", 1, 10, 20, "skipped", None), (1, 1, 2, "paragraph", 9, 10, 20, "unknown page", None), (1, 1, 3, "list", 1, 12, 700, "another text here", None)])
    native = blocks.native_blocks(merge.merge_passes(rows), infos(spark, (1, 1)))
    got = {r.text: r for r in native.collect()}
    assert set(got) == {"Title", "another text here"} and got["Title"].block_type == "heading" and len(got["Title"].source_hash) == 16
    kept = blocks.dedupe(native)
    assert [r.text for r in kept.collect()] == ["Title"]  # the boxes overlap by more than 0.85
    assert blocks.dedupe(kept).count() == 1


def page(**changes):
    base = dict(document_id=1, page=1, text_item_count=20, char_count=100, whitespace_ratio=0.1, cjk_char_ratio=0.0, replacement_char_ratio=0.0, off_page_item_count=0, tiny_text_item_count=0, has_extractable_text=True, x_coords=[0.0])
    return base | changes


@pytest.mark.parametrize(("changes", "want"), [
    (dict(char_count=19), "scanned_image"), (dict(char_count=20), "native_text"), (dict(whitespace_ratio=0.7), "native_text"), (dict(whitespace_ratio=0.71), "suspicious"),
    (dict(whitespace_ratio=0.9, char_count=5), "scanned_image"), (dict(replacement_char_ratio=0.3), "suspicious"), (dict(replacement_char_ratio=0.29), "native_text"), (dict(off_page_item_count=1), "suspicious"),
    (dict(tiny_text_item_count=2), "native_text"), (dict(tiny_text_item_count=3), "suspicious"), (dict(tiny_text_item_count=3, text_item_count=30), "native_text"),
    (dict(x_coords=[float(x) for x in range(0, 300, 50) for _ in range(4)]), "complex_layout"), (dict(x_coords=[float(x) for x in range(0, 300, 50) for _ in range(3)]), "native_text"), (dict(x_coords=[float(x) for x in range(0, 300, 50) for _ in range(4)], cjk_char_ratio=0.31), "native_text"),
    (dict(x_coords=[float(x) for x in range(0, 300, 50) for _ in range(4)], text_item_count=14), "native_text"),
])
def test_classes(spark, changes, want):
    schema = "document_id bigint, page int, text_item_count bigint, char_count bigint, whitespace_ratio double, cjk_char_ratio double, replacement_char_ratio double, off_page_item_count bigint, tiny_text_item_count bigint, has_extractable_text boolean, x_coords array<double>"
    assert stats.classify(spark.createDataFrame([tuple(page(**changes).values())], schema)).first().layout_class == want


def test_stats_of_pages_without_items(spark):
    got = {r.page: r for r in stats.page_stats(items(spark, [(1, 1, 0, "paragraph", 1, -6, 700, "ab c", None)]), infos(spark, (1, 1), (1, 2))).collect()}
    assert (got[1].char_count, got[1].whitespace_count, got[1].off_page_item_count, got[1].x_coords) == (3, 1, 1, [-6.0])
    assert (got[2].text_item_count, got[2].avg_font_size, got[2].whitespace_ratio, got[2].x_coords) == (0, None, 0.0, [])


@pytest.mark.parametrize("scan", [False, True])
@pytest.mark.parametrize("hole", [False, True])
@pytest.mark.parametrize("table", [False, True])
def test_triggers(spark, scan, hole, table):
    rows = [(1, 1, 0, "paragraph", 1, 10, 700, "x" if scan else "x" * 30, None)]
    rows += [(1, 1, 1, "paragraph", 1, 10, 600, " ", None)] * hole + [(1, 1, 2, "table", 1, 10, 500, None, "[1]")] * table
    merged = items(spark, rows)
    on = IngestOptions(enable_ocr_repair=True, repair_on_scan_or_low_text=True, repair_on_structural_hole=True)
    got = triggers.repair_triggers(stats.page_stats(merged, infos(spark, (1, 1))), merged, on).first()
    want = ["scan_or_low_text"] * scan + ["structural_hole"] * hole + ["table_layout"] * table
    assert (got.triggers if got else []) == want
    assert triggers.repair_triggers(stats.page_stats(merged, infos(spark, (1, 1))), merged, IngestOptions()).count() == 0


def test_page_cap_is_per_document(spark):
    pages = spark.createDataFrame([(d, p) for d in (1, 2) for p in (3, 1, 2)], "document_id bigint, page int")
    assert sorted(map(tuple, triggers.cap_pages(pages, 2).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert triggers.cap_pages(pages, None).count() == 6


def test_routing(spark):
    rows = [(1, 1, "a", False), (1, 2, "a", True), (1, 5, "opendataloader_default", False), (1, 6, "a", False)]
    pages = spark.createDataFrame(rows, "document_id bigint, page int, parser_recommendation string, suspected_hidden_or_off_page_text boolean").withColumn("suspected_garbled_text", F.lit(False))
    plan = routing.routing_plan(pages, force_ocr=True)
    assert [(r.pages, r.parser, r.reason) for r in plan.orderBy("group_no").collect()] == [([1, 2], "opendataloader_hybrid", "hint_plus_detection"), ([5], "opendataloader_default", "system_detection"), ([6], "opendataloader_hybrid", "hint_plus_detection")]
    assert routing.routing_warnings(pages, plan).first().warning.startswith("第 2 頁")


def test_attempts(spark):
    rows = [(1, 1, 1, 0.55, 1), (1, 1, 2, 0.9, 1), (2, 1, 1, 0.5, 1), (2, 1, 2, 0.3, 1), (3, 1, 1, 0.9, 0), (3, 1, 2, 0.6, 3)]
    summary = spark.createDataFrame(rows, "document_id bigint, page int, attempt_no int, mean_confidence double, paragraph_count bigint").withColumn("error", F.lit(None).cast("string"))
    assert {r.document_id: r.attempt_no for r in ocr.choose_attempt(summary).collect()} == {1: 1, 2: 2, 3: 2}
    got = spark.createDataFrame([(x,) for x in (0.2, 0.5, 0.993, float("nan"), None)], "m double").select(ocr.confidence(F.col("m"))).collect()
    assert [r[0] for r in got] == [0.5, 0.5, 0.99, 0.5, 0.5]


def test_quality(spark):
    pages = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True)], "document_id bigint, page int, has_extractable_text boolean")
    found = spark.createDataFrame([(1, 3, 0.5), (1, 4, 0.49)], "document_id bigint, page int, confidence double")
    r = quality.quality_report(found, pages).first()
    assert (r.requires_fallback, r.empty_pages, r.low_confidence_pages, len(r.warnings)) == (True, [1], [4], 2)


def test_export_and_store(spark, tmp_path):
    rows = items(spark, [(1, 1, 0, "paragraph", 1, 10, 600, "lower text", None), (1, 1, 1, "paragraph", 1, 10, 700, "upper text", None), (1, 1, 2, "paragraph", 2, 10, 700, "next page", None)])
    native = blocks.native_blocks(merge.merge_passes(rows), infos(spark, (1, 1), (1, 2)))
    assert export.document_texts(native).first().text == "# 第 1 頁\nupper text\nlower text\n\n# 第 2 頁\nnext page"
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "document_id bigint, text string")
    export.write_previews(spark, rows, path)
    export.write_previews(spark, rows.where("document_id = 1").withColumn("text", F.lit("c")), path)
    assert [r.text for r in export.read_previews(spark, path, 1).collect()] == ["c"]
    export.write_previews(spark, rows.where("document_id = 2"), path, deleted=True)
    assert [r.document_id for r in export.read_previews(spark, path).collect()] == [1] and export.read_previews(spark, path, 7).count() == 0


def test_page_infos(spark):
    good = "Pages:  2\nPage    1 size: 10 x 20.5 pts (A4)\nPage    2 size: 30 x 40 pts\n"
    part = "Pages:  2\nPage    1 size: 10 x 20 pts\nPage size: 7 x 8 pts\n"
    text = spark.createDataFrame([(1, good), (2, part)], "document_id bigint, output string")
    assert sorted(map(tuple, readers.parse_page_infos(text).collect())) == [(1, 1, 10.0, 20.5), (1, 2, 30.0, 40.0), (2, 1, 7.0, 8.0), (2, 2, 7.0, 8.0)]
    for bad in ("Page size: 7 x 8 pts", "Pages: 2\n"):
        with pytest.raises(Exception, match="no page"):
            readers.parse_page_infos(spark.createDataFrame([(1, bad)], "document_id bigint, output string")).collect()


def test_ingest(spark):
    rows = items(spark, [(1, 1, 0, "paragraph", 1, 10, 700, "x" * 5, None)])
    done = ingest(rows, infos(spark, (1, 1), (2, 1)), IngestOptions(enable_ocr_repair=True, repair_on_scan_or_low_text=True))
    assert done.blocks.count() == 1 and done.detections.count() == 2
    texts = [r.warning for r in done.warnings.orderBy("document_id", "ord").collect()]
    assert sum("eSearch-OCR" in x for x in texts) == 2 and sum("無輸出" in x for x in texts) == 1


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "b.pdf").write_bytes(b"y" * 30)
    got = {r.file_path[-5:]: r for r in readers.read_uploads(spark, str(tmp_path), limit=20).collect()}
    assert (bytes(got["a.pdf"].content), got["a.pdf"].error, got["a.pdf"].size) == (b"x" * 10, None, 10)
    assert (got["b.pdf"].content, got["b.pdf"].error, got["b.pdf"].size) == (None, "larger than 20 bytes", 30)


def test_merge_reads_its_items_once(spark, tmp_path):
    items(spark, [(1, 1, 0, "paragraph", 1, 10, 700, None, None), (1, 2, 0, "paragraph", 1, 10, 700, "text", None)]).write.parquet(str(tmp_path / "items"))
    plan = merge.merge_passes(spark.read.parquet(str(tmp_path / "items")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") <= 2


def test_folds_are_linear():
    import time

    from pageloom.functions.overlap import Boxes, keep_flags

    began = time.time()
    lines = [f"line {i * 7919 % 100003} of a long document" if i % 3 else f"w{i % 5000}" for i in range(100_000)]
    flags = keep_flags(lines, [i % 2 == 0 for i in range(100_000)])
    assert flags[0] and time.time() - began < 60
    boxes = Boxes(0.85)
    for i in range(20_000):
        box = ("n", (i % 100) / 100, (i // 100) / 200, 0.008, 0.004)
        assert not boxes.overlaps(*box)
        boxes.add(*box)
    assert boxes.overlaps("n", 0.5001, 0.25, 0.008, 0.004) and not boxes.overlaps("n", 0.502, 0.25, 0.008, 0.004) and time.time() - began < 90


def test_boxes_against_all_pairs():
    import random

    from pageloom.functions.overlap import Boxes

    r, kept, fast = random.Random(3), [], Boxes(0.85)
    for _ in range(600):
        box = (r.choice([0.1, 0.3]) + r.gauss(0, 0.01), 0.2 + r.gauss(0, 0.01), r.choice([0, 0.2, 0.21]) + r.random() / 50, 0.1 + r.random() / 100)
        want = any(Boxes._iou(k, *box) >= 0.85 for k in kept)
        assert fast.overlaps("n", *box) == want
        if not want:
            kept.append(box)
            fast.add("n", *box)
