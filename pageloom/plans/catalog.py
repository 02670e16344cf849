"""All queries over the corpus tables; oracle.py has the DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions import labels as L
from pageloom.functions import overlap
from pageloom.functions import text as X
from pageloom.functions.phrases import Phrases
from pageloom.operators import blocks as B
from pageloom.operators import cleanup, export, layout, merge, ocr, quality, recognise, routing, stats, triggers
from pageloom.plans.ingest import ingest
from pageloom.plans.options import IngestOptions
from pageloom.plans.oracle import PHRASES
from pageloom.plans.oracle import SQL as SQL
from pageloom.sources import adapter, readers
from pageloom.sources.tables import written

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
REPAIR = IngestOptions(enable_ocr_repair=True, repair_on_scan_or_low_text=True, repair_on_structural_hole=True)


def query(f: Callable[[Flow], DataFrame] | None = None, *, several: bool = False) -> Callable:
    """Register a query over the tables in a folder. several: more than one of its steps reads merged items."""
    if f is None:
        return lambda f: query(f, several=several)

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Flow(spark, sf_dir, several))

    QUERIES[f.__name__] = run
    return run


def r6(x, name: str):
    return F.round(c(x) if isinstance(x, str) else x, 6).alias(name)


class Flow:
    """What the queries over one table set share; each table is planned once, and merged items are written if several steps read them. A step that alone reads them takes only the columns that it needs through the merge."""

    def __init__(self, s: SparkSession, d: str, several: bool = True):
        self.s, self.d, self.several = s, d, several

    items = cached_property(lambda f: adapter.doc_items(f.s, f.d))
    infos = cached_property(lambda f: adapter.page_infos(f.s, f.d))
    merged = cached_property(lambda f: written(merge.merge_passes(f.items)) if f.several else merge.merge_passes(f.items))
    stats = cached_property(lambda f: stats.page_stats(f.merged, f.infos))
    detections = cached_property(lambda f: stats.classify(stats.page_stats(f.merged, f.infos, lists=False)))
    native = cached_property(lambda f: B.native_blocks(f.merged, f.infos))
    triggered = cached_property(lambda f: triggers.repair_triggers(f.stats, f.merged, REPAIR))
    lines = cached_property(lambda f: adapter.ocr_lines(f.s, f.d))
    attempts = cached_property(lambda f: adapter.ocr_attempts(f.s, f.d))
    summary = cached_property(lambda f: ocr.attempt_summary(f.attempts, f.lines))
    ocr_blocks = cached_property(lambda f: ocr.ocr_blocks(f.lines, f.attempts, f.infos, written(f.triggered)))
    repaired = cached_property(lambda f: B.settle(B.candidates(f.merged, f.infos), f.ocr_blocks))

    chosen_lines = cached_property(lambda f: ocr.chosen_lines(f.lines, f.attempts))


def _candidate_blocks(f):
    """Blocks of both passes as they are, in the order of passes."""
    rows = f.items.where(X.has_text(c("content")) & ~L.is_skipped(c("type")))
    box = G.normalized(c("left"), c("bottom"), c("right") - c("left"), c("top") - c("bottom"), F.lit(adapter.PAGE_WIDTH), F.lit(adapter.PAGE_HEIGHT))
    order = Window.partitionBy("document_id", "page").orderBy("pass", "seq")
    return rows.select("document_id", "page", (F.row_number().over(order) - 1).alias("seq"), box.alias("bbox"), X.source_hash(c("page"), X.trim(c("content"))).alias("source_hash"))


@query
def block_key(f):
    return merge.keyed(f.items).select("document_id", "pass", "seq", "key")


@query
def source_hash(f):
    return f.items.where(X.has_text(c("content"))).select("document_id", "pass", "seq", X.source_hash(c("page"), X.trim(c("content"))).alias("source_hash"))


@query
def type_map(f):
    return f.items.groupBy("type", L.block_type(c("type")).alias("block_type")).agg(F.count("*").alias("n"))


@query
def bbox_normalize(f):
    box = G.normalized(c("left"), c("bottom"), c("right") - c("left"), c("top") - c("bottom"), F.lit(adapter.PAGE_WIDTH), F.lit(adapter.PAGE_HEIGHT))
    return f.items.withColumn("b", box).select("document_id", "pass", "seq", *(r6(f"b.{x}", x) for x in ("x", "y", "width", "height")))


@query
def bbox_if_needed(f):
    """Boxes of which every other one is normalised already."""
    points = F.struct(c("left").alias("x"), c("bottom").alias("y"), (c("right") - c("left")).alias("width"), (c("top") - c("bottom")).alias("height"), F.lit("points").alias("coordinate_system"))
    done = G.normalized(*(points[x] for x in ("x", "y", "width", "height")), F.lit(adapter.PAGE_WIDTH), F.lit(adapter.PAGE_HEIGHT))
    box = G.normalized_if_needed(F.when(c("seq") % 2 == 0, done).otherwise(points), F.lit(adapter.PAGE_WIDTH), F.lit(adapter.PAGE_HEIGHT))
    return f.items.withColumn("b", box).select("document_id", "pass", "seq", *(r6(f"b.{x}", x) for x in ("x", "y", "width", "height")), "b.coordinate_system")


@query
def selection(f):
    return export.selections(f.native).select("document_id", "id", "page", *(r6(f"bbox.{x}", x) for x in ("x", "y", "width", "height")))


@query
def quad_bbox(f):
    box = G.quad_normalized(c("x1"), c("y1"), c("x2"), c("y2"), F.lit(adapter.RASTER_WIDTH), F.lit(adapter.RASTER_HEIGHT), F.lit(adapter.PAGE_WIDTH), F.lit(adapter.PAGE_HEIGHT))
    return f.lines.where("attempt_no = 1").withColumn("b", box).select("document_id", "page", "line_no", *(r6(f"b.{x}", x) for x in ("x", "y", "width", "height")))


@query
def collapse_ws(f):
    return f.items.where("content is not null").select("document_id", "pass", "seq", X.collapse_ws(c("content")).alias("collapsed"))


@query
def char_census(f):
    return f.items.select("document_id", "pass", "seq", *(v.alias(k) for k, v in X.census(c("content")).items()))


@query
def overlap_ratio(f):
    """Each line against the one before it."""
    lines = adapter._boxes(f.s, f.d).select("document_id", "seq", X.collapse_ws(c("txt")).alias("x"))
    before = lines.select("document_id", (c("seq") + 1).alias("seq"), c("x").alias("y"))
    return lines.join(before, ["document_id", "seq"]).select("document_id", "seq", r6(overlap.overlap_ratio(c("x"), c("y")), "ratio"))


@query
def iou_pairs(f):
    blocks = _candidate_blocks(f)
    after = blocks.select("document_id", "page", (c("seq") - 1).alias("seq"), c("bbox").alias("other"))
    return blocks.join(after, ["document_id", "page", "seq"]).select("document_id", "seq", r6(G.iou(c("bbox"), c("other")), "iou"))


@query
def pass_fill(f):
    return merge.fill_blanks(f.items).select("document_id", "seq", "filled", "type", r6("left", "left"), "content")


@query
def pass_extras(f):
    return merge.extras(f.items).select("document_id", "seq", "page", r6("left", "left"), "content")


@query
def dual_pass_merge(f):
    return f.merged.select("document_id", "seq", "page", "type", r6("left", "left"), "top", "content")


@query
def filled_count(f):
    return merge.filled_count(f.merged)


@query
def page_stats(f):
    return f.stats.select("document_id", "page", "text_item_count", "char_count", "cjk_char_count", "whitespace_count", "replacement_char_count", "off_page_item_count", "tiny_text_item_count", *(r6(x, x) for x in ("avg_font_size", "bbox_coverage_ratio", "whitespace_ratio", "cjk_char_ratio", "replacement_char_ratio")), "has_extractable_text")


@query
def repeated_columns(f):
    return f.stats.select("document_id", "page", stats.repeated_columns(c("x_coords")).alias("repeated"))


@query
def classify_pages(f):
    return f.detections.select("document_id", "page", c("suspected_scanned").alias("scanned"), c("suspected_garbled_text").alias("garbled"), c("suspected_cid_font_encoding").alias("cid"), c("suspected_table_heavy").alias("table_heavy"), c("suspected_hidden_or_off_page_text").alias("hidden"), "layout_class", "parser_recommendation", F.array_join("reasons", "|").alias("reasons"))


@query
def layout_summary(f):
    return f.detections.groupBy("layout_class").agg(F.countDistinct("document_id").alias("n_documents"), F.count("*").alias("n_pages"))


@query
def layout_sentence(f):
    return routing.layout_sentence(f.detections)


@query
def page_labels(f):
    return f.detections.select("document_id", "page", L.layout_label(c("layout_class")).alias("label"), L.layout_tag(c("layout_class")).alias("tag"))


@query
def routing_plan(f):
    return routing.routing_plan(f.detections, force_ocr=True).select("document_id", "group_no", F.array_join(c("pages").cast("array<string>"), ",").alias("pages"), "parser", "reason")


@query
def routing_warnings(f):
    detections = written(f.detections)
    return routing.routing_warnings(detections, routing.routing_plan(detections), force_native_text=True, force_ocr=True)


@query
def native_blocks(f):
    return f.native.select("document_id", "page", "seq", "block_type", "text", *(r6(f"bbox.{x}", x) for x in ("x", "y", "width", "height")), "source_hash")


@query
def block_types(f):
    return f.native.groupBy("block_type", L.type_label(c("block_type")).alias("label")).agg(F.count("*").alias("n"))


@query
def dedupe_blocks(f):
    return B.dedupe(_candidate_blocks(f)).select("document_id", "page", "seq")


@query
def structural_holes(f):
    return triggers.structural_holes(f.merged)


@query(several=True)
def repair_triggers(f):
    return f.triggered.select("document_id", "page", F.array_join("triggers", ",").alias("triggers"))


@query(several=True)
def repair_page_cap(f):
    """The cap of the dev profile: two pages a document."""
    return triggers.cap_pages(f.triggered, 2).select("document_id", "page")


@query(several=True)
def cap_warnings(f):
    return triggers.cap_warnings(f.triggered, IngestOptions(ocr_repair_profile="dev"))


@query
def ocr_attempt_choice(f):
    summary = f.summary
    return ocr.choose_attempt(summary).drop("error").join(summary, ["document_id", "page", "attempt_no"]).select("document_id", "page", "attempt_no", r6("mean_confidence", "mean_confidence"), "paragraph_count")


@query
def ocr_cascade(f):
    """Recognition in steps of every page with lines: the attempts made, the result of the last one, and errors."""
    lines, attempts = recognise.run_cascade(adapter.page_rasters(f.s, f.d), adapter.open_recogniser, recognise.steps(REPAIR))
    summary = ocr.attempt_summary(attempts, lines)
    last = F.max_by(F.struct("attempt_no", "mean_confidence", "paragraph_count", "error"), "attempt_no")
    return summary.groupBy("document_id", "page").agg(F.count("*").alias("n_attempts"), last.alias("last")).select("document_id", "page", "n_attempts", "last.attempt_no", r6("last.mean_confidence", "mean_confidence"), "last.paragraph_count", F.coalesce("last.error", F.lit("")).alias("error"))


@query
def ocr_attempt_log(f):
    summary = f.summary
    return ocr.attempt_log(summary, ocr.choose_attempt(summary)).select("document_id", "page", F.array_join("fallback_reasons", ",").alias("log"))


@query(several=True)
def ocr_blocks(f):
    return f.ocr_blocks.select("document_id", "page", "seq", "text", *(r6(f"bbox.{x}", x) for x in ("x", "y", "width", "height")), r6("confidence", "confidence"), "source_hash", F.array_join("triggers", ",").alias("triggers"), "strategy", "role")


@query(several=True)
def ocr_failures(f):
    return ocr.failed_pages(f.attempts, f.triggered)


@query(several=True)
def ocr_merge(f):
    return f.repaired.select("document_id", "page", "seq", "parser", "text")


@query
def layout_strategy(f):
    return layout.page_strategy(f.chosen_lines)


@query
def column_split(f):
    """Where columns are told apart on each page, and how many lines then lie on either side."""
    rows = layout.with_gutter(f.chosen_lines)
    left = layout.center_x() < c("gutter")
    return rows.groupBy("document_id", "page").agg(r6(F.first("gutter"), "gutter"), F.count(F.when(left, 1)).alias("n_left"), F.count(F.when(~left, 1)).alias("n_right"))


@query
def layout_headers(f):
    return layout.generic_headers(f.chosen_lines)


@query
def paragraph_merge(f):
    return layout.reconstruct(f.chosen_lines).select("document_id", "page", "seq", "text", r6("mean", "mean"), "x1", "y1", "x2", "y2", "role")


@query
def layout_order(f):
    rows = layout.reconstruct(f.chosen_lines).groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("r"))
    return rows.select("document_id", "page", F.array_join(c("r.role"), ",").alias("roles"))


@query
def text_cleanup(f):
    return layout.reconstruct(f.chosen_lines).select("document_id", "page", "seq", cleanup.cleaned(c("text"))["text"].alias("text"))


@query
def script_conversion(f):
    """Paragraphs after conversion by made phrases, and after the cleanup that follows it. Some phrases begin alike, some lie in others, and what one stage writes is read by the next and by the cleanup rules."""
    phrases = Phrases.read(f.s.createDataFrame(PHRASES, "stage int, phrase string, replacement string"))
    rows = layout.reconstruct(f.chosen_lines).select("document_id", "page", "seq", cleanup.cleaned(c("text"), convert=phrases).alias("clean"))
    first = F.get("clean.fixes", F.lit(0))
    converted = F.when(first["type"] == "opencc", first["after"])
    return rows.select("document_id", "page", "seq", F.coalesce(converted, F.lit("")).alias("converted"), "clean.text", F.size(F.filter("clean.fixes", lambda x: x["type"] == "ocr_confusion")).alias("n_confusions"))


@query
def cleanup_trail(f):
    return layout.reconstruct(f.chosen_lines).select("document_id", "page", "seq", cleanup.cleaned(c("text"))["fixes"].alias("fixes")).select("document_id", "page", "seq", F.size("fixes").alias("n_fixes"), F.array_join(F.transform("fixes", lambda x: F.concat(x["type"], F.lit(":"), x["after"])), "|").alias("trail"))


@query(several=True)
def page_quality(f):
    return quality.page_quality(f.native, f.detections).withColumn("avg_confidence", F.round("avg_confidence", 6)).withColumn("is_low", F.coalesce("is_low", F.lit(False)))


@query(several=True)
def quality_report(f):
    joined = lambda x, by: F.array_join(c(x).cast("array<string>"), by).alias(x)
    return quality.quality_report(f.native, f.detections).select("document_id", "requires_fallback", joined("low_confidence_pages", ","), joined("empty_pages", ","), joined("warnings", "|"))


@query
def warnings_distinct(f):
    """Item texts as if they were warnings: long lists with many repeats."""
    rows = f.items.where("content is not null").select("document_id", c("content").alias("warning"), (c("pass") * 1000000 + c("seq")).cast("long").alias("ord"))
    return quality.distinct_warnings(rows)


@query
def export_page_text(f):
    return export.page_texts(f.native)


@query
def export_document_text(f):
    return export.document_texts(f.native)


@query
def highlights(f):
    shown = export.highlights(f.native.withColumn("id", c("seq")), 800.0, 1000.0)
    return shown.select("document_id", "page", c("id").alias("seq"), r6("left", "left"), r6("top", "top"), r6("scroll_top", "scroll_top"))


@query(several=True)
def backend_label(f):
    return f.repaired.groupBy("document_id").agg(F.collect_set("parser").alias("p")).select("document_id", L.backend_label(c("p")).alias("label"))


@query
def file_labels(f):
    documents = f.s.read.parquet(f"{f.d}/documents.parquet").where("text is not null")
    return documents.select(c("doc_id").alias("document_id"), L.file_size(F.octet_length("text")).alias("size"), L.text_file_name(F.concat(F.lit("file-"), c("doc_id").cast("string"), F.lit(".PDF"))).alias("file_name"))


@query
def page_infos_text(f):
    """Page sizes from page-information text: own sizes for even documents, a default size for odd ones."""
    line = F.concat(F.lit("Page "), c("page").cast("string"), F.lit(" size: "), (c("page") + 600).cast("string"), F.lit(" x 842 pts (A4)"))
    own = f.infos.groupBy("document_id").agg(F.max("page").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    text = F.concat(F.lit("Pages:  "), c("n").cast("string"), F.lit("\n"), F.when(c("document_id") % 2 == 0, c("lines")).otherwise("Page size: 595.5 x 842 pts"))
    return readers.parse_page_infos(own.select("document_id", text.alias("output")))


@query
def parser_json(f):
    """Pass 1 written as parser JSON, one text a document, and read again."""
    kid = F.struct("type", c("seq").cast("long").alias("id"), c("page").alias("page number"), F.array("left", "bottom", "right", "top").alias("bounding box"), "content", c("font_size").alias("font size"), F.when(c("rows_json") == "[1]", F.array(F.lit(1))).when(c("rows_json") == "[]", F.array().cast("array<int>")).alias("rows"))
    documents = f.items.where("pass = 1").groupBy("document_id", "pass").agg(F.array_sort(F.collect_list(F.struct("seq", kid.alias("k")))).alias("ks"))
    text = F.to_json(F.struct(c("ks.k").alias("kids")))
    return readers.parse_items(documents.select("document_id", "pass", text.alias("json"))).select("document_id", "pass", "seq", "type", "page", "left", "top", "content", "rows_json")


@query
def html_items(f):
    return readers.html_items(f.s.read.parquet(f"{f.d}/pages.parquet")).select("document_id", "seq", "type", "content")


@query(several=True)
def preview_document(f):
    """The nested document of native blocks, its parts as text: blocks with their type and source hash, pages with class and recommendation, warnings."""
    detections, blocks = f.detections, f.native
    documents = f.infos.select("document_id").distinct()
    none = merge.parser_warnings(f.items, f.merged, documents).withColumn("ord", F.lit(0))
    nested = export.preview_documents(documents, blocks, detections, none)
    listed = lambda of, *names: F.coalesce(F.array_join(F.transform(of, lambda x: F.concat_ws(":", *(x[n].cast("string") for n in names))), "|"), F.lit("")).alias(of)
    return nested.select("document_id", F.coalesce(F.size("blocks"), F.lit(0)).cast("long").alias("n_blocks"), F.coalesce(F.array_join(c("blocks.text"), "|"), F.lit("")).alias("texts"), F.size("detections").cast("long").alias("n_pages"), listed("blocks", "block_type", "page", "source_hash", "parser", "extraction_mode"), listed("detections", "page", "layout_class", "parser_recommendation"), F.coalesce(F.array_join("warnings", "|"), F.lit("")).alias("warnings"))


@query
def ingest_documents(f):
    """The whole flow with repair: the blocks that are left per document, how many of them repair gave, and the warnings in their order."""
    done = ingest(f.items, f.infos, REPAIR, lines=f.lines, attempts=f.attempts)
    joined = lambda *keys: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys))), lambda x: x[keys[-1]]), "|")
    blocks = done.blocks.groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.count(F.when(c("parser") == ocr.PARSER, 1)).alias("n_repaired"), joined("page", "seq", "text").alias("texts"))
    warned = done.warnings.groupBy("document_id").agg(joined("ord", "warning").alias("warnings"))
    return f.infos.select("document_id").distinct().join(blocks, "document_id", "left").join(warned, "document_id", "left").na.fill(0).na.fill("")


@query
def ingest_without_models(f):
    """The flow where repair is on but has no models, over all documents and, for each, a twin of one page without any item."""
    twins = f.infos.select((-1 - c("document_id")).alias("document_id"), F.lit(1).alias("page"), "page_width", "page_height").distinct()
    infos = f.infos.unionByName(twins)
    done = ingest(f.items, infos, REPAIR)
    blocks = done.blocks.groupBy("document_id").agg(F.count("*").alias("n_blocks"))
    warned = done.warnings.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "warning"))), lambda x: x["warning"]), "|").alias("warnings"))
    return infos.select("document_id").distinct().join(blocks, "document_id", "left").join(warned, "document_id", "left").na.fill(0).na.fill("")
