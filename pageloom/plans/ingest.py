"""The whole flow, over many documents at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators import blocks as B
from pageloom.operators import merge, ocr, quality, stats, triggers
from pageloom.operators.recognise import Recogniser, run_cascade, steps
from pageloom.plans.options import IngestOptions
from pageloom.sources.tables import dropped, parts, written


@dataclass(frozen=True)
class Ingested:
    blocks: DataFrame
    detections: DataFrame
    report: DataFrame
    warnings: DataFrame
    #: document_id, stage and error of documents that a step failed on; they aren't in the other tables
    rejects: DataFrame


def ingest(items: DataFrame, page_infos: DataFrame, options: IngestOptions = IngestOptions(), *, lines: DataFrame | None = None, attempts: DataFrame | None = None, rasters: DataFrame | None = None, open_recogniser: Callable[[], Recogniser] | None = None, convert: Callable[[str], str] | None = None, **driver) -> Ingested:  # noqa: B008
    """Items, page sizes and (for repair) recognised lines and attempts to blocks, detections, report and warnings.

    Instead of lines and attempts, rasters (rows of pages, see operators.recognise) and a recogniser can be given:
    then the pages that repair takes are recognised, as far as their attempts have to go. driver: options of run_cascade. convert: a script conversion of recognised text.

    A step that fails on a page or document leaves an error in its rows, which the later steps carry along; at the end
    documents with any are taken out of all results, and rejects says why.

    Merged items, page statistics, pages to repair, cleaned paragraphs, the warnings of single steps and final blocks are
    written on the way; the rest stays lazy. Merged items and paragraphs go when the blocks are there. Many items are
    folded in parts by document, so that the exchange of all texts never lies on the disks at once.
    """
    documents = page_infos.select("document_id").distinct()
    merged = written(merge.merge_passes(items))
    page_stats = written(stats.page_stats(merged, page_infos))
    native, repair, passing = B.candidates(merged, page_infos), None, [merged]
    noted = merge.parser_warnings(items, merged, documents).withColumn("ord", F.lit(0).cast("long"))
    if options.enable_ocr_repair:
        triggered = written(triggers.repair_triggers(page_stats, merged, options))
        if open_recogniser is not None and rasters is not None:
            due = rasters.join(triggers.cap_pages(triggered, options.max_pages), ["document_id", "page"], "left_semi")
            lines, attempts = run_cascade(due, open_recogniser, steps(options), **driver)
        if lines is None or attempts is None:
            message = f"已啟用 OCR repair，但找不到 {options.profile} profile 的模型或缺少檔案（det/rec/dict）。略過 eSearch-OCR。"
            noted = noted.unionByName(triggered.select("document_id", F.lit(message).alias("warning"), F.lit(1).cast("long").alias("ord")).distinct())
        else:
            taken = triggers.cap_pages(triggered, options.max_pages)
            noted = noted.unionByName(triggers.cap_warnings(triggered, options).withColumn("ord", F.lit(1).cast("long")))
            noted = noted.unionByName(ocr.failed_pages(attempts, taken).withColumn("ord", F.lit(2).cast("long")))

            def stored(paragraphs: DataFrame) -> DataFrame:
                passing.append(written(paragraphs))
                return passing[-1]

            repair = ocr.ocr_blocks(lines, attempts, page_infos, taken, convert=convert, through=stored)
    kept = written(*(B.settle(native.where(part), None if repair is None else repair.where(part), B.THRESHOLD) for part in parts(merged)))
    failed, noted = written(_errors(merged, "merge").unionByName(_errors(kept, "blocks"))), written(noted)
    dropped(*passing)
    detections = stats.classify(page_stats)
    if not failed.isEmpty():
        kept, detections, noted = (_without(x, failed) for x in (kept, detections, noted))
    kept = kept.drop("error")
    report = quality.quality_report(kept, detections)
    of_pages = report.select("document_id", F.posexplode("warnings").alias("ord", "warning")).select("document_id", "warning", (F.col("ord") + 10).cast("long").alias("ord"))
    of_blocks = kept.select("document_id", F.explode("warnings").alias("warning"), (F.lit(1 << 40) + F.col("page") * (1 << 20) + F.col("seq")).cast("long").alias("ord"))
    return Ingested(kept, detections, report, quality.distinct_warnings(noted.unionByName(of_pages).unionByName(of_blocks)), failed)


def _errors(rows: DataFrame, stage: str) -> DataFrame:
    return rows.where("error is not null").select("document_id", F.lit(stage).alias("stage"), "error")


def _without(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """The rows of documents that no step failed on."""
    bad = failed.select(F.col("document_id").alias("__bad")).distinct()
    return rows.join(bad, F.col("document_id").eqNullSafe(F.col("__bad")), "left_anti")
