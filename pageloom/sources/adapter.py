"""A deterministic adapter from the corpus tables to parser output.

The repository has no page files to parse, so each line of a document (each
word, for documents made dense) becomes an item with a page and a box; two
passes, blank contents, shifted boxes, off-page and tiny boxes, CJK and
replacement characters follow from the numbers of document and line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
RASTER_WIDTH, RASTER_HEIGHT, DPI = 1275, 1650, 150

_SPLIT = "split(CASE WHEN doc_id % 47 = 5 THEN replace(text, ' ', '\\n') ELSE text END, '\\n')"
_LINES = f"""
SELECT doc_id AS document_id, doc_id % 47 = 5 AS dense, posexplode({_SPLIT}) AS (seq, line) FROM {{documents}}
"""
_BOXES = """
SELECT document_id, seq, page, type, l, t - CASE WHEN document_id % 89 = 0 THEN 1.5D WHEN dense THEN 10D ELSE 60D END AS b,
       l + least(CAST(n AS DOUBLE) * 5, CASE WHEN dense THEN 50D ELSE 288D END) AS r, t,
       CASE WHEN document_id % 41 = 0 THEN regexp_replace(line, '[aeiou]', '\\uFFFD')
            WHEN document_id % 43 = 0 THEN translate(line, 'aeiounrst', '條文說明規定備註項')
            WHEN document_id % 53 = 7 THEN regexp_replace(line, '(.)', '$1   ') ELSE line END AS txt
FROM (SELECT *, CASE WHEN dense THEN 'paragraph' WHEN seq = 0 AND n <= 80 THEN 'heading' WHEN row_no = 7 AND n <= 120 THEN 'footer'
                     WHEN (document_id + seq) % 11 = 0 THEN 'table' WHEN (document_id + seq) % 13 = 0 THEN 'list' ELSE 'paragraph' END AS type,
             CASE WHEN dense THEN CAST(72 + 60 * (seq % 8) AS DOUBLE)
                  ELSE CAST(72 + 60 * ((document_id + seq) % 4) AS DOUBLE) - CASE WHEN document_id % 97 = 0 AND row_no = 0 THEN 100 ELSE 0 END END AS l,
             CAST(720 - 80 * row_no AS DOUBLE) AS t
      FROM (SELECT *, CASE WHEN dense THEN (seq % 40) DIV 8 ELSE seq % 8 END AS row_no,
                   CAST(CASE WHEN dense THEN seq DIV 40 ELSE seq DIV 8 END + 1 AS INT) AS page, length(line) AS n FROM ({lines})))
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = _LINES.format(documents="{documents}")
    return spark.sql(_BOXES.format(lines=lines), documents=documents)


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of both passes."""
    first_blank = ((F.col("document_id") * 31 + F.col("seq")) % 7 == 3) | (F.col("type") == "table")
    shift = F.when((F.col("document_id") + F.col("seq")) % 5 == 0, 3.0).otherwise(0.2)
    passes = F.array(
        F.struct(F.lit(1).alias("pass"), F.lit(0.0).alias("dx"), F.when(~first_blank, F.col("txt")).alias("content")),
        F.struct(F.lit(2).alias("pass"), shift.alias("dx"), F.when(F.col("type") != "heading", F.col("txt")).alias("content")),
    )
    rows = F.when(F.col("type") == "table", F.when(F.col("seq") % 2 == 0, "[]").otherwise("[1]"))
    return (
        _boxes(spark, sf_dir)
        .withColumn("p", F.explode(passes))
        .select("document_id", "p.pass", F.col("seq").cast("int").alias("seq"), "type", "page", (F.col("l") + F.col("p.dx")).alias("left"), F.col("b").alias("bottom"), (F.col("r") + F.col("p.dx")).alias("right"), F.col("t").alias("top"), "p.content", F.when(F.col("type") == "heading", 18.0).otherwise(11.0).alias("font_size"), rows.alias("rows_json"))
    )


def page_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 1 to one more than the last with an item."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    page = F.expr(f"CAST((size({_SPLIT}) - 1) DIV (CASE WHEN doc_id % 47 = 5 THEN 40 ELSE 8 END) + 1 AS INT)")
    last = documents.groupBy(F.col("doc_id").alias("document_id")).agg(F.max(page).alias("last"))
    return last.select("document_id", F.explode(F.sequence(F.lit(1), F.col("last") + 1)).alias("page"), F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"))


_OCR = """
SELECT document_id, page, slot AS line_no, attempt_no,
       CASE WHEN document_id % 12 = 0 AND slot = 0 THEN '人工智慧 草案' WHEN document_id % 6 = 0 AND slot IN (0, 2) THEN '條 文'
            WHEN document_id % 6 = 0 AND slot = 1 THEN '說明' WHEN document_id % 9 = 0 AND slot = 4 THEN concat('一、', line)
            WHEN document_id % 9 = 0 AND slot = 7 THEN concat('二:', line) WHEN document_id % 15 = 0 AND slot = 6 THEN concat('第三條 ', line)
            WHEN slot = 9 THEN concat('（二） 法律·規定 ', line) ELSE line END AS text,
       0.4D + ((document_id * 7 + seq * 3) % 60) / 100D + 0.05D * (attempt_no - 1) AS mean,
       x1, y1, x1 + least(5D * length(line), 540D) AS x2, y1 + 40 AS y2
FROM (SELECT *, CASE WHEN document_id % 12 = 0 AND slot = 0 THEN 500D WHEN document_id % 3 = 0 AND slot % 2 = 1 THEN 680D ELSE 60D END AS x1,
             100D + 60 * CASE WHEN document_id % 3 = 0 THEN slot DIV 2 ELSE slot END AS y1
      FROM (SELECT document_id, seq, line, seq % 14 AS slot, CAST(seq DIV 14 + 1 AS INT) AS page FROM (SELECT doc_id AS document_id, posexplode(split(text, '\\n')) AS (seq, line) FROM {documents})))
LATERAL VIEW explode(array(1, 2, 3, 4)) a AS attempt_no
"""


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines in pixels of four attempts per page."""
    return spark.sql(_OCR, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def ocr_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of the pages with lines: stages in their order; documents by number 61 fail."""
    pages = ocr_lines(spark, sf_dir).select("document_id", "page", "attempt_no").distinct()
    stage = F.when(F.col("attempt_no") == 4, "fallback_rec_ppocr_v4_doc").otherwise("primary_ocr")
    return pages.select("document_id", "page", "attempt_no", stage.alias("stage"), F.when(F.col("attempt_no") <= 2, DPI).otherwise(220).alias("dpi"), F.lit(RASTER_WIDTH).alias("width_px"), F.lit(RASTER_HEIGHT).alias("height_px"), F.lit("lib;det=d.onnx;rec=r.onnx").alias("model_label"), F.when(F.col("document_id") % 61 == 0, "render failed").alias("error"))


def page_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page with lines, as the driver of recognition takes it: instead of an image the lines that a recogniser finds at its first attempt."""
    first = ocr_lines(spark, sf_dir).where("attempt_no = 1")
    found = F.array_sort(F.collect_list(F.struct("line_no", "text", "mean", "x1", "y1", "x2", "y2")))
    return first.groupBy("document_id", "page").agg(found.alias("found"))


def open_recogniser():
    """A recogniser for page_rasters: each attempt is a little surer of the same lines; documents by number 61 fail."""
    from pageloom.operators.recognise import Line, Recognised, Step

    def recognise(step: Step, page: dict) -> Recognised:
        if page["document_id"] % 61 == 0:
            raise ValueError("render failed")
        lines = [Line(x["text"], x["mean"] + 0.05 * (step.attempt_no - 1), x["x1"], x["y1"], x["x2"], x["y2"]) for x in page["found"]]
        return Recognised(lines, RASTER_WIDTH, RASTER_HEIGHT, "lib;det=d.onnx;rec=r.onnx")

    return recognise
