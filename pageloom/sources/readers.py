"""Sources of parser output: uploads, parser JSON, page-information text, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "document_id bigint, pass int, seq int, type string, page int, left double, bottom double, right double, top double, content string, font_size double, rows_json string"
UPLOAD_LIMIT = 50 * 1024 * 1024
#: Lines of page-information text, for the number of pages, the size of one, and that of all.
PAGE_COUNT = r"(?m)^Pages:\s+(\d+)$"
OWN_SIZE = r"(?m)^Page\s+(\d+)\s+size:\s+([0-9.]+)\s+x\s+([0-9.]+)\s+pts\b"
ONE_SIZE = r"(?m)^Page size:\s+([0-9.]+)\s+x\s+([0-9.]+)\s+pts\b"
PAGES = "array<struct<page:int,page_width:double,page_height:double>>"
BROKEN = "_broken"
KIDS = f"struct<{BROKEN}:string,kids:array<struct<type:string,id:bigint,`page number`:int,`bounding box`:array<double>,content:string,`heading level`:int,`font size`:double,rows:string>>>"


def read_uploads(spark: SparkSession, path: str, *, modified_before: str | None = None, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Files as document_id (hash of the path), file_path, size, content and error; larger ones than the limit have an error and no content."""
    reader = spark.read.format("binaryFile")
    if modified_before:
        reader = reader.option("modifiedBefore", modified_before)
    files = reader.load(path)
    good = F.col("length") <= limit
    return files.select(F.xxhash64("path").alias("document_id"), F.col("path").alias("file_path"), F.col("length").alias("size"), F.when(good, F.col("content")).alias("content"), F.when(~good, F.lit(f"larger than {limit} bytes")).alias("error"))


def kids(json: Column) -> Column:
    """Parser JSON as kids (its array of items) and _broken (the text if it isn't such JSON); null text is null."""
    return F.from_json(json, KIDS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})


def kids_error(json: Column, parsed: Column, n_pass: Column) -> Column:
    """What is wrong with a pass (text and what kids makes of it), null: nothing. Sound JSON that has no kids, as an array or a number, is none."""
    text = F.trim(json)
    other = F.try_parse_json(json).isNotNull() & ~text.startswith("{") & (text != "null")
    bad = (text == "") | (parsed[BROKEN].isNotNull() & ~other)
    return F.when(bad, F.concat(F.lit("broken parser JSON in pass "), n_pass.cast("string")))


def items_of(parsed: DataFrame) -> DataFrame:
    """document_id, pass, kids to items in the order of the parser's array; broken passes have none."""
    rows = parsed.where(F.col(f"kids.{BROKEN}").isNull()).select("document_id", "pass", F.posexplode("kids.kids").alias("seq", "k"))
    box = F.col("k.bounding box")
    return rows.select("document_id", "pass", "seq", F.col("k.type").alias("type"), F.col("k.id").alias("id"), F.col("k.page number").alias("page"), *(F.get(box, F.lit(i)).alias(x) for i, x in enumerate(("left", "bottom", "right", "top"))), F.col("k.content").alias("content"), F.col("k.heading level").alias("heading_level"), F.col("k.font size").alias("font_size"), F.col("k.rows").alias("rows_json"))


def parse_items(parser_json: DataFrame) -> DataFrame:
    """document_id, pass, json to items in the order of the parser's array. A missing text has none, nor has a broken one: item_errors tells of it."""
    return items_of(parser_json.select("document_id", "pass", kids(F.col("json")).alias("kids")))


def item_errors(parser_json: DataFrame) -> DataFrame:
    """document_id and error of the passes whose JSON is broken."""
    rows = parser_json.select("document_id", kids_error(F.col("json"), kids(F.col("json")), F.col("pass")).alias("error"))
    return rows.where("error is not null")


def pages_of(info: DataFrame, *keep: str) -> DataFrame:
    """document_id, the columns in keep, pages (array) and error of page-information texts; one of the two is null."""
    text = F.col("output")
    count = F.regexp_extract(text, PAGE_COUNT, 1)
    part = lambda i: F.regexp_extract_all(text, F.lit(OWN_SIZE), F.lit(i))
    pages = info.select("document_id", *keep, count.alias("count"), F.arrays_zip(part(1).alias("p"), part(2).alias("w"), part(3).alias("h")).alias("own"), F.regexp_extract(text, ONE_SIZE, 1).alias("w"), F.regexp_extract(text, ONE_SIZE, 2).alias("h"))
    pages = pages.withColumn("count", F.try_to_number("count", F.lit("999999999")).cast("int"))
    last = F.filter("own", lambda x, i: ~F.exists(F.slice("own", i + 2, F.greatest(F.size("own"), F.lit(1))), lambda y: y["p"] == x["p"]))
    pages = pages.withColumn("own", last)
    whole = F.size("own") == F.col("count")
    given = F.transform("own", lambda x: F.struct(x["p"].cast("int").alias("page"), x["w"].cast("double").alias("page_width"), x["h"].cast("double").alias("page_height")))
    same = F.transform(F.sequence(F.lit(1), F.greatest("count", F.lit(1))), lambda i: F.struct(i.alias("page"), F.col("w").cast("double").alias("page_width"), F.col("h").cast("double").alias("page_height")))
    chosen = F.when(whole, given).when(F.col("w") != "", F.when(F.col("count") > 0, same).otherwise(F.array().cast(PAGES)))
    error = F.when(F.col("count").isNull(), "no page count").when(chosen.isNull(), "no page dimensions")
    return pages.select("document_id", *keep, F.when(F.col("count").isNotNull(), chosen).alias("pages"), error.alias("error"))


def parse_page_infos(info: DataFrame) -> DataFrame:
    """document_id, output (page-information text) to page_infos.

    Each page's own size if there are as many as pages, else the default size
    for all; an error without page count or sizes.
    """
    told = F.when(F.col("error").isNull(), F.col("pages")).otherwise(F.raise_error(F.col("error")).cast(PAGES))
    return pages_of(info).select("document_id", F.explode(told).alias("p")).select("document_id", "p.*")


def page_info_errors(info: DataFrame) -> DataFrame:
    """document_id and error of the texts that parse_page_infos fails on."""
    return pages_of(info).where("error is not null").select("document_id", "error")


def html_items(pages: DataFrame) -> DataFrame:
    """Typed items of HTML pages: headings, paragraphs, list items and footers in the order in which they stand, tags stripped."""
    pattern = r"(?s)<(?:h1|p|li|footer)\b[^>]*>.*?</(?:h1|p|li|footer)>"
    rows = pages.select(F.col("page_id").alias("document_id"), F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("seq", "element"))
    tag = F.regexp_extract("element", r"^<(h1|p|li|footer)", 1)
    kind = F.when(tag == "h1", "heading").when(tag == "p", "paragraph").when(tag == "li", "list").otherwise("footer")
    return rows.select("document_id", F.lit(1).alias("pass"), "seq", kind.alias("type"), F.lit(1).alias("page"), F.trim(F.regexp_replace(F.regexp_replace("element", r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " ")).alias("content"))
