"""Two-column layout of recognised lines: detection, column roles, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import WS, has_text, strip_ws, trim

#: Numerals and the words of headers and titles.
NUMERALS = "一二三四五六七八九十百零〇○"
LEFT_HEADERS, RIGHT_HEADERS, TITLES = "條文|規定|項目|類別|標準|內容", "說明|備註|定義|理由|日期|規定", "草案|法案|文件"
COLUMN_HEADERS = ("條文", "說明", "規定", "備註", "項目", "類別", "標準", "內容", "定義", "理由", "日期")
LEGAL, TABLE, PLAIN = "two_column_legal_table", "two_column_table", "esearch_paragraphs"


def center_x() -> Column:
    return (F.col("x1") + F.col("x2")) / 2


def is_title(width: Column) -> Column:
    c = center_x()
    return (F.col("y1") < 145) & (c > width * 0.3) & (c < width * 0.7) & strip_ws(F.col("text")).rlike(TITLES)


def is_article_start(text: Column) -> Column:
    return text.rlike(f"^{WS}*第(?:{WS}*[{NUMERALS}])+{WS}*條")


def is_explanation_start(text: Column) -> Column:
    return text.rlike(f"^{WS}*[{NUMERALS}]+[、,，:：]")


def is_list_start(text: Column) -> Column:
    return text.rlike(f"^{WS}*(?:[{NUMERALS}]+[、,，:：]|（[{NUMERALS}]+）|\\([{NUMERALS}]+\\))")


def is_column_header(text: Column) -> Column:
    """Is the text one of the words, white space left out?"""
    return text.rlike(f"^{WS}*(?:{'|'.join(f'{WS}*'.join(x) for x in COLUMN_HEADERS)}){WS}*\\z")


def _prepared(lines: DataFrame) -> DataFrame:
    """Lines with what the facts ask of their texts, each text read once."""
    compact, top = strip_ws(F.col("text")), F.col("y1") < 240
    return lines.withColumns({"__article": top & compact.contains("條文"), "__note": top & compact.contains("說明"), "__body": (F.col("y1") > 70) & (F.length(trim(F.col("text"))) >= 2)})


def _facts() -> dict[str, Column]:
    """What the strategy of a page asks of its (prepared) lines, as aggregates."""
    body = F.col("__body")
    left, right = body & (center_x() < F.col("width_px") * 0.48), body & (center_x() > F.col("width_px") * 0.52)
    n = lambda x: F.count(F.when(x, 1))
    return {
        "w": F.first("width_px"), "has_article": F.max("__article"), "has_note": F.max("__note"),
        "body": n(body), "left": n(left), "right": n(right), "left_max": F.max(F.when(left, F.col("x2"))), "right_min": F.min(F.when(right, F.col("x1"))),
    }


def _strategy(of: dict[str, Column]) -> Column:
    spread = (of["body"] >= 12) & (of["left"] >= 5) & (of["right"] >= 5) & ((of["right_min"] - of["left_max"] > of["w"] * 0.01) | (of["left"] + of["right"] >= of["body"] * 0.75))
    return F.when(of["has_article"] & of["has_note"], LEGAL).when(spread, TABLE)


def page_strategy(lines: DataFrame) -> DataFrame:
    """document_id, page, strategy (null: none). lines have width_px."""
    facts = _facts()
    rows = _prepared(lines).groupBy("document_id", "page").agg(*(v.alias(k) for k, v in facts.items()))
    return rows.select("document_id", "page", _strategy({k: F.col(k) for k in facts}).alias("strategy"))


def generic_headers(lines: DataFrame) -> DataFrame:
    """Pages whose top lines have a header word of the left and one of the right column."""
    compact, top = strip_ws(F.col("text")), F.col("y1") < 240
    left, right = top & (center_x() < 420) & compact.rlike(LEFT_HEADERS), top & (center_x() >= 250) & compact.rlike(RIGHT_HEADERS)
    return lines.groupBy("document_id", "page").agg((F.max(left) & F.max(right)).alias("has_headers"))


def column_role(strategy: Column, gutter: Column) -> Column:
    left = center_x() < gutter
    return F.when(strategy == LEGAL, F.when(left, "article").otherwise("explanation")).otherwise(F.when(left, "left").otherwise("right"))


#: Share of the width that a line has at most to count for the gutter, and where in the width a gutter can be.
NARROW, BAND = 0.6, (0.2, 0.8)


def _gap() -> Column:
    """The gap before a line, if it begins right of all narrow body lines that begin before it; null: none, or not in the band. Greater ones make better gutters: wider, then nearer to the page's middle, then further left."""
    width, page = F.col("width_px"), Window.partitionBy("document_id", "page")
    counts = (F.length(trim(F.col("text"))) >= 2) & (F.col("y1") > 70) & ((F.col("x2") - F.col("x1")) <= width * NARROW) & ~is_title(width)
    before = F.max(F.when(counts, F.col("x2"))).over(page.orderBy("x1", "line_no").rowsBetween(Window.unboundedPreceding, -1))
    middle = (before + F.col("x1")) / 2
    return F.when(counts & (F.col("x1") > before) & (middle >= width * BAND[0]) & (middle <= width * BAND[1]), F.struct((F.col("x1") - before).alias("size"), (-F.abs(middle - width / 2)).alias("near"), (-middle).alias("left")))


def with_gutter(lines: DataFrame) -> DataFrame:
    """Lines with `gutter`, where the page's columns are told apart: the middle of the best gap between its narrow body lines, else of the page. lines have width_px.

    The lines' spans along the width are laid over each other; rows sorted by x1 show where nothing lies.
    """
    best = F.max("__gap").over(Window.partitionBy("document_id", "page"))
    rows = lines.withColumn("__gap", _gap()).withColumn("__best", best)
    return rows.withColumn("gutter", F.coalesce(-F.col("__best.left"), F.col("width_px") / 2)).drop("__gap", "__best")


def column_gutters(lines: DataFrame) -> DataFrame:
    """document_id, page and gutter of each page with lines."""
    return with_gutter(lines).groupBy("document_id", "page").agg(F.first("gutter").alias("gutter"))


def layout_rank(strategy: Column, role: Column) -> Column:
    return F.when(~F.coalesce(strategy.isin(LEGAL, TABLE), F.lit(False)), 10).when(role == "title", 0).when(role.isin("article", "left"), 1).when(role.isin("explanation", "right"), 2).otherwise(3)


def reconstruct(lines: DataFrame, carry: tuple[str, ...] = (), *, by_gutter: bool = False) -> DataFrame:
    """Paragraphs of each page in reading order (seq): titles, left and right column with their lines merged; without a strategy the lines as they are.

    Columns are told apart at the middle of the page, or with by_gutter at the gutter between their lines. lines: document_id, page, line_no, text, mean, x1, y1, x2, y2, width_px.
    carry: columns of lines that are the same for a page. All steps go by page: lines dealt so aren't dealt again.
    """
    page = Window.partitionBy("document_id", "page")
    facts = _facts()
    lines = with_gutter(lines) if by_gutter else lines.withColumn("gutter", F.col("width_px") / 2)
    rows = _prepared(lines).withColumns({f"fact_{k}": v.over(page) for k, v in facts.items()})
    rows = rows.withColumn("strategy", _strategy({k: F.col(f"fact_{k}") for k in facts})).drop("__article", "__note", "__body", *(f"fact_{k}" for k in facts)).where(has_text(F.col("text")))
    role = F.when(F.col("strategy").isNull(), "unknown").when(is_title(F.col("width_px")), "title").otherwise(column_role(F.col("strategy"), F.col("gutter")))
    rows = rows.withColumn("role", role).withColumn("side", F.when(F.col("strategy").isNull(), 9).otherwise(layout_rank(F.col("strategy"), F.col("role"))))
    order = Window.partitionBy("document_id", "page", "side").orderBy(*(F.when(F.col("strategy").isNull(), F.col("line_no")).otherwise(F.col(x)) for x in ("y1", "x1")), "line_no")
    header = F.col("side").isin(1, 2) & is_column_header(F.col("text"))
    starts = F.when(F.col("strategy") == LEGAL, F.when(F.col("side") == 1, is_article_start(F.col("text"))).otherwise(is_explanation_start(F.col("text")))).otherwise(is_list_start(F.col("text")))
    single = ~F.col("side").isin(1, 2)
    rows = rows.withColumn("header", header).withColumn("place", F.row_number().over(order))
    new = single | F.col("header") | starts | F.coalesce(F.lag("header").over(order), F.lit(True))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(order))
    weight = F.greatest(F.lit(1), F.length("text"))
    only = F.col("n") == 1
    merged = rows.groupBy("document_id", "page", "strategy", "side", "island").agg(
        F.count("*").alias("n"), F.min_by("text", "place").alias("one"), F.max("header").alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~single, F.struct("place", trim(F.col("text")).alias("t"))))), lambda s: s["t"]), "").alias("joined"),
        (F.sum(F.col("mean") * weight) / F.sum(weight)).alias("mean"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min_by("role", "place").alias("role"), *(F.first(x).alias(x) for x in carry),
    )
    text = F.when(~F.col("side").isin(1, 2) | F.col("header"), F.col("one")).otherwise(F.col("joined"))
    reading = Window.partitionBy("document_id", "page").orderBy("side", "island")
    return merged.select("document_id", "page", (F.row_number().over(reading) - 1).alias("seq"), text.alias("text"), "mean", "x1", "y1", "x2", "y2", F.coalesce("strategy", F.lit(PLAIN)).alias("strategy"), "role", only.alias("single"), *carry)
