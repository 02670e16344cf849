"""Two parser passes over the same documents become one list of items.

All steps go by document, so the items are dealt once by document and everything
else (keys, gaps, the fold, the new order) happens within these partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pageloom.functions.geometry import block_key, round_half_up
from pageloom.functions.labels import is_skipped
from pageloom.functions.order import numbered
from pageloom.functions.overlap import drop_overlapping_texts
from pageloom.functions.text import has_text

FIELDS = ("type", "page", "left", "bottom", "right", "top", "content", "font_size", "rows_json")


def keyed(items: DataFrame) -> DataFrame:
    return items.withColumn("key", block_key(*(F.col(x) for x in ("page", "left", "bottom", "right", "top"))))


def _any(flag: Column, among: WindowSpec) -> Column:
    return F.coalesce(F.max(flag).over(among), F.lit(False))


def _marked(items: DataFrame) -> DataFrame:
    """Items of pass 1 with blanks filled, and of pass 2 those with text that pass 1 has nothing for, dealt by document once, with what the merge asks of their key.

    filled: replaced by pass 2; in_first_text: pass 1 has text under the key; hole: a gap in pass 1, an item without text
    that isn't skipped. Texts that aren't needed any more go before the next window.
    """
    first, text = F.col("pass") == 1, F.col("text_there")
    # what the key says, as numbers: sorted by these, the rows of a page lie together too
    at = {f"at_{x}": round_half_up(F.col(x)) for x in ("left", "bottom", "right", "top")}
    rows = keyed(items.repartition("document_id")).withColumns({"text_there": has_text(F.col("content"))} | at)
    same = Window.partitionBy("document_id", "page", *at)
    last = F.when(F.col("pass") == 2, F.struct("text_there", F.struct(*FIELDS).alias("of")))
    rows = rows.withColumns({"alt": F.max_by(last, F.when(F.col("pass") == 2, F.col("seq"))).over(same), "in_first": _any(first, same), "in_first_text": _any(first & text, same)})
    fill = first & ~text & F.coalesce(F.col("alt.text_there"), F.lit(False))
    own = {x: F.when(F.col("filled"), F.col(f"alt.of.{x}")).otherwise(F.col(x)) for x in FIELDS}
    rows = rows.where(first | (text & ~F.col("in_first"))).withColumns({"filled": fill, "hole": first & ~text & ~is_skipped(F.col("type"))})
    rows = rows.select("document_id", "pass", "seq", "key", "filled", "hole", "text_there", "in_first_text", *(v.alias(k) for k, v in own.items()))
    return rows


def _first(marked: DataFrame) -> DataFrame:
    # counted as filled: text that pass 1 has nowhere under the key
    return marked.where("pass = 1").select("document_id", "seq", "key", "filled", (F.col("filled") & ~F.col("in_first_text")).alias("new"), *FIELDS)


def fill_blanks(items: DataFrame) -> DataFrame:
    """Items of pass 1; a blank one is replaced whole by the item of pass 2 of its key that has text (of several, the last). filled tells."""
    return _first(_marked(items)).drop("new")


def extras(items: DataFrame) -> DataFrame:
    """Items with text that only pass 2 has, on pages where pass 1 has a gap (a blank item that isn't skipped)."""
    gap = _any(F.col("hole"), Window.partitionBy("document_id", "page"))
    return _marked(items).withColumn("gap", gap).where("pass = 2 and gap").select("document_id", "seq", "key", *FIELDS)


def merge_passes(items: DataFrame) -> DataFrame:
    """Pass 1 with blanks filled, and the extras of pass 2 whose text doesn't overlap one kept before anywhere in the document; by page, then from the top.

    seq is the new order; new tells of items whose text pass 1 has nowhere under their key; error of a document whose merge failed at an item; census has the counts of the content's characters.
    """
    extra = F.col("pass") == 2
    rows = _marked(items).select("document_id", F.col("pass").alias("src"), F.col("seq").alias("old"), "filled", "hole", ((F.col("filled") | extra) & ~F.col("in_first_text")).alias("new"), (F.col("text_there") | F.col("filled")).alias("told"), *FIELDS)
    # blank items drop nothing; extras come after all of pass 1
    kept = drop_overlapping_texts(rows, ["document_id"], ["src", "old"], F.col("content"), F.col("src") == 1, takes=F.col("told"), place=F.col("page"), opens=F.col("hole"), measured=True)
    return numbered(kept, "document_id", ["page", F.desc("top"), "src", "old"]).select("document_id", "seq", "filled", *FIELDS, "new", "error", "census")


def filled_count(merged: DataFrame) -> DataFrame:
    """Per document: merged items with text whose key pass 2 has, but pass 1 not with text."""
    return merged.where("new").groupBy("document_id").agg(F.count("*").alias("n_filled"))


def parser_warnings(items: DataFrame, merged: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, warning: documents without any item, and counts of filled blocks."""
    none = documents.select("document_id").distinct().join(items.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit("ODL 兩個 pass 均無輸出，可能 PDF 無可提取文字。").alias("warning"))
    some = filled_count(merged).select("document_id", F.concat(F.lit("ODL dual-pass: "), F.col("n_filled").cast("string"), F.lit(" empty block(s) filled via useStructTree pass")).alias("warning"))
    return none.unionByName(some)
