"""What the folds and the overlap ratio ask of windows: in proportion to the texts, the same as all pairs."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom.functions import overlap
from pageloom.functions import text as X
from tests.test_folds import plain_flags, some_texts


def folded(groups, given, batch):
    """Keep flags of groups of texts that come in batches of so many rows."""
    rows = [(i == 0, g, t, groups[g]) for g, texts in enumerate(groups) for i, t in enumerate(texts)]

    def batches():
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            short = [[t for t in of if len(t) < 8] or None if new else None for new, _, _, of in part]
            yield pd.Series([r[0] for r in part]), pd.Series([True] * len(part)), pd.Series(short, dtype=object), pd.Series([r[2] for r in part]), pd.Series(given[at : at + batch])

    return np.concatenate([x.keep.to_numpy() for x in overlap._folded(overlap._with_fresh(batches()), overlap._begin_texts, overlap._step_texts)]).tolist()


@pytest.mark.parametrize(("batch", "piece"), [(7, 1 << 20), (50, 100), (1000, 400), (1000, 1 << 20)])
def test_folds_with_hashed_windows_equal_all_pairs(monkeypatch, batch, piece):
    monkeypatch.setattr(overlap, "PIECE", piece)
    monkeypatch.setattr(overlap, "LARGE", 2 * piece)
    rng = random.Random(batch + piece)
    groups = [some_texts(rng, rng.randrange(1, 40)) for _ in range(30)] + [["é條文規定說明備註𝄞abc" * k for k in (1, 2, 3)], [""], ["abcdefgh", "abcdefgh", "abc"]]
    given = [rng.random() < 0.2 for texts in groups for _ in texts]
    want, at = [], 0
    for texts in groups:
        want += plain_flags(texts, given[at : at + len(texts)])
        at += len(texts)
    assert folded(groups, given, batch) == want


def test_distinct_texts_of_many_pages_need_no_index(monkeypatch):
    monkeypatch.setattr(overlap.Kept, "add", lambda *_: pytest.fail("an index of windows"))
    rng = random.Random(5)
    groups = [["".join(rng.choices("abcdefghijklmnop", k=300)) for _ in range(8)] for _ in range(200)]
    assert all(folded(groups, [False] * 1600, 500))


def test_ratio_of_long_lines_is_linear(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdef", k=200_000))
    began = time.time()
    rows = spark.createDataFrame([(long, long[:100_000]), (long + "條", long[100_000:]), ("abc", "xabc"), ("abcdefgh", "abc"), (None, "a"), ("é" * 9, "é" * 8)], "x string, y string")
    got = [r[0] for r in rows.select(overlap.overlap_ratio(F.col("x"), F.col("y"))).collect()]
    assert time.time() - began < 30
    for r, (x, y) in zip(got[:2], [(long, long[:100_000]), (long + "條", long[100_000:])], strict=True):
        there = {y[i : i + 8] for i in range(len(y) - 7)}
        assert r == sum(x[i : i + 8] in there for i in range(len(x) - 7)) / (len(x) - 7)
    assert got[2:] == [1.0, 0.0, None, 1.0]


def test_white_space_is_that_of_ecmascript(spark):
    text = "A\x1c\x1d\x1e\x1f\x85 ​᠎ΟΔΟΣ ΑΒ　﻿條�"
    r = spark.range(1).select(X.collapse_ws(F.lit(text)).alias("c"), F.lower(X.strip_ws(F.lit(text))).alias("want"), *(v.alias(k) for k, v in X.census(F.lit(text)).items())).first()
    assert r.c == r.want and (r.chars, r.spaces, r.cjk, r.replaced) == (len(r.want), 4, 1, 1)


def test_texts_are_compared_as_spark_has_them_without_a_pass_before(spark):
    texts = [None, "", " \t", "A b C\x1c\x85", "ÀÉ × ß Ÿ", "ΟΔΟΣ ΑΒ Σ", "ᲉꟋ İ", "條 文�　Z"]
    r = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.collapse_ws(F.col("t")).alias("want"), F.struct(*X.census(F.col("t")).values()).alias("n")).orderBy("i").collect()
    assert [(None, (0, 0, 0, 0)) if t is None else X.collapsed(t) for t in texts] == [(x.want, tuple(x.n)) for x in r]
    rows = spark.createDataFrame([(g, i, t) for g in range(3) for i, t in enumerate(["Some Text of a Page", "some  text of a PAGE", "TEXT o", " ", None])], "g int, i int, t string")
    kept = overlap.drop_overlapping_texts(rows, ["g"], ["i"], F.col("t"), F.lit(False), measured=True)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1
    assert sorted((x.g, x.i, x.census.chars) for x in kept.collect()) == [(g, i, n) for g in range(3) for i, n in ((0, 15), (4, 0))]


def test_rows_whose_place_nothing_opened_go(spark):
    rows = spark.createDataFrame([(1, 0, 1, True, True), (1, 1, 2, True, False), (1, 2, 1, False, False), (1, 3, 2, False, False), (2, 0, 1, False, False), (2, 1, None, True, True), (2, 2, None, False, False)], "g int, i int, p int, given boolean, opens boolean").withColumn("t", F.concat(F.lit("a text by number "), F.repeat(F.col("i").cast("string"), F.lit(40))))
    kept = overlap.drop_overlapping_texts(rows, ["g"], ["i"], F.col("t"), F.col("given"), place=F.col("p"), opens=F.col("opens"))
    assert sorted((x.g, x.i) for x in kept.collect()) == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_statistics_of_merged_items_read_no_text_again(spark):
    from pageloom.plans.catalog import QUERIES

    plan = QUERIES["page_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 1


def test_settle_is_the_folds_one_after_the_other(spark):
    """One fold over native blocks and those of repair leaves what three folds leave, with few texts and boxes and with many."""
    from pageloom.operators import blocks as B
    from pageloom.operators import ocr

    rng = random.Random(11)
    words = ["alpha beta gamma", "delta", "eta", "a b", "繁體 中文 條文", "beta gamma delta epsilon", "zeta eta theta iota"]
    schema = "document_id int, page int, seq int, text string, source_hash string, bbox struct<x:double,y:double,width:double,height:double,coordinate_system:string>, error string, parser string"

    def made(d, p, i, parser):
        text = None if rng.random() < 0.03 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
        box = None if rng.random() < 0.05 else (rng.randrange(4) / 4, rng.randrange(90) / 90 + rng.random() / 300, rng.choice([0.0, 0.2, 0.21]), 0.02, rng.choice(["normalized", "normalized", "points"]))
        return d, p, i, text, text and f"{p}:{text}", box, "torn" if text is None else None, parser

    pages = [(d, p, rng.choice([1, 3, 9, 30, 150])) for d in range(12) for p in (1, 2, 3)]
    native = spark.createDataFrame([x for d, p, n in pages for i in range(n) if (x := made(d, p, 5 * i, "n"))[3] is not None], schema).repartition(3)
    repair = spark.createDataFrame([made(d, p, i, "r") for d, p, n in pages if d % 3 for i in range(n // 2)], schema).repartition(3)
    found = lambda rows: sorted((r.document_id, r.page, r.seq, r.parser, str(r.text), str(r.error)) for r in rows.collect())
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            left = B.drop_overlapping(native, F.lit(False))
            merged = ocr.merge_blocks(left, repair)
            want = [found(left), found(B.dedupe(left)), found(merged), found(B.dedupe(merged))]
            assert [found(x) for x in (B.settle(native), B.settle(native, None, 0.85), B.settle(native, repair), B.settle(native, repair, 0.85))] == want
            assert len({len(x) for x in want}) == 4
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_of_pages_not_to_repair_go_before_the_choice(spark):
    """They meet no window."""
    from pageloom.operators import ocr

    lines = spark.createDataFrame([(d, p, a, i, f"{d}-{p}-{a}-{i}", 0.3 + 0.1 * a + 0.01 * d) for d in range(5) for p in (1, 2) for a in (1, 2, 3) for i in range(3)], "document_id int, page int, attempt_no int, line_no int, text string, mean double")
    attempts = spark.createDataFrame([(d, p, a, 100 * a, 50, 150, f"m{a}", "bad" if (d, a) == (3, 1) else None) for d in range(5) for p in (1, 2) for a in (1, 2, 3)], "document_id int, page int, attempt_no int, width_px int, height_px int, dpi int, model_label string, error string")
    pages = spark.createDataFrame([(d, 2, ["x"]) for d in range(5)], "document_id int, page int, triggers array<string>")
    got = ocr.chosen_lines(lines, attempts, pages)
    # means are 0.3 + a / 10 + d / 100: 0.55 is reached by attempt 3 of all documents
    assert sorted((r.text, r.width_px, r.model_label) for r in got.collect()) == sorted((f"{d}-2-3-{i}", 300, "m3") for d in (0, 1, 2, 4) for i in range(3))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Window") < plan.index("Join LeftSemi")
    whole = {r.text for r in ocr.chosen_lines(lines, attempts).collect()}
    assert {r.text for r in got.collect()} == {x for x in whole if x.split("-")[1] == "2"} and len(whole) == 24
