"""The page driver: which attempts are made, errors as rows, crashes and time limits, and the flow with it."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pageloom.operators import ocr, recognise
from pageloom.operators.recognise import Line, Recognised, run_cascade, steps
from pageloom.plans.catalog import QUERIES, REPAIR, Flow
from pageloom.plans.ingest import ingest
from pageloom.plans.options import IngestOptions
from pageloom.sources import adapter

DIR = "/root/testdata/sf0.001"


def open_test(folder=None):
    """means: a page's mean confidence at each attempt, None: no lines, "boom": fails."""

    def run(step, page):
        if folder:
            with open(os.path.join(folder, f"{page['document_id']}-{page['page']}-{step.attempt_no}"), "a") as f:
                f.write("x")
        mean = page["means"][step.attempt_no - 1]
        if mean == "boom":
            raise ValueError(f"page {page['page']} is torn")
        if mean == "die":
            os._exit(3)
        if mean == "sleep":
            time.sleep(60)
        if mean == "bad":
            return "no result"
        return Recognised([] if mean is None else [Line("a line", float(mean), 1, 2, 30, 4), Line(None, float("nan"), 1, 2, 30, 4)], 100, 200, f"m{int(step.fallback)}")

    return run


PAGES = {1: ["0.9", "boom", "boom", "boom"], 2: ["0.54", "0.55", "boom", "boom"], 3: [None, None, "0.6", "boom"], 4: ["0.1", "0.5", "0.3", "0.2"], 5: ["boom"], 6: ["0.2", "boom"], 7: ["bad"], 8: ["nan", "nan", "inf", None]}
MADE = {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 2, 7: 1, 8: 4}


def pages(spark, of=PAGES):
    return spark.createDataFrame([(1, p, m + ["boom"] * (4 - len(m))) for p, m in of.items()], "document_id bigint, page int, means array<string>")


def test_attempts_are_made_only_where_needed(spark, tmp_path):
    lines, attempts = run_cascade(pages(spark), lambda: open_test(str(tmp_path)), steps(IngestOptions()))
    got = {r.page: r for r in attempts.groupBy("page").agg(F.count("*").alias("n"), F.max("error").alias("error"), F.max_by("stage", "attempt_no").alias("stage"), F.max_by("dpi", "attempt_no").alias("dpi"), F.max_by("model_label", "attempt_no").alias("model")).collect()}
    assert {p: r.n for p, r in got.items()} == MADE
    made = os.listdir(tmp_path)
    assert len(made) == sum(MADE.values()) and all(len(open(tmp_path / x).read()) == 1 for x in made)  # and none of them twice
    assert got[5].error == "page 5 is torn" and got[6].error == "page 6 is torn" and "lines" in got[7].error and got[1].error is None
    assert (got[4].stage, got[4].dpi, got[4].model) == ("fallback_rec_ppocr_v4_doc", 220, "m1") and got[3].dpi == 220
    summary = ocr.attempt_summary(attempts, lines)
    chosen = {r.page: r.attempt_no for r in ocr.choose_attempt(summary).collect()}
    assert chosen == MADE  # the last one made
    taken = ocr.chosen_lines(lines, attempts)
    assert sorted({r.page for r in taken.collect()}) == [1, 2, 3, 4]
    warned = ocr.failed_pages(attempts, pages(spark)).collect()
    assert sorted(r.warning for r in warned)[0] == "OCR repair 第 5 頁失敗: page 5 is torn" and len(warned) == 3


def test_without_a_fallback_model_and_without_pages(spark):
    _, attempts = run_cascade(pages(spark), open_test, steps(IngestOptions(ocr_repair_profile="dev"), fallback_model=False))
    assert attempts.where("page = 4").agg(F.max("attempt_no"), F.max("dpi")).first()[:] == (3, 150)
    lines, attempts = run_cascade(pages(spark).limit(0), open_test, steps(IngestOptions()))
    assert lines.count() == attempts.count() == 0


def test_crashes_and_time_limits_are_errors_of_their_page(spark):
    of = {1: ["0.9"], 2: ["die"], 3: ["sleep"], 4: ["boom"], 5: ["0.1", "0.8"]}
    lines, attempts = run_cascade(pages(spark, of), open_test, steps(IngestOptions()), apart=True, seconds=3, in_flight=1)
    errors = {r.page: r.error for r in attempts.where("error is not null").collect()}
    assert errors == {2: "recognition ended with code 3", 3: "recognition took more than 3 s", 4: "page 4 is torn"}
    assert sorted({r.page for r in lines.collect()}) == [1, 5]
    with pytest.raises(ValueError):
        run_cascade(pages(spark, of), open_test, steps(IngestOptions()), seconds=3)


def test_pages_in_flight(spark, tmp_path):
    folder = str(tmp_path)

    def open_slow():
        def run(step, page):
            mark = os.path.join(folder, f"now-{page['page']}")
            open(mark, "w").close()
            time.sleep(0.05)
            n = len([x for x in os.listdir(folder) if x.startswith("now-")])
            os.remove(mark)
            return Recognised([Line(str(n), 0.9, 0, 0, 1, 1)], 1, 1, "m")

        return run

    of = {p: [] for p in range(24)}
    lines, _ = run_cascade(pages(spark, of), open_slow, steps(IngestOptions()), in_flight=2, tasks=8)
    assert lines.count() == 24 and max(int(r.text) for r in lines.collect()) <= 2


def test_the_flow_with_a_recogniser_is_the_flow_with_its_tables(spark):
    f = Flow(spark, DIR)
    given = ingest(f.items, f.infos, REPAIR, lines=f.lines, attempts=f.attempts)
    driven = ingest(f.items, f.infos, REPAIR, rasters=adapter.page_rasters(spark, DIR), open_recogniser=adapter.open_recogniser)
    rows = lambda df: sorted(map(str, df.drop("fixes").collect()))
    assert rows(driven.blocks) == rows(given.blocks) and rows(driven.warnings) == rows(given.warnings)
    assert driven.blocks.where(F.col("parser") == ocr.PARSER).count() > 0


def test_scans_and_exchanges_of_the_repair_queries(spark):
    def plan(name):
        text = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        return text.count("FileScan"), text.count("Exchange hashpartitioning"), text.count("BroadcastExchange")

    scans, exchanges, _ = plan("paragraph_merge")
    assert scans <= 2 and exchanges <= 2
    scans, exchanges, broadcasts = plan("ocr_merge")
    print("ocr_merge", scans, exchanges, broadcasts)
    assert scans <= 12 and exchanges <= 14


def test_slots_are_free_again(tmp_path, monkeypatch):
    monkeypatch.setattr(recognise.tempfile, "gettempdir", lambda: str(tmp_path))
    for _ in range(3):
        with recognise._slot(1):
            pass
