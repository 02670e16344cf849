"""What page queries share: folds that need no index, statistics without lists, pages without their lines."""

import random

import pandas as pd
import pytest

from pageloom.functions import overlap
from pageloom.functions import text as X
from pageloom.operators import stats
from pageloom.plans.catalog import QUERIES
from pageloom.sources import adapter
from tests.test_folds import plain_flags, some_texts
from tests.test_operators import infos, items
from tests.test_windows import folded


def alike(rng, n):
    """Long texts of which many are copies of an earlier one or half of it, and short ones."""
    texts = some_texts(rng, n)
    for _ in range(n):
        one = rng.choice(texts)
        texts.append(rng.choice([one, one[: len(one) // 2 + rng.randrange(9)] + "".join(rng.choices("xyzé條", k=len(one) // 2)), one[:5], "", one[3:]]))
    return texts


def test_texts_with_much_in_common_need_no_index(monkeypatch):
    rng = random.Random(21)
    groups = [alike(rng, rng.randrange(1, 30)) for _ in range(60)]
    given = [rng.random() < 0.5 for texts in groups for _ in texts]
    want, at = [], 0
    for texts in groups:
        want += plain_flags(texts, given[at : at + len(texts)])
        at += len(texts)
    assert 0 < sum(want) < len(want)
    asked = []
    monkeypatch.setattr(overlap.Lately, "_overlaps", lambda self, text, real=overlap.Lately._overlaps: asked.append(text) or real(self, text))
    assert folded(groups, given, 1 << 20) == want
    assert not asked
    # where there is too much to compare, the steps say it
    for name in ("MOST_PAIRS", "MOST_READ"):
        monkeypatch.setattr(overlap, name, 0)
        assert folded(groups, given, 1 << 20) == want and asked


def test_texts_read_together_are_collapsed_as_one_by_one():
    texts = [None, "", " \t", "A b\x1c C", "Ä b", "條 文�", "x" * 300, " y\x0b\x00"]
    for some in (texts, texts[:3], [None], []):
        got, census = X.all_collapsed(some)
        assert [(t, tuple(n)) for t, n in zip(got, census.tolist(), strict=True)] == [(None, (0,) * 4) if t is None else X.collapsed(t) for t in some]


def test_classes_without_lists_are_those_with_them(spark):
    rng = random.Random(3)
    rows = [(d, 1, i, "paragraph", p, rng.choice([-9, 0, 2.4, 2.5, 60, 120, 180, 240, 300]), 700 - i, "a" * rng.randrange(12), None) for d in range(12) for p in (1, 2) for i in range(rng.choice([0, 1, 20, 60]))]
    known = infos(spark, *((d, p) for d in range(12) for p in (1, 2, 3)))
    found = lambda lists: stats.classify(stats.page_stats(items(spark, rows), known, lists=lists))
    with_, without = found(True), found(False)
    repeated = {(r.document_id, r.page): r.n for r in with_.select("document_id", "page", stats.repeated_columns(with_.x_coords).alias("n")).collect()}
    assert {(r.document_id, r.page): r.repeated for r in without.collect()} == repeated and max(repeated.values()) >= 6
    shared = [x for x in with_.columns if x in without.columns]
    assert {"layout_class", "avg_font_size", "bbox_coverage_ratio", "page_width"} < set(shared)
    rounded = lambda frame: pd.DataFrame(frame.select(*shared).orderBy("document_id", "page").collect(), columns=shared).round(9)
    pd.testing.assert_frame_equal(rounded(with_), rounded(without))


@pytest.mark.parametrize("name", ["classify_pages", "layout_summary", "layout_sentence"])
def test_classes_number_no_items_and_collect_no_lists(spark, name):
    """Of the windows only those of the merge are left: by key and by document."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan
    assert not any("DESC" in x for x in plan.splitlines() if "Window" in x)
    assert "x_coords" not in plan


def test_pages_are_told_without_their_lines(spark):
    at = "/root/testdata/sf0.001"
    want = {(r.document_id, r.last) for r in adapter._boxes(spark, at).groupBy("document_id").agg({"page": "max"}).toDF("document_id", "last").collect()}
    got = adapter.page_infos(spark, at)
    assert {(r.document_id, r.n - 1) for r in got.groupBy("document_id").agg({"page": "max"}).toDF("document_id", "n").collect()} == want
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()
