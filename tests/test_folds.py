"""Folds that stream: large groups, errors, thresholds, runs in files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.functions.overlap import Blocks, Kept, drop_overlapping_boxes, drop_overlapping_texts, keep_flags
from pageloom.functions.runs import Runs, Texts
from pageloom.functions.phrases import Phrases
from pageloom.operators import cleanup
from pageloom.operators.cleanup import AFTER_TRIM, BEFORE_TRIM, Rule
from pageloom.plans.catalog import REPAIR, Flow
from pageloom.plans.ingest import ingest

DIR = "/root/testdata/sf0.001"


def plain_flags(texts, given):
    kept, out = [], []
    for t, g in zip(texts, given, strict=True):
        total = len(t) - 7
        inside = lambda k, t=t, total=total: t in k if total < 1 else sum(t[i : i + 8] in k for i in range(total)) >= 0.5 * total
        keep = g or not any(inside(k) for k in kept)
        if keep:
            kept.append(t)
        out.append(keep)
    return out


def some_texts(rng, n):
    parts = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 12))) for _ in range(30)]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("most", [5, 60, 1 << 18])
def test_windows_in_files_change_nothing(most):
    rng = random.Random(most)
    for _ in range(12):
        texts = some_texts(rng, 120)
        given = [rng.random() < 0.2 for _ in texts]
        assert keep_flags(texts, given, most=most) == plain_flags(texts, given)


def test_hashes_that_are_equal_are_no_match(monkeypatch):
    import pageloom.functions.overlap as module

    monkeypatch.setattr(module, "hash", lambda _: 7, raising=False)  # every window looks like every other
    rng = random.Random(1)
    texts = some_texts(rng, 80)
    assert keep_flags(texts, [False] * 80, most=20) == plain_flags(texts, [False] * 80)


def test_runs_and_texts():
    rng, runs, want = random.Random(2), Runs(), {}
    for k in range(40):
        keys = np.array([rng.randrange(-50, 50) for _ in range(rng.randrange(60))], np.int64)
        runs.add(keys, np.full(len(keys), k))
        for x in keys.tolist():
            want.setdefault(x, []).append(k)
    asked = np.arange(-60, 60)
    assert [x.tolist() for x in runs.find(asked)] == [want.get(x, []) for x in asked.tolist()] and len(runs.runs) < 10
    texts = Texts()
    for x in ("é\ud800", "", "last"):
        texts.add(x)
    assert [texts[i] for i in (2, 0, 1)] == ["last", "é\ud800", ""]


def test_one_document_of_many_items_streams(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(1).alias("d"), F.col("id").cast("int").alias("seq"), F.when(F.col("id") % 3 == 2, F.concat(F.lit("text number "), (F.col("id") - 1).cast("string"), F.lit(" of these"))).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of these"))).alias("t"))
    few = spark.createDataFrame([(d, s, t) for d in range(2, 40) for s, t in enumerate(["abcdefghij", "abcdefghijk", "xy", "hij", "xyz"])], "d int, seq int, t string")
    kept = drop_overlapping_texts(rows.unionByName(few).repartition(5), ["d"], ["seq"], F.regexp_replace("t", " ", ""), F.col("d") == 1)
    assert kept.where("d = 1").count() == n and kept.where("d > 1").count() == 38 * 3 and kept.where("error is not null").count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    late = kept.where("seq = 1")  # a filter must not go below the fold
    assert late.where("d > 1").count() == 0


def test_thresholds_from_0_to_1():
    rng = random.Random(3)
    for threshold in (0.0, 0.001, 0.02, 0.3, 0.85, 0.999, 1.0):
        blocks, kept = Blocks(threshold), []
        for i in range(400):
            box = (rng.choice("ab"), *(rng.choice([0.0, 0.1, 0.1000001, 0.2, 0.5]) for _ in range(2)), *(rng.choice([0.0, 0.1, 0.11, 0.3]) for _ in range(2)))
            iou = lambda o, box=box: blocks.boxes._iou(o[1:], *box[1:]) if o[0] == box[0] else 0.0
            want = not any(iou(o) >= threshold for o in kept)
            if want:
                kept.append(box)
            assert blocks.step(f"h{i}", *box) == want, (threshold, i, box)


def test_boxes_without_an_area_or_an_end(spark):
    box = lambda w: ("n", 0.1, 0.1, w, 0.5)
    rows = [(p, s, f"h{p}-{s}", box(float("inf") if (p, s) == (2, 1) else float("nan") if p == 3 else 0.1 * (s + 1))) for p in (1, 2, 3) for s in range(4)] + [(4, 0, "h", None), (4, 1, "h", None), (4, 2, None, None), (4, 3, None, None)]
    frame = spark.createDataFrame(rows, "p int, seq int, h string, b struct<coordinate_system:string,x:double,y:double,width:double,height:double>").repartition(3)
    got = drop_overlapping_boxes(frame, ["p"], ["seq"], F.col("h"), F.col("b"), 0.85).collect()
    assert sorted((r.p, r.seq) for r in got) == [(p, s) for p, s, *_ in rows if (p, s) != (4, 1)] and not any(r.error for r in got)


def test_a_step_that_fails_is_an_error_of_its_group(spark):
    from pageloom.functions import overlap

    def step(seen, value):
        if value == "torn":
            raise ValueError("this one is torn")
        seen.append(value)
        return len(seen) < 4

    fold = overlap._fold(lambda *_: [], step)
    rows = [(g, i, "torn" if (g, i) == (2, 1) else "fine") for g in range(5) for i in range(5)]
    frame = spark.createDataFrame(rows, "g int, i int, v string").repartition(3)
    got = overlap._kept(overlap._marked(frame, ["g"], ["i"]), fold, F.lit(True), F.col("v")).collect()
    assert sorted((r.g, r.i) for r in got if r.error is None and r.g != 2) == [(g, i) for g in (0, 1, 3, 4) for i in range(3)]
    assert [(r.g, r.i, r.error) for r in got if r.error is not None] == [(2, 1, "this one is torn")]


class Picky:
    """A conversion that fails on some texts."""

    def __call__(self, text):
        if "三" in text:
            raise ValueError("no such script")
        return text


def test_a_document_that_a_step_fails_on_is_rejected(spark):
    f = Flow(spark, DIR)
    done = ingest(f.items, f.infos, REPAIR, lines=f.lines, attempts=f.attempts, convert=Picky())
    whole = ingest(f.items, f.infos, REPAIR, lines=f.lines, attempts=f.attempts)
    bad = {r.document_id for r in done.rejects.collect()}
    assert bad and {(r.stage, r.error) for r in done.rejects.collect()} == {("blocks", "no such script")} and whole.rejects.count() == 0
    for name in ("blocks", "detections", "report", "warnings"):
        want = sorted(str(r) for r in getattr(whole, name).collect() if r.document_id not in bad)
        assert sorted(map(str, getattr(done, name).collect())) == want and want


def plain_clean(text, before, after):
    """All rules one after the other."""
    import regex

    fixes = []
    for i, rules in enumerate((before, after)):
        for r in rules:
            new = text.replace(r.pattern, r.replacement) if r.literal else regex.sub(r.pattern, r.replacement, text)
            if new != text:
                fixes.append((r.kind, text, new))
            text = new
        if i == 0:
            text = cleanup._ENDS.sub("", text)
    return text, fixes


def test_cleanup_is_the_chain_rule_by_rule(spark):
    rng = random.Random(4)
    parts = [*(r.pattern for r in BEFORE_TRIM if r.literal), *"典技街国發，（）:： ·一二三AIab", "  ", "　", "suchas", "中", "文"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(7))) for _ in range(1500)] + ["plain text", " padded ", "x ", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cleanup.cleaned(F.col("t")).alias("c")).orderBy("i").collect()
    for r, text in zip(got, texts, strict=True):
        assert (r.c.text, [tuple(x) for x in r.c.fixes], r.c.error) == (*plain_clean(text, BEFORE_TRIM, AFTER_TRIM), None)
    some = [Rule("a", "ab", "b", True), Rule("b", "bb+", "c"), Rule("c", "cb", "ab", True), Rule("d", "ab", "z", True)]
    letters = ["".join(rng.choice("abc") for _ in range(9)) for _ in range(300)]
    for text in letters:
        new, fixes = cleanup.clean_text(text, some, ())
        assert (new, [tuple(x.values()) for x in fixes]) == plain_clean(text, some, ())


def test_rules_from_a_table(spark):
    kind = "ord int, kind string, pattern string, replacement string, literal boolean, after_trim boolean"
    rows = [(i, *r[:4], False) for i, r in enumerate(BEFORE_TRIM)] + [(1000 + i, *r[:4], True) for i, r in enumerate(AFTER_TRIM)]
    assert cleanup.rules_from(spark.createDataFrame(rows, kind).repartition(3)) == (BEFORE_TRIM, AFTER_TRIM)
    own = cleanup.rules_from(spark.createDataFrame([(2, "k", "b", "c", True, False), (1, "k", "a", "b", True, False), (3, "p", "c+", "d", False, True)], kind))
    got = spark.createDataFrame([("abc",), (None,)], "t string").select(cleanup.cleaned(F.col("t"), before=own[0], after=own[1]).alias("c")).collect()
    assert [r.c.text for r in got] == ["d", None]
    with pytest.raises(ValueError):
        cleanup.rules_from(spark.createDataFrame([(1, "k", "", "b", True, False)], kind))


def test_phrases_longest_first(spark):
    table = {"a": "1", "ab": "2", "abc": "3", "bc": "4", "cd": "5", "國": "国"}

    def plain(text):
        out, i = "", 0
        while i < len(text):
            p = next((text[i : i + n] for n in (3, 2, 1) if text[i : i + n] in table), None)
            out, i = out + (table[p] if p else text[i]), i + len(p or "x")
        return out

    rng, made = random.Random(5), Phrases([(0, k, v) for k, v in table.items()])
    for _ in range(3000):
        text = "".join(rng.choice("abcd國") for _ in range(rng.randrange(9)))
        assert made(text) == plain(text)
    frame = spark.createDataFrame([(1, "x", "y"), (0, "a", "x"), (0, "a", "z")], "stage int, phrase string, replacement string")
    assert Phrases.read(frame)("a-x") == "y-y" and Phrases.read(frame) == Phrases([(0, "a", "x"), (1, "x", "y")])
    with pytest.raises(ValueError):
        Phrases([(0, "", "x")])


def test_kept_without_anything():
    assert Kept().overlaps("") is False and Kept(short=()).overlaps("longer text") is False
