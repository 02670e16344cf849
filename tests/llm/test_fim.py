"""Fill-in-middle against its rules in plain Python, and edges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pageloom.llm import fim

TEXTS = ["", None, "a", "ab", "é\U0001f600x\n\r\ty" * 9, "has <S> in it", "x <P", ">S> y", "<<P", "M>" * 7, "line one\nline two\n" * 40, "z" * 70000, "same", "same"]
ROWS = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id at all", 0), (4, "same id", 1), (4, "same id", 1), *((i, f"text {i} " * (i % 9), i) for i in range(100, 400))]


def plain(doc_id, text):
    text = text or ""
    n, x = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_against_plain_rules(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, form int").repartition(3)
    got = fim.restore(fim.fill_in_middle(docs, keep=("text", "form"))).collect()
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got), key=str) == sorted(((i, t, *plain(i, t)) for i, t, _ in ROWS), key=str)
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_other_units_and_broken_outputs(spark):
    docs = spark.createDataFrame([(i, f"one two  three {i} four\n") for i in range(60)] + [(99, " gap before")], "id bigint, body string")
    made = fim.fill_in_middle(docs, id_col="id", text_col="body", keep=("body",), unit=r"\S+\s*", rate=100, sentinels=("[p]", "[s]", "[m]"))
    back = fim.restore(made, "again", ("[p]", "[s]", "[m]"))
    assert back.where("again != body").count() == 0
    rows = {r.id: r for r in back.collect()}
    assert rows[99].form == "plain" and rows[3].n == 5 and rows[3].form != "plain"  # a unit can't begin with a blank
    bad = made.where("form != 'plain'").withColumn("output", F.concat("output", F.lit("[m]")))
    assert fim.restore(bad, "again", ("[p]", "[s]", "[m]")).where("again is not null").count() == 0
    swapped = made.where("form != 'plain'").withColumn("form", F.when(F.col("form") == "psm", "spm").otherwise("psm"))
    assert fim.restore(swapped, "again", ("[p]", "[s]", "[m]")).where("again is not null").count() == 0


@pytest.mark.parametrize("bad", [("", "b", "c"), ("ab", "bc", "d"), ("aba", "c", "d"), ("abc", "b", "d"), ("a", "a", "c")])
def test_sentinels_that_cannot_be_told_apart(bad):
    with pytest.raises(ValueError):
        fim.check_sentinels(bad)


def test_no_python_and_no_shuffle(spark):
    plan = fim.op13_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
