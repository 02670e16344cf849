"""The pipeline and the registered queries."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.test_queries import DIR, duck  # noqa: F401

OPS = sorted(n for n in entry.queries() if re.match(r"op\d+_", n))


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in OPS) == list(range(1, 14)) and "pipeline" in entry.queries()


def told(columns, found):
    """Rows as text, columns by name; whole numbers with nulls stay whole, which they don't in pandas."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", [n for n in OPS if n in entry.oracle_sql()])
def test_same_as_sql(spark, duck, name):  # noqa: F811
    got, want = entry.queries()[name](spark, DIR), duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert told(got.columns, got.collect()) == told(want.columns, want.fetchall())


def made(spark, tmp_path):
    words = lambda i, n: " ".join(f"w{(i * 7919 + k * 31) % 100003}q" for k in range(n))
    texts = {i: "\n".join([words(i, 40), words(i + 1000, 30), words(i + 2000, 30)]) for i in range(30)}
    leak = words(77, 14)
    texts |= {40: texts[1].replace("\n", " "), 41: texts[2].replace("\n", " ") + " end", 50: texts[3] + "\n" + leak, 60: "", 61: None, 62: "12 34 %%"}
    docs = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "so " + leak + " it is")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_decisions_take_effect(spark, tmp_path):
    sf_dir = made(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = set(range(30)) | {40, 41, 50}
    assert seen[0] == everything and seen[1] == everything
    assert seen[2] == everything - {40, 41} and seen[3] == seen[2] - {50} and seen[4] == seen[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == seen[4]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and os.path.isdir(DIR) and duckdb is not None


def test_exact_copies_of_many_lines_leave_no_fragments(spark, tmp_path):
    words = lambda i, n: " ".join(f"w{(i * 7919 + k * 31) % 100003}q" for k in range(n))
    first = {i: [words(100 * i + j, 12) if j % 3 else f"short{i}x{j}y" for j in range(12)] for i in range(8)}
    texts = {i: "\n".join(x) for i, x in first.items()}
    texts |= {20 + i: "\n".join(x) for i, x in first.items()}  # exact
    texts |= {40 + i: "\n".join([*x[:4], x[4] + " changed", *x[5:], "one line more"]) for i, x in first.items()}  # near
    texts |= {60: "\n".join([*first[0][:4], *(words(9000 + j, 20) for j in range(6))])}  # a shared passage only
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cut = corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path))
    cut.write.parquet(str(tmp_path / "cut"))
    cut = spark.read.parquet(str(tmp_path / "cut"))
    assert {r.doc_id for r in cut.collect()} & set(range(20, 28)) == set()
    left = {r.doc_id: r.text for r in corpus_pipeline.near_dedup_stage(spark, cut, str(tmp_path)).collect()}
    assert set(left) == set(range(8)) | set(range(40, 48)) | {60}
    assert all(left[40 + i] == x[4] + " changed\none line more" for i, x in first.items())  # what no other document holds
    assert all(left[i] == texts[i] for i in range(8)) and left[60] == "\n".join(texts[60].split("\n")[4:])
