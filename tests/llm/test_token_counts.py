import pytest

from pageloom.llm import token_counts as C

CHANGES = "source string, lang string, tokenizer_version string, d_docs bigint, d_tokens bigint"


def totals(rollup):
    return sorted(((r.source, r.lang, r.tokenizer_version, r.n_docs, r.n_tokens) for r in rollup.totals().collect()), key=str)


def test_commits_are_idempotent(spark, tmp_path):
    rollup = C.Rollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == []
    first = spark.createDataFrame([("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), ("b", None, "v1", 1, 7)], CHANGES)
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    assert totals(rollup) == [("a", "en", "v1", 2, 15), ("b", None, "v1", 1, 7)]
    assert rollup.commit("b2", spark.createDataFrame([("a", "en", "v1", -1, -5), ("b", None, "v1", -1, -7), ("a", "en", "v2", 1, 4), ("a", "en", "v1", 0, 3)], CHANGES))
    want = [("a", "en", "v1", 1, 13), ("a", "en", "v2", 1, 4)]
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and not rollup.commit("b1", first) and not rollup.commit("b2", first)
    for name in rollup.batches():
        rollup.fs.delete(rollup._at(f"deltas/{name}"), True)  # a snapshot stands alone
    assert totals(rollup) == want and not rollup.commit("b1", first)
    assert rollup.commit("b3", first.limit(0)) and rollup.commit("b4", first)
    rollup.compact()
    assert totals(rollup) == [("a", "en", "v1", 3, 28), ("a", "en", "v2", 1, 4), ("b", None, "v1", 1, 7)]
    with pytest.raises(ValueError):
        rollup.commit("../x", first)


def test_compaction_prunes_what_the_snapshot_before_holds(spark, tmp_path):
    rollup = C.Rollup(spark, str(tmp_path / "r"))
    row = spark.createDataFrame([("a", "en", "v1", 1, 10)], CHANGES)
    for i in range(4):
        assert rollup.commit(f"b{i}", row)
        rollup.compact()
        assert rollup.batches() == [f"b{i}"]  # kept for readers of the snapshot before
        assert rollup._names_snapshots() == [f"{n:09d}" for n in range(max(1, i), i + 2)]
        assert totals(rollup) == [("a", "en", "v1", i + 1, 10 * (i + 1))]
    assert not any(rollup.commit(f"b{i}", row) for i in range(4))
    rollup.compact()
    assert rollup.batches() == [] and totals(rollup) == [("a", "en", "v1", 4, 40)] and not rollup.commit("b0", row)
    (tmp_path / "r/snapshots/000000005-batches/_SUCCESS").unlink()  # broken off: the one before still counts
    assert totals(rollup) == [("a", "en", "v1", 4, 40)] and rollup.commit("b9", row) and totals(rollup) == [("a", "en", "v1", 5, 50)]
    rollup.compact()
    assert totals(rollup) == [("a", "en", "v1", 5, 50)] and not rollup.commit("b2", row)


def test_a_broken_commit_is_written_again(spark, tmp_path):
    rollup = C.Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "en", "v1", 1, 10)], CHANGES)
    rows.write.parquet(str(tmp_path / "r/deltas/b1"))
    (tmp_path / "r/deltas/b1/_SUCCESS").unlink()
    assert totals(rollup) == [] and rollup.commit("b1", rows) and totals(rollup) == [("a", "en", "v1", 1, 10)]


def test_query(spark, tmp_path):
    docs = [(1, "one two  three", "s", "en"), (1, "one two  three", "s", "en"), (2, None, "s", "en"), (3, "  \n", None, None), (4, "é" * 9, None, "fr"), (5, "w " * 90000, "hot", "en")]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, lang string, d_docs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in C.op9_token_counts(spark, str(tmp_path)).collect()), key=str)
    want = [("s", "en", "chars4-1", 2, 8), ("s", "en", "words-1", 2, 6), (None, "fr", "chars4-1", 1, 3), (None, "fr", "words-1", 1, 1), ("hot", "en", "chars4-1", 1, 45000), ("hot", "en", "words-1", 1, 90000)]
    assert got == sorted(want, key=str)
