"""Columns with clashing names, ids that repeat or are null, empty tables: all operators and the pipeline's stages."""

import pytest

import corpus_pipeline
from pageloom.llm import bpe, langid, line_dedup, near_dedup, personal, secrets, store, telephony
from pageloom.llm.decontaminate import decontaminate

NAMES = ("n_words", "n_hit", "items", "spans", "n_lines", "n_removed", "lang_pred", "score", "cross_entropy", "rejected", "ids", "decoded", "media", "payload", "pcm", "feature", "n_bytes", "n_shingles", "component_id", "kept", "id", "th", "c", "n", "__gone", "__runs", "part", "v")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clashing(spark, rows):
    return spark.createDataFrame([(*x, *range(len(NAMES))) for x in rows], DOCS + "".join(f", {x} int" for x in NAMES))


ROWS = [(1, "un deux trois quatre", "fr", "s", 20), (None, None, None, None, None), (2, "", "fr", "s", 0), (3, "un deux trois quatre\ncinq", "fr", "s", 25)]


def model():
    return langid.Identifier({"fr": [x[1] for x in ROWS if x[1]] * 5})


OPERATORS = {
    "decontaminate": lambda d: decontaminate(d, d.select("doc_id", "text"), keep=tuple(d.columns), item_col="doc_id"),
    "near_dedup": lambda d: near_dedup.near_dedup(d),
    "one_of_each": near_dedup.one_of_each,
    "telephony": lambda d: telephony.store_media(d, keep=tuple(d.columns)),
    "line_dedup": lambda d: line_dedup.dedup_lines(d, whole_runs=True),
    "personal": lambda d: personal.find_personal(d, keep=tuple(d.columns)),
    "bpe": lambda d: bpe.encode_decode(d, keep=tuple(d.columns)),
    "secrets": lambda d: secrets.find_secrets(d, keep=tuple(d.columns)),
    "langid": lambda d: langid.identify(d, model(), keep=tuple(d.columns)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_empty_tables(spark, name):
    docs = clashing(spark, ROWS)
    with store.scope(spark):
        out = OPERATORS[name](docs)
        assert len({x.lower() for x in out.columns}) == len(out.columns)
        got = out.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in ROWS)
        if name != "near_dedup":
            texts = {str(r.doc_id): r for r in got}
            assert texts["3"].source == "s" and texts["3"].th == NAMES.index("th")
        assert OPERATORS[name](docs.limit(0)).count() == 0


def table(spark, tmp_path, rows):
    clashing(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_stages_with_clashing_columns_repeated_and_null_ids(spark, tmp_path):
    a, b = "mano talu kiri sol " * 3 + "fe", "numa rel tok vash il " * 4 + "po"
    leak = "zu w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 va"
    rows = [(1, a), (2, a), (2, b), (2, b), (None, b), (None, "lone sa pire mu " * 3), (3, leak), (4, ""), (5, None)]
    docs = table(spark, tmp_path, [(i, t, "xx", "s", len(t or "")) for i, t in rows])
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert (1, a) in left["language_id"] and all(text for _, text in left["language_id"])  # learned from so little, it may reject the others
    assert left["line_dedup"] == sorted(rows, key=str)  # no run of two lines
    assert left["near_dedup"] == sorted([(1, a), (2, b), rows[5], (3, leak), (4, ""), (5, None)], key=str)
    assert left["decontaminate"] == sorted([x for x in rows if x[0] != 3], key=str)
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert encoded.count() == len(rows) and encoded.where("doc_id = 4").first().n_tokens == 0


def test_pipeline_over_an_empty_table(spark, tmp_path):
    table(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_with_equal_sums_are_no_link(spark):
    word = "a"
    for _ in range(11):  # sums of powers modulo 2**64 can't tell this word from its mirror image
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = near_dedup.near_dedup(spark.createDataFrame([(1, f"{word} x"), (2, f"{other} x"), (3, f"{word.upper()} x")], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_whole_sets_give_the_same_groups(spark):
    from tests.llm.test_near_dedup import brute, families

    docs = families(9)[:40]
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), sketch=None).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)


def test_a_scope_leaves_nothing(spark):
    import os

    root = store.shared_dir(spark)
    before, limit = set(os.listdir(root)), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with store.scope(spark):
        near_dedup.near_dedup(spark.createDataFrame(ROWS, DOCS)).collect()
    assert set(os.listdir(root)) == before and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == limit


def test_scopes_of_two_threads(spark):
    """The one that ends first doesn't take the other's tables away."""
    from threading import Event, Thread

    written, ended, got = Event(), Event(), []

    def first():
        with store.scope(spark):
            written.wait(60)
            store.Scratch(spark, "a").keep(spark.range(3), "x")
        ended.set()

    def second():
        with store.scope(spark):
            table = store.Scratch(spark, "b").keep(spark.range(5), "x")
            written.set()
            ended.wait(60)
            got.append(table.count())

    threads = [Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert got == [5]
