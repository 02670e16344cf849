import random
import re

import pytest

from pageloom.llm import near_dedup as N
from pageloom.llm import store

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({(a, b) for a, b in zip(w, w[1:], strict=False)} if len(w) > 1 else {(x,) for x in w})
    group = list(range(len(docs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= 80 * len(sets[i] | sets[j]) and sets[j]:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, len(sets[i]), least.get(root(i), None) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def families(seed):
    """Families of near copies at all distances around the limit, over few common words."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "and"]) if r.random() < 0.4 else f"w{r.randint(0, 400)}"
    docs = []
    for size, n in ((30, 20), (120, 25), (300, 8), (8, 12), (3, 6), (60, 30)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            w = [word() if r.random() < r.choice([0, 0.02, 0.05, 0.1]) else x for x in base]
            docs.append(" ".join(w))
    docs += ["", None, "   ", "one", "One", "two", "of the", "OF the", "of\tthe", "the of"] + docs[:5]
    ids = list(range(len(docs)))
    r.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize(("short", "block"), [(16, 1536), (3, 7)])
def test_against_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(N, "SHORT_LIST", short)
    monkeypatch.setattr(N, "BLOCK", block)
    docs = families(5)
    got = N.near_dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_BYTES", -1)
    docs = families(6)[:60]
    got = N.near_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)


def test_nulls_repeats_and_empty_tables(spark):
    docs = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, ""), (None, "q r s")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, c string, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(frame).collect()), key=str)
    assert got == sorted([(None, 5, 4, False), (4, 5, 4, True), (4, 5, 4, True), (None, 0, None, True), (9, 0, 9, True), (None, 2, None, True)], key=str)
    assert N.near_dedup(frame.limit(0)).count() == 0


def test_components(spark):
    from pageloom.llm.store import Scratch

    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 45), (45, 41), (50, 51), (51, 50), (60, 60)]
    got = N.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()
    assert {r.c: r.root for r in got} == {i: 0 for i in range(31)} | {40: 40, 45: 40, 41: 40, 50: 50, 51: 50}
