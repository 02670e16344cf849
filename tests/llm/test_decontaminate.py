import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from pageloom.llm.decontaminate import Benchmark, decontaminate
from pageloom.llm.words import ALNUM, utf8, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    out = []
    wanted = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        if item is not None and w:
            n = min(10, len(w))
            for s in range(len(w) - n + 1):
                wanted.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in wanted}:
            for s in range(len(w) - n + 1):
                if (ids := wanted.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "Aé", "b2", "zu", "你好", "q", "wer", "x1", "lo"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 25, 10, 9, 4, 1, 0, 40))]
    items += [(3, items[0][1]), (20, items[1][1]), (None, "the of"), (21, None), (22, "zz " * 15)]
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(40)]
    for i, (_, text) in enumerate(items):
        w = (text or "").split()
        docs.append((100 + i, " ".join([*(word() for _ in range(5)), *w, "End.", *w[:10]]).upper()))
        docs.append((200 + i, " ".join(w[1:])))
    return docs + [(None, items[0][1]), (100, docs[-1][1]), (100, docs[-1][1]), (300, None), (301, ""), (302, "zz " * 30), (303, "... !!")], items


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return decontaminate(d, b, **options)


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_against_brute_force(spark, block):
    docs, items = corpus()
    got = run(spark, docs, items, block_bytes=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(docs, items)
    assert all(sum(s["end"] - s["first"] for s in r.spans) == r.n_hit for r in got)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]).count() == 0
    got = run(spark, [(1, "a b")], []).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(2, 0, [])]


def test_clashing_columns_and_keep(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id bigint, text string, item_id string, n_hit int")
    got = decontaminate(docs, spark.createDataFrame([(5, "a b", 1)], "item_id int, text string, doc_id int"), keep=("doc_id", "text", "item_id", "n_hit")).first()
    assert (got.doc_id, got.text, got.item_id, got.n_hit, got["items"]) == (1, "a b", "x", 2, ["5"])


def test_many_blocks_pass_columns_on(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id bigint, text string, n_hit int, items string")
    got = decontaminate(frame, spark.createDataFrame(items, "item_id bigint, text string"), keep=tuple(frame.columns), block_bytes=60)
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
    got = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(docs, items)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(docs, key=str)


def test_large_benchmark_is_indexed_in_arrays():
    r = random.Random(2)
    own = [f"{r.randint(0, 10**6):x}q" for _ in range(400_000)]
    began = time.time()
    index = Benchmark([(str(i), " ".join(own[i : i + 400])) for i in range(0, len(own), 400)])
    assert time.time() - began < 30 and len(index.windows[10][0]) == 391_000
    hit, items = index.search(words(*utf8(pa.array([" ".join(own[805:820])])), ALNUM))
    assert hit.all() and items == {0: {index.ids.index("800")}}


def test_query_digest(spark, tmp_path):
    from pageloom.llm.decontaminate import op1_decontaminate

    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in op1_decontaminate(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)), key=str)
