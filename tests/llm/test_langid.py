import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import langid as L


def test_symbols():
    s, first = L.symbols(["Ab  c!", "", "12 .", "É"])
    text = lambda i: "".join(map(chr, s[first[i] : first[i + 1]]))
    assert [text(i) for i in range(4)] == ["   ab c ", "", "", "   é "]


def brute(texts, text):
    """Interpolated Kneser-Ney by dictionaries."""
    from collections import Counter

    def norm(t):
        return "   " + "".join(w + " " for w in "".join(c.lower() if c.isalpha() else " " for c in t).split())

    counts = {4: Counter()}
    for t in map(norm, texts):
        counts[4].update(t[i - 3 : i + 1] for i in range(3, len(t)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    floor = 1 / (len(counts[1]) + 1)

    def p(g):
        n = len(g)
        below = floor if n == 1 else p(g[1:])
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {k: v for k, v in counts[n].items() if k[:-1] == g[:-1]}
        if not own:
            return below
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * below

    t = norm(text)
    return sum(np.log(p(t[i - 3 : i + 1])) for i in range(3, len(t)))


def test_probabilities():
    texts = ["the cat sat on the mat", "a thin cat thinks", "that is that"]
    mixture = L.Mixture({"x": L.KneserNey(texts), "y": L.KneserNey(["zzz qqq zq"])})
    for text in ("the cat", "zebra thin", "qqq"):
        sums, _ = mixture.totals([text])
        assert sums[0, 0] == pytest.approx(brute(texts, text), rel=1e-4)


def test_queries_learn_from_two_thirds(spark):
    frame = spark.range(50).select(L.held_out(F.col("id")).alias("h"), (F.crc32(F.col("id").cast("string").cast("binary")) % 3).alias("m"))
    assert all(r.h == (r.m == 1) for r in frame.collect())
    assert spark.sql("select cast(null as bigint) as i").select(L.held_out(F.col("i"))).first()[0] is False


def made(spark, n=60):
    r = random.Random(1)
    langs = {"aa": "mano talu kiri", "bb": "schter durchen ngeb"}
    word = lambda k: "".join(r.sample(langs[k].replace(" ", ""), 4))
    rows = [(i, " ".join(word(k) for _ in range(r.randint(5, 60))), k) for i in range(n) for k in ("aa" if i % 2 else "bb",)]
    rows += [(n, None, "aa"), (n + 1, "", None), (n + 2, "12 %%%", "bb"), (None, "mano talu", "zz"), (n + 3, "你好" * 200, None), (n + 3, rows[0][1], None), (n + 4, "mano talu kiri " * 20000, "aa")]
    return spark.createDataFrame([(*x, "s") for x in rows], "doc_id bigint, text string, lang string, lang_pred string"), n


def test_predictions(spark):
    docs, n = made(spark)
    model = L.fit(docs.where(~L.held_out(F.col("doc_id"))), sample=25)
    assert model.langs == ["aa", "bb"]
    got = {(r.doc_id, r.text): r for r in L.identify(docs, model, keep=("doc_id", "text", "lang", "lang_pred")).collect()}
    assert all(r.lang_pred == r.lang and not r.rejected for (i, _), r in got.items() if i is not None and i < n)
    for (i, text), r in got.items():
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif text.startswith("你"):
            assert r.rejected and r.lang_pred in model.langs


def test_nothing_to_learn(spark):
    docs, _ = made(spark, 4)
    model = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, model).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    got = L.op8_langid(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    right, total = got.agg(F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count("*")).first()
    assert right / total > 0.98


def test_odd_texts_do_not_loosen_rejection():
    r = random.Random(5)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    stems = {k: [pick(v, r.randint(3, 8)) for _ in range(150)] for k, v in {"aa": "aeioumnltk", "bb": "abcdefghiklmnoprstuwz"}.items()}
    text = lambda k, n: " ".join(r.choice(stems[k]) for _ in range(n))
    samples = {k: [text(k, r.randint(5, 400)) for _ in range(100)] for k in stems}
    odd = ["".join(chr(r.randint(0x430, 0x44F)) for _ in range(30000)), pick("abcdefghijklmnopqrstuvwxyz", 50000)]
    for k in stems:
        samples[k][15], samples[k][60] = odd  # both held back
    model = L.Identifier(samples)
    own = [text(k, n) for k in stems for n in (3, 10, 50, 1000) for _ in range(50)]
    assert not model.predict(own)[3].any()
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    other = [pick(x, n) for x in ("абвгдежзиклмнопрстуфхцчш", "αβγδεζηθικλμνξοπρστυφχψω", "你好世界文字", "abcdefghijklmnopqrstuvwxyz", base64) for n in (64, 300, 5000)]
    assert model.predict(other)[3].all()
