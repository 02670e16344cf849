"""Product codes against plain integers, and edges."""

import hashlib
import math
import random

import pytest

from pageloom.llm import vector_codes as V


def plain(rows, rounds=V.ROUNDS, entries=V.ENTRIES):
    good = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ids, w = sorted({i for i, _, _ in good if i is not None})[:entries], len(good[0][2]) // 8
    least = {i: min(v for j, _, v in good if j == i) for i in ids}
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(least[i], p) for i in ids] for p in range(8)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(8):
            own = {}
            for _, _, v in good:
                own.setdefault(near(v, p)[1], []).append(part(v, p))
            new.append([[sum(x) // len(x) for x in zip(*own[k], strict=True)] if k in own else c for k, c in enumerate(books[p])])
        books = new
    out = [(i, lab, "".join(f"{near(v, p)[1]:02x}" for p in range(8)), sum(near(v, p)[0] for p in range(8))) for i, lab, v in good]
    total = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, lab, c, e, total[lab]) for i, lab, c, e in out), key=str), digest


def vectors(n, rng, dims=16):
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(dims)], rng.choice([1, 2, None])) for i in rng.sample(range(-50, 5 * n), n)]
    rows += [(900001, None, 1), (900002, [1.0] * (dims - 1) + [None], 2), (900003, [math.nan] * dims, 3), (900004, [math.inf] + [0.0] * (dims - 1), 1)]
    rows += [(None, [0.125] * dims, 7), rows[0], rows[0], (rows[1][0], [-2.0] * dims, 1)] + [(800000 + i, [0.5] * dims, 1) for i in range(n // 3)]
    return rows


@pytest.mark.parametrize("n", [3, 150])
def test_against_plain_integers(spark, n):
    rows = vectors(n, random.Random(n))
    frame = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>, label int, code string, mark int").repartition(4)
    coded, books = V.compress(frame, keep=("code", "mark", "label"), block_rows=16)
    as_float = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").collect()
    want, digest = plain([tuple(r) for r in as_float])
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in coded.collect()), key=str) == want
    assert V.books_digest(books) == digest and coded.columns == ["vec_id", "label", "mark", "code", "error", "label_error"]


def test_tables_without_vectors_or_ids(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 8, 1)]):
        coded, books = V.compress(spark.createDataFrame(rows, kind))
        assert coded.count() == 0 and books is None
    coded, books = V.compress(spark.createDataFrame([(1, [], None)], kind))
    assert [tuple(r) for r in coded.collect()] == [(1, None, "00" * 8, 0, 0)] and books.shape == (8, 1, 0)


@pytest.mark.parametrize("vecs", [[[1.0] * 8, [1.0] * 16], [[1.0] * 12], [[5000.0] * 8]])
def test_vectors_that_do_not_fit(spark, vecs):
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(Exception, match="components|beyond"):
        V.compress(frame)
