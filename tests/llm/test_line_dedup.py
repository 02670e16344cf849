import random

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import line_dedup as L
from pageloom.llm import store
from pageloom.llm.words import grams, utf8, words


def cut(text):
    data, offsets = utf8(pa.array([text]))
    _, lines, start, end = L.chunks(data, offsets)
    return [(int(n), data[a:b].tobytes().decode()) for n, a, b in zip(lines, start, end, strict=True)]


def line(r):
    return " ".join(r.choice(["alpha", "beta", "gämma", "delta", "eps"]) + str(r.randint(0, 99)) for _ in range(r.randint(1, 9)))


def test_chunks_hold_the_whole_text():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 30):
        text = "\n".join(line(r) if r.random() < 0.9 else "" for _ in range(n))
        assert "".join(x for _, x in cut(text)) == (text if text.strip("\n") else "")


def test_boundaries_move_with_the_lines():
    r = random.Random(2)
    passage = [line(r) for _ in range(40)]
    a = {x.strip("\n") for n, x in cut("\n".join([line(r) for _ in range(7)] + passage + [line(r)])) if n > 1}
    b = {x.strip("\n") for n, x in cut("\n".join([line(r) for _ in range(4)] + passage + [line(r) for _ in range(3)])) if n > 1}
    shared = sum(x.count("\n") + 1 for x in a & b)
    assert shared >= 25  # all but the edges and chunks of one line


def plain_chunks(text):
    """Chunks line by line: each line hashed alone, each pair of lines alone."""
    out, own = [], []
    for x in (x for x in text.split("\n") if x):
        h = words(*utf8(pa.array([x])), L.IN_LINE).hash[0]
        if len(own) > 1 and grams(np.array([own[-2][1], own[-1][1]]), 2)[0] % np.uint64(L.AVERAGE_LINES) == 0:
            out.append([])
        elif not own:
            out.append([])
        own.append((x, h))
        out[-1].append(x)
    return out


def test_boundaries_line_by_line_and_the_least_id_keeps(spark):
    docs = [(d, t) for d, t in corpus() if d is not None and d != 5] + [(7000 + i, "\n".join(["same a", "same b", "same c"] * i)) for i in range(6)]
    data, offsets = utf8(pa.array([t for _, t in docs]))
    row, lines, start, end = L.chunks(data, offsets)
    plain = {d: plain_chunks(t or "") for d, t in docs}
    assert [(int(r), int(n)) for r, n in zip(row, lines, strict=True)] == [(i, len(c)) for i, (d, _) in enumerate(docs) for c in plain[d]]
    seen, want = set(), {}
    for d, _ in sorted(docs):
        want[d] = []
        for c in plain[d]:
            if len(c) == 1 or tuple(c) not in seen:
                want[d] += c
            if len(c) > 1:
                seen.add(tuple(c))
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: [x for x in (r.text or "").split("\n") if x] for r in got} == want


def brute(docs):
    """The same rule with whole texts as keys."""
    seen = {}
    order = sorted({(d is not None, d if d is not None else 0, t or "") for d, t in docs})
    per = {}
    for k in order:
        pieces = cut(k[2])
        per[k] = pieces
        for p, (n, x) in enumerate(pieces):
            if n > 1:
                seen.setdefault(x.strip("\n"), []).append((k, p))
    return seen, per


def corpus():
    r = random.Random(3)
    shared = ["\n".join(line(r) for _ in range(8)) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = ["\n".join(line(r) for _ in range(r.randint(1, 6)))]
        if i % 2:
            parts.append(shared[i % 4])
        parts.append("\n".join(line(r) for _ in range(r.randint(1, 6))))
        docs.append((i, "\n".join(parts)))
    docs += [(100, docs[0][1]), (101, docs[0][1].upper()), (102, ("\n".join(line(r) for _ in range(12)) + "\n") * 20), (5, docs[5][1]), (200, None), (201, ""), (202, "\n\n"), (203, "one line"), (None, shared[0])]
    return docs


@pytest.mark.parametrize("broadcast", [16 << 20, -1])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(store, "BROADCAST_BYTES", broadcast)
    docs = corpus()
    got = L.dedup_lines(spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id bigint, text string, place string").repartition(3)).collect()
    assert len(got) == len(docs) and all(r.place == "k" for r in got)
    seen, per = brute(docs)
    texts = {(r.doc_id is not None, r.doc_id or 0): r for r in got}
    total_before = sum(len(t or "") for _, t in docs)
    assert sum(len(r.text or "") for r in got) < total_before
    kept = {}
    for k, pieces in per.items():
        r = texts[k[:2]]
        for p, (n, x) in enumerate(pieces):
            key = x.strip("\n")
            if n == 1 or len(seen[key]) == 1:
                assert key in (r.text or "")  # what isn't repeated stays
            elif key in (r.text or ""):
                kept[key] = kept.get(key, 0) + 1
    assert all(kept.get(k, 0) >= 1 for k, v in seen.items() if len(v) > 1)  # one occurrence stays
    assert texts[True, 200].text is None and texts[True, 201].text == "" and texts[True, 202].text == "\n\n"
    assert texts[True, 100].n_removed > 0 and texts[True, 0].n_removed == 0 and texts[True, 102].n_removed >= 100
    assert texts[True, 101].n_removed == 0  # other bytes


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert len(L.chunks(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0]) == 0


def by_pairs(docs):
    """Which lines stay by the rule of pairs."""
    lines = {d: [x for x in (t or "").split("\n") if x] for d, t in docs}
    first = {}
    for d in sorted(lines):
        for p in range(len(lines[d]) - 1):
            first.setdefault((lines[d][p], lines[d][p + 1]), (d, p))
    out = {}
    for d, own in lines.items():
        drop = set()
        for p in range(len(own) - 1):
            f = first[own[p], own[p + 1]]
            if f != (d, p):
                drop |= {p + 1} if f == (d, p - 1) else {p, p + 1}
        out[d] = [x for p, x in enumerate(own) if p not in drop]
    return out


@pytest.mark.parametrize("broadcast", [16 << 20, -1])
def test_every_repeated_run_of_two_lines_goes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(store, "BROADCAST_BYTES", broadcast)
    r = random.Random(4)
    passages = {n: [f"passage {n} {k} " + line(r) for k in range(n)] for n in (2, 3, 4, 5, 6, 10)}
    own = lambda i, k: [f"own {i} {k} {j} " + line(r) for j in range(r.randint(1, 4))]
    docs = [(100 * n + i, "\n".join(own(100 * n + i, 0) + p + own(100 * n + i, 1))) for n, p in passages.items() for i in range(6)]
    docs += [(5000, docs[0][1]), (5001, docs[20][1]), (5002, "x\n" * 5), (5003, "a\n\n" + "\n".join(passages[3])), (5004, "\n".join(passages[2] + passages[6])), (5005, None), (5006, "one")]
    docs += [(6000 + d, "\n".join((t or "").split("\n") * 2)) for d, t in corpus() if d is not None and d < 30]
    got = {x.doc_id: x for x in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), whole_runs=True).collect()}
    want = by_pairs(docs)
    for d, t in docs:
        assert [x for x in (got[d].text or "").split("\n") if x] == want[d], d
        assert got[d].n_lines - got[d].n_removed == len(want[d])
    for n, p in passages.items():
        assert sum(x in (got[100 * n + i].text) for i in range(6) for x in p) == n
    assert got[5000].text == "" and got[5001].text == "" and got[5002].text == "x\nx" and got[5003].text == "a\n" and got[5004].text == ""


def test_blank_lines_that_stay(spark):
    """Only the line end before what is cut from a text's end goes with it; blank lines after a line that stays, stay."""
    docs = [(1, "a long line\nb long line"), (2, "x\n\n\na long line\nb long line"), (3, "a long line\nb long line\n\ny\n\n"), (4, "z\na long line\nb long line\n\n")]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), whole_runs=True).collect()}
    assert got == {1: docs[0][1], 2: "x\n\n", 3: "y\n\n", 4: "z"}
