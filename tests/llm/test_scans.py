"""Personal data and secrets: patterns against plain regular expressions, the field against its labels."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import personal, secrets
from pageloom.llm.crf import Crf, Tokens, _marginals, viterbi
from pageloom.llm.words import utf8


def plain_personal(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        total = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], personal.BASE.index(s[2])))


def plain_secrets(text):
    key = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(*m.span(), "assign") for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], secrets.BASE.index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "B9", "@", ".", "-", "+", "1", "25", "255", "256", "007", "4111111111111111", " ", "(", ")", "é", "_", "\n", "4539 1488 0343 6467", "x.y@z-1.co.uk", "1.2.3.4", "+1 (555) 123-4567"]), max_size=14).map("".join))
def test_personal_patterns(text):
    assert personal.base_spans(text) == plain_personal(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "secret", "tOken", "apikey", "API_KEY", "api__key", "=", ":", " ", "  ", '"', "'", "abcdef12", "xyz", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "DEADBEEF", "é", "K", "toſken", "\n", "."]), max_size=14).map("".join))
def test_secret_patterns(text):
    assert secrets.base_spans(text) == plain_secrets(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        personal.base_spans(text)
    for text in ("f" * 31 + "g", "token " * 50_000 + "=", "AKIA" * 50_000, "secret" + " " * 200_000):
        secrets.base_spans(text * 2)


@pytest.mark.parametrize("module", [personal, secrets])
def test_held_out_labels(module):
    """The field finds spans of sentences that it didn't learn from, and little else."""
    crf = module.model()
    rows = module.labelled_table(seed=99, n=400)
    data, offsets = utf8(pa.array([t for t, _ in rows]))
    found = set()
    for row, a, b, _ in crf.spans(Tokens(data, offsets)):
        found.add((row, a - int(offsets[row]), b - int(offsets[row])))
    want = {(i, len(t[:a].encode()), len(t[:b].encode())) for i, (t, spans) in enumerate(rows) for a, b, _ in spans}
    touch = lambda x, other: any(r == x[0] and a < x[2] and b > x[1] for r, a, b in other)
    assert sum(touch(x, found) for x in want) / len(want) > 0.9
    assert sum(touch(x, want) for x in found) / len(found) > 0.95


def test_viterbi_is_the_best_of_all_paths():
    import itertools

    r = np.random.default_rng(1)
    e, trans, start = (r.normal(size=x).astype(np.float32) for x in ((14, 3), (3, 3), (3,)))
    starts, sizes = np.array([0, 2, 7, 13]), np.array([2, 5, 6, 1])
    labels, place, order = viterbi(e, starts, sizes, trans, start)
    for p, k in zip(place, order, strict=True):
        s, n = starts[k], sizes[k]
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda y: start[y[0]] + sum(e[s + i, y[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert labels[p : p + n].tolist() == list(best)


def test_long_lines_are_tagged_by_their_best_path():
    crf = personal.model()
    r = random.Random(5)
    words = [personal._filler(r).strip() for _ in range(900)]
    for at in range(50, 900, 37):
        words[at : at + 3] = ["+1", "(555)", "123-4567"] if at % 2 else ["x", "4485123412341231", "y"]
    tokens = Tokens(*utf8(pa.array([" ".join(words), "short line"])))
    got, n = crf.tag(tokens), tokens.first[1]
    has_left, has_right = np.ones(len(got), bool), np.ones(len(got), bool)
    has_left[[0, n]] = has_right[[n - 1, -1]] = False
    e = crf._emissions(crf._ids(tokens), tokens.file, crf.weights, has_left, has_right).astype(float)
    score, back = e[0] + crf.start, []
    for row in e[1:n]:
        ways = score[:, None] + crf.trans
        back.append(ways.argmax(0))
        score = ways.max(0) + row
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    assert got[:n].tolist() == path[::-1] and (got > 0).sum() > 40
    assert crf.tag(Tokens(*utf8(pa.array(["", None], pa.string())))).size == 0


@pytest.mark.parametrize(("module", "query", "plain"), [(personal, personal.op5_personal, plain_personal), (secrets, secrets.op7_secrets, plain_secrets)])
def test_queries(spark, tmp_path, module, query, plain):
    texts = [None, "", "é mail a.b@c.org or 10.0.0.255, +1 (555) 123-4567!", "token = 0123456789abcdef0123456789abcdef", "card 4111 1111 1111 1111 AKIAABCDEFGH1234", "word " * 50000 + "a@b.cd"]
    texts += [texts[2]]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        want = plain(text or "")
        assert [got[i][f"n_{k}"] for k in module.BASE] == [sum(s[2] == k for s in want) for k in module.BASE]
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("crf-")] == [x for x in listed.split(",") if x]
    assert got[2].spans == got[6].spans and got[0].spans == ""


def test_corpus_without_planted_data_stays_clean():
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if not re.search(r"[0-9@=]", t)]
    data, offsets = utf8(pa.array(texts))
    for crf, least in ((personal.model(), 6), (secrets.model(), 12)):
        hit = {row for row, a, b, _ in crf.spans(Tokens(data, offsets)) if b - a >= least}
        assert len(hit) / len(texts) < 0.01


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(3)
    e, trans, start = r.normal(size=(7, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    grid = np.array([[0, 1, 2, 3], [4, 5, 6, -1]])
    p, edges, starts = _marginals(e, grid, grid >= 0, trans, start)
    want_p, want_edges, want_starts = np.zeros((7, 3)), np.zeros((3, 3)), np.zeros(3)
    for row in ([0, 1, 2, 3], [4, 5, 6]):
        paths = list(itertools.product(range(3), repeat=len(row)))
        weight = np.array([np.exp(start[q[0]] + sum(e[i, x] for i, x in zip(row, q, strict=True)) + sum(trans[x, y] for x, y in itertools.pairwise(q))) for q in paths])
        for q, share in zip(paths, weight / weight.sum(), strict=True):
            want_starts[q[0]] += share
            for i, x in zip(row, q, strict=True):
                want_p[i, x] += share
            for x, y in itertools.pairwise(q):
                want_edges[x, y] += share
    assert np.allclose(p, want_p) and np.allclose(edges, want_edges) and np.allclose(starts, want_starts)
