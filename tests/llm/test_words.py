import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import words as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .\n\té你\x00-", max_size=30)), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for kind, pattern in ((W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (W.NONSPACE, r"[^\x20\x09-\x0D]+")):
        data, offsets = W.utf8(pa.array(texts, pa.string()))
        w = W.words(data, offsets, kind)
        for i, text in enumerate(texts):
            want = re.findall(pattern, (text or "").translate(LOWER))
            a, b = w.first[i], w.first[i + 1]
            assert w.bytes_of(a, b) == " ".join(want).encode()
            assert b - a == len(want)


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data, offsets = W.utf8(pa.array(["Alpha beta gamma", "x " * 999 + "alpha BETA gamma", None]))
    w = W.words(data, offsets, W.ALNUM)
    assert (w.hash[:3] == w.hash[-3:]).all() and len(set(w.hash.tolist())) == 4
    assert W.grams(w.hash, 3)[0] == W.grams(w.hash, 3)[-1]
    assert len(W.grams(w.hash[:2], 3)) == 0


def test_long_rows_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    data, offsets = W.utf8(pa.array([text, "y"]))
    whole = W.words(data, offsets, W.ALNUM)
    monkeypatch.setattr(W, "CHUNK_BYTES", 100)
    parts = W.words(data, offsets, W.ALNUM)
    assert (whole.hash == parts.hash).all() and (whole.first == parts.first).all()
    one = W.words(*W.utf8(pa.array(["z" * 5000])), W.ALNUM)
    assert len(one.hash) == 1


def test_row_groups_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 101, 101])
    groups = list(W.row_groups(offsets, 10))
    assert [x for a, b in groups for x in range(a, b)] == [0, 1, 2, 3, 4]
