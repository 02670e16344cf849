import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import bpe as B

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(P.path(B.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


def same(library, text):
    ours = B.tokenizer(None)
    want = library.encode(text, add_special_tokens=False).ids
    got = ours.encode(text)
    assert got.tolist() == want
    assert ours.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_made_texts(library):
    r = random.Random(1)
    parts = ["the", "'s", "'re", "'", "<|endoftext|>", "<|startoftext|>", "<|", " ", "İ", "Σ", "é", "é", "\x1c", "\x85", "　", "你", "½", "!", "!!", "\n", "abc", "THE", "🙂", "ing", "​", "_", "^", "aaaa", "\x00", "12", "ǆ"]
    for _ in range(800):
        same(library, "".join(r.choice(parts) for _ in range(r.randint(0, 25))))
    for text in ("", " ", "a" * 3000, "!" * 2000, "ab" * 2000, "thinthonation" * 300):
        same(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0, max_codepoint=0x2FF), max_size=40))
def test_any_text(library, text):
    same(library, text)


def test_corpus(library):
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist():
        same(library, text)


def merges(bpe, piece):
    """Merging by rank, pair by pair."""
    raw = piece.encode()
    s = [bpe.chars[x] for x in raw[:-1]] + [bpe.chars[raw[-1]] + "</w>"]
    import json

    vocab = json.load(open(P.path(B.TOKENIZER)))["model"]["vocab"]
    ids = [vocab[x] for x in s]
    while True:
        best = min(((bpe.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in bpe.pairs), default=None)
        if best is None:
            return ids
        i = best[1]
        merged = next(t for t in range(len(bpe.rank)) if bpe.rank[t] == best[0])
        ids[i : i + 2] = [merged]


def test_backtracking_is_merging():
    bpe = B.tokenizer(None)
    r = random.Random(4)
    for _ in range(40):
        piece = "".join(r.choice("thainoers") for _ in range(r.randint(1, 14)))
        assert bpe.encode_piece(piece) == merges(bpe, piece)


def test_offset_table():
    t = B.OffsetTable([b"", b"ab", b"c", b"\xc3\xa9"])
    assert t.gather(np.array([1, 0, 3, 1, 2], np.int32)).tobytes() == b"ab\xc3\xa9abc"
    assert t.gather(np.zeros(0, np.int32)).tobytes() == b""


def test_frames(spark, library, tmp_path):
    texts = [None, "", "Hello   wörld", "Hello   wörld", "long " * 40000]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in B.digests(B.encode_decode(frame)).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[i]) == (i, len(want), sha(" ".join(map(str, want))), sha(library.decode(want, skip_special_tokens=False)))
    assert B.encode_decode(frame.limit(0)).count() == 0
