import gzip
import hashlib

import pytest

from pageloom.llm import warc as A
from pageloom.llm.store import Scratch


def member(*a):
    return A.record(*a)


def test_record_and_framing():
    data = b"".join([member(1, "http://a b\r\nx", b"<p>\r\n\r\nWARC/1.1</p>", None), member(2, None, b"", None), member(3, "u", b"body", 1)])
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3  # standard gzip members
    for size in (1, 7, 1 << 16):
        chunks = iter([data[i : i + size] for i in range(0, len(data), size)])
        got = [A.parse(m) for m in A.members(chunks)]
        assert [(g["page_id"], g["record_type"], g["refers_to"], g["payload_bytes"]) for g in got] == [(1, "response", None, 19), (2, "response", None, 0), (3, "revisit", 1, 4)]
        assert got[0]["url"] == "http://a%20b%0D%0Ax" and got[1]["url"] is None
    assert list(A.members(iter([]))) == []


def test_broken_archives():
    good = member(1, "u", b"text", None)
    with pytest.raises(ValueError, match="ends within"):
        list(A.members(iter([good[:-9]])))
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"text", b"tixt"), plain[:-1], plain + b"x", b"x" + plain[3:], plain.replace(b"Block-Digest", b"Block-Diggst")):
        with pytest.raises(ValueError):
            A.parse(bad)
    swapped = plain.replace(A.digest(b"text").encode(), A.digest(b"tixt").encode())
    with pytest.raises(ValueError, match="payload"):
        A.parse(swapped)


def brute(pages, least=0):
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        f = first.get(html or "")
        revisit = len(raw) >= least and f is not None and page != f
        out.append((page, len(raw), A.digest(raw), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


PAGES = [(5, "u", "<p>same</p>"), (3, "v", "<p>same</p>"), (3, "v", "<p>same</p>"), (9, None, None), (8, "w", ""), (None, "x", "<p>same</p>"), (None, "y", "alone"), (7, "z", "long é " * 9000), (6, "z", "long é " * 9000)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, first string").repartition(3)
    rows = A.classify(pages, Scratch(spark, "t"), min_revisit=least)
    got = A.read_archives(A.write_archives(rows, archive_bytes=500))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == brute(PAGES, least)
    assert A.read_archives(A.write_archives(A.classify(pages.limit(0), Scratch(spark, "t")))).count() == 0


def test_digest():
    assert A.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20
