"""Column functions on text: white space, censuses of characters, hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters, one by one.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
REPLACEMENT = "�"


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, WS, "")


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(WS_CHARS))


_WS = re.compile(f"[{WS_CHARS}]+")
_CJK = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\u3040-\u30ff\uac00-\ud7af]")
#: Where white space as Python has it is other than WS_CHARS.
_OTHER = "\x1c\x1d\x1e\x1f\x85\ufeff"


def bare(text: str) -> str:
    """Without white space."""
    return _WS.sub("", text) if any(x in text for x in _OTHER) else "".join(text.split())


#: Capital letters that Spark's lower knows and str.lower doesn't yet (Unicode 16).
_NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {x: x + 0x20 for x in range(0x10D50, 0x10D66)}
_NEW = re.compile(f"[{''.join(map(chr, _NEWER))}]")


def lowered(text: str) -> str:
    """In lower case, as Spark has it."""
    return (text.translate(_NEWER) if not text.isascii() and _NEW.search(text) else text).lower()


#: Lower case of the 256 characters of Latin-1, and which of them are white space.
_LOWER = bytes(ord(chr(x).lower()) for x in range(256))
_WS_BYTES = bytes(ord(x) for x in WS_CHARS if ord(x) < 256)


def collapsed(text: str) -> tuple[str, tuple[int, int, int, int]]:
    """A text without white space, in lower case, and its census."""
    try:
        short = text.encode("latin-1").translate(_LOWER, _WS_BYTES).decode("latin-1")
    except UnicodeEncodeError:
        short = bare(text)
        return lowered(short), counts(text, short)
    return short, (len(short), len(text) - len(short), 0, 0)


_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[list(_WS_BYTES)] = True


def all_collapsed(texts: Sequence[str | None]) -> tuple[list[str | None], np.ndarray]:
    """collapsed of each text: null stays, and has a census of zeros. Those in ASCII are read together."""
    out, found = list(texts), np.zeros((len(texts), 4), np.int32)
    plain = [i for i, t in enumerate(texts) if t is not None and t.isascii()]
    codes = "".join([texts[i] for i in plain]).encode("ascii")
    if codes:
        sizes = np.fromiter((len(texts[i]) for i in plain), np.int64, len(plain))
        spaces = np.concatenate([[0], np.cumsum(_IS_WS[np.frombuffer(codes, np.uint8)])])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        there = np.diff(spaces[upto])
        found[plain, 0], found[plain, 1] = sizes - there, there
        left, ends = codes.translate(_LOWER, _WS_BYTES).decode("ascii"), np.cumsum(sizes - there).tolist()
        for i, begin, end in zip(plain, [0, *ends], ends, strict=False):
            out[i] = left[begin:end]
    for i, t in enumerate(texts):
        if t is not None and not t.isascii():
            out[i], found[i] = collapsed(t)
    return out, found


@lru_cache(maxsize=1)
def _bare():
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else bare(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def collapse_ws(text: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(_bare()(text))


def has_text(text: Column) -> Column:
    # from the left only: that ends at the first character which isn't white space
    return F.coalesce(F.ltrim(text, F.lit(WS_CHARS)) != "", F.lit(False))


#: What a census counts.
COUNTS = ("chars", "spaces", "cjk", "replaced")


def counts(text: str | None, without: str | None = None) -> tuple[int, int, int, int]:
    """A text's census. without: the text without white space, where that is there already."""
    if not text:
        return 0, 0, 0, 0
    n = len(bare(text) if without is None else without)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return n, len(text) - n, len(_CJK.findall(text)), text.count(REPLACEMENT)
    return n, len(text) - n, 0, 0


@lru_cache(maxsize=1)
def _census():
    def run(texts: pa.Array) -> pa.Array:
        found = [counts(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in range(4)], list(COUNTS))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<{','.join(f'{x}:int' for x in COUNTS)}>")


def census(text: Column) -> dict[str, Column]:
    """Characters, white space, CJK characters and replacement characters of a text; null has none."""
    found = _census()(text)
    return {x: found[x] for x in COUNTS}


def source_hash(page: Column, text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of page:text."""
    return F.substring(F.sha2(F.concat(page.cast("string"), F.lit(":"), text), 256), 1, 16)
