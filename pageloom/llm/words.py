"""Vectorised words and n-gram hashes over Arrow string columns.

Both word classes used here treat every byte of a multi-byte UTF-8 character as
a word byte, so words can be cut on bytes without decoding. Hashes are 64-bit;
callers that need certainty compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MASK64 = (1 << 64) - 1
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PI, _QI = pow(_P, -1, 1 << 64), pow(_Q, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
#: Words of more bytes are hashed by xxh3 where equal hashes should mean equal words: sums of powers modulo 2**64 can be made to agree on them.
LONG_WORD = 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = mix(LOWER.astype(np.uint64) + np.uint64(0xA5A5))

#: Words of digits, ASCII letters and all that is not ASCII (upper case is lowered first).
ALNUM = np.ones(256, dtype=bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Words of all but ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2**64 for i < n, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_groups(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@dataclass
class Words:
    """Words of some rows: byte ranges in data, hashes, and each row's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # rows + 1

    def bytes_of(self, a: int, b: int) -> bytes:
        """Words a to b, lower-cased and joined by one space."""
        return b" ".join(LOWER[self.data[s:e]].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))


def _piece(data: np.ndarray, lo: int, hi: int, breaks: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = data[lo:hi]
    is_word = kind[part]
    before = np.empty(len(part) + 1, dtype=bool)  # is the byte before i in a word, and in the same row?
    before[0] = False
    before[1:] = is_word
    after = before.copy()
    inner = breaks[(breaks > lo) & (breaks < hi)] - lo
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before[:-1])
    ends_here = after[1:].copy()
    nxt = np.zeros(len(part), dtype=bool)
    nxt[:-1] = is_word[1:]
    nxt[inner - 1] = False
    ends = np.flatnonzero(ends_here & ~nxt) + 1
    sums = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[part] * powers(_P, len(part)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_PI, len(part) + 1)[starts]
    return starts + lo, ends + lo, mix(h + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, *, sound: bool = False) -> Words:
    """Words of the rows between the offsets; long rows are read in pieces cut between words. sound: xxh3 for LONG_WORDs."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    out: list[tuple[np.ndarray, ...]] = []
    while lo < hi:
        cut = min(hi, lo + CHUNK_BYTES)
        while cut < hi:
            gap = np.flatnonzero(~kind[data[max(lo, cut - 4096) : cut]])
            if len(gap):
                cut = max(lo, cut - 4096) + int(gap[-1]) + 1
                break
            cut = min(hi, cut + CHUNK_BYTES)
        out.append(_piece(data, lo, cut, offsets, kind))
        lo = cut
    start, end, h = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if sound:
        for i in np.flatnonzero(end - start > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(LOWER[data[start[i] : end[i]]].tobytes())
    return Words(data, start, end, h, np.searchsorted(start, offsets))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes, rows ignored: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=sums[1:])
    return mix((sums[n:] - sums[: len(sums) - n]) * powers(_QI, len(h))[: len(h) - n + 1] + np.uint64(n))
