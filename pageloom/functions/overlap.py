"""Greedy folds: keep a text or a box unless it overlaps one kept before.

What is dropped must not drop others, so a fold goes in order within a page or
document. Rows are dealt by group and sorted, and an Arrow UDF that keeps its
state from batch to batch says of each row whether it stays: no group is ever
brought into one row, and only what is compared goes to Python. Indexes keep
each step's work to its own size: texts look up their rarest windows, boxes the
cells around them. Windows of a large group move to sorted runs in files, so
memory is bounded by `MOST_WINDOWS`, a text, the group's different texts under a
window, and 8 bytes for each text kept; of boxes some 300 bytes each are kept.

A step that fails marks its row with an error and ends its group; the row stays,
so that the error is seen.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.runs import Runs, Texts
from pageloom.functions.text import COUNTS, WS, all_collapsed, lowered, strip_ws

WINDOW, THRESHOLD = 8, 0.5
#: Windows that a group has in memory.
MOST_WINDOWS = 1 << 18
#: Characters of texts whose windows are hashed together, and of a group that has an index instead.
PIECE, LARGE = 1 << 15, 1 << 20


class Kept:
    """Texts kept so far: the places of their windows, and which of the short texts (under a window) that may come lie in them.

    Windows are in a dictionary until there are `most` of them; then they go, as
    64-bit hashes, to sorted runs. What is found there is checked in the text itself.
    """

    def __init__(self, window: int = WINDOW, threshold: float = THRESHOLD, short: Iterable[str] | None = None, most: int = MOST_WINDOWS):
        self.window, self.threshold, self.most = window, threshold, most
        self.any = False
        self.texts: set[str] = set()
        self.windows: dict[str, list[int]] = {}
        self.recent: list[str] = []
        self.runs, self.stored = Runs(), None
        #: short texts that may be asked for, None: any; of these, those in a kept text
        self.short = None if short is None else set(short)
        self.lengths = range(window) if self.short is None else sorted({len(x) for x in self.short})
        self.inside: set[str] = set()

    @property
    def moved(self) -> int:
        """Texts whose windows are in runs."""
        return 0 if self.stored is None else len(self.stored)

    def add(self, text: str) -> None:
        self.any = True
        if text in self.texts:
            return
        k, w = self.moved + len(self.recent), self.window
        self.texts.add(text)
        self.recent.append(text)
        for first in range(0, max(len(text) - w + 1, 0), self.most):
            for at in {text[i : i + w] for i in range(first, min(first + self.most, len(text) - w + 1))}:
                there = self.windows.setdefault(at, [])
                if not there or there[-1] != k:
                    there.append(k)
            if len(self.windows) >= self.most:
                self._move()
        for n in self.lengths:
            parts = {text[i : i + n] for i in range(len(text) - n + 1)}
            self.inside |= parts if self.short is None else parts & self.short
        if len(self.texts) >= self.most:
            self._move()

    def _move(self) -> None:
        self.stored = Texts() if self.stored is None else self.stored
        for text in self.recent:
            self.stored.add(text)
        n = sum(map(len, self.windows.values()))
        keys = np.repeat(np.fromiter(map(hash, self.windows), np.int64, len(self.windows)), np.fromiter(map(len, self.windows.values()), np.int64, len(self.windows)))
        self.runs.add(keys, np.fromiter((k for there in self.windows.values() for k in there), np.int64, n))
        self.texts, self.windows, self.recent = set(), {}, []

    def _places(self, counts: Counter) -> list[tuple[int, int, Sequence[int]]]:
        """How many kept texts have a window, how often the new text has it, and which those are; the rarest first."""
        if self.stored is None:
            found = ((len(there), n, there) for x, n in counts.items() if (there := self.windows.get(x)))
        else:
            found = []
            for (x, n), old in zip(counts.items(), self.runs.find(np.fromiter(map(hash, counts), np.int64, len(counts))), strict=True):
                new = self.windows.get(x, [])
                there = np.concatenate([old, new]).astype(np.int64) if len(new) else old
                if len(there):
                    there = there[np.concatenate([[True], there[1:] != there[:-1]])]
                    found.append((len(there), n, there))
        return sorted(found, key=lambda x: x[:2])

    def _surely(self, k: int, counts: Counter, need: float) -> bool:
        """Does text k, found by hashes if it is a stored one, have so many of the windows?"""
        if k >= self.moved:
            return True
        text = self.stored[k]
        return sum(n for x, n in counts.items() if x in text) >= need

    def overlaps(self, text: str) -> bool:
        if not self.any:
            return False
        total = len(text) - self.window + 1
        if total < 1:
            return text in self.inside
        need = self.threshold * total
        counts = Counter(text[i : i + self.window] for i in range(total))
        known = self._places(counts)
        left = sum(n for _, n, _ in known)
        if left < need:
            return False
        wrong: set[int] = set()
        for k in {int(k) for _, _, there in known[:2] for k in (there[0], there[-1])}:  # where much is alike, one of these will do
            if sum(n for _, n, there in known if (at := bisect_left(there, k)) < len(there) and there[at] == k) >= need:
                if self._surely(k, counts, need):
                    return True
                wrong.add(k)
        hits: dict[int, int] = defaultdict(int)
        for _, n, there in known:  # the rarest first: a text that is only in what comes later can't reach the threshold once too little is left
            if left >= need:
                for k in map(int, there):
                    hits[k] += n
                    if hits[k] >= need and k not in wrong:
                        if self._surely(k, counts, need):
                            return True
                        wrong.add(k)
            else:
                for k in list(hits):
                    if hits[k] + left < need or k in wrong:
                        del hits[k]
                    elif (at := bisect_left(there, k)) < len(there) and there[at] == k:
                        hits[k] += n
                        if hits[k] >= need:
                            if self._surely(k, counts, need):
                                return True
                            wrong.add(k)
                if not hits:
                    return False
            left -= n
        return False


def keep_flags(texts, given, **how) -> list[bool]:
    """For texts in order: is it kept? given: kept whatever it overlaps."""
    kept, out = Kept(short=(t for t in texts if len(t) < WINDOW), **how), []
    for text, fixed in zip(texts, given, strict=True):
        keep = bool(fixed) or not kept.overlaps(text)
        if keep:
            kept.add(text)
        out.append(keep)
    return out


class Boxes:
    """Boxes kept so far, in cells by the logarithms of their sizes and by their places.

    Boxes that overlap by `threshold` or more of their union do so along each
    axis too: their sizes differ by at most that factor, and their places by
    less than a fixed share of the size. So only the cells around a box matter,
    and few kept boxes fit in one. Cells are those of a threshold of at most
    WIDEST; under LEAST they would hold nearly all boxes, and all are compared.
    A threshold of 0 or less is met by any two boxes, also apart or without area.
    The first FEW boxes are just compared; with more than that all go into cells.
    """

    LEAST, WIDEST, FEW = 0.02, 0.98, 24

    def __init__(self, threshold: float):
        self.threshold = threshold
        near = min(max(threshold, self.LEAST), self.WIDEST)
        self.base = -math.log(near)
        self.share = (1 - near) / near
        #: boxes that all are compared with, None: they are in cells
        self.every: list[tuple] | None = []
        self.cells: dict[tuple, list[tuple[float, float, float, float]]] = defaultdict(list)

    def _spot(self, at: float, band: int) -> int:
        return math.floor(at / (math.exp((band + 1) * self.base) * self.share))

    def add(self, system, x: float, y: float, w: float, h: float) -> None:
        if self.every is None:
            self._place(system, x, y, w, h)
        elif self.threshold > 0 or not self.every:
            self.every.append((system, x, y, w, h))
            if len(self.every) > self.FEW and self.threshold >= self.LEAST:
                for box in self.every:
                    self._place(*box)
                self.every = None

    def _place(self, system, x: float, y: float, w: float, h: float) -> None:
        if w > 0 and h > 0:
            a, b = math.floor(math.log(w) / self.base), math.floor(math.log(h) / self.base)
            self.cells[system, a, b, self._spot(x, a), self._spot(y, b)].append((x, y, w, h))

    def overlaps(self, system, x: float, y: float, w: float, h: float) -> bool:
        if self.threshold <= 0:
            return bool(self.every)
        if not (w > 0 and h > 0):
            return False
        if self.every is not None:
            right, top = x + w, y + h
            return any(x < o[1] + o[3] and o[1] < right and y < o[2] + o[4] and o[2] < top and o[0] == system and self._iou(o[1:], x, y, w, h) >= self.threshold for o in self.every)
        dx, dy = w * self.share * 1.001, h * self.share * 1.001
        bands = lambda size: range(math.floor(math.log(size * 0.999) / self.base) - 1, math.floor(math.log(size * 1.001) / self.base) + 2)
        for a in bands(w):
            xs = range(self._spot(x - dx, a), self._spot(x + dx, a) + 1)
            for b in bands(h):
                for i in xs:
                    for j in range(self._spot(y - dy, b), self._spot(y + dy, b) + 1):
                        for other in self.cells.get((system, a, b, i, j), ()):
                            if self._iou(other, x, y, w, h) >= self.threshold:
                                return True
        return False

    @staticmethod
    def _iou(o: tuple[float, float, float, float], x: float, y: float, w: float, h: float) -> float:
        common = max(0.0, min(o[0] + o[2], x + w) - max(o[0], x)) * max(0.0, min(o[1] + o[3], y + h) - max(o[1], y))
        union = o[2] * o[3] + w * h - common
        return common / union if common > 0 and union > 0 else 0.0


class Blocks:
    """Hashes seen and boxes kept on a page; a block dropped for its box doesn't count as seen."""

    def __init__(self, threshold: float):
        self.seen: set = set()
        self.boxes = Boxes(threshold)

    def step(self, digest, *box) -> bool:
        box = None if None in box[1:] or any(x != x for x in box[1:]) else box
        if digest in self.seen or (box is not None and self.boxes.overlaps(*box)):
            return False
        if digest is not None:
            self.seen.add(digest)
        if box is not None:
            self.boxes.add(*box)
        return True


FOLDED = "struct<keep:boolean,error:string>"


def _folded(batches: Iterator[tuple[pd.Series, ...]], begin: Callable, step: Callable) -> Iterator[pd.DataFrame]:
    """The first column tells where groups begin, the second which rows take part; the state goes on from batch to batch, and a failed group has none."""
    state, broken = None, False
    for new, takes, *columns in batches:
        keep, errors = np.ones(len(new), dtype=bool), [None] * len(new)
        new, takes = new.to_numpy(bool), takes.to_numpy(bool)
        due = np.flatnonzero(new | takes)
        for i, row in zip(due.tolist(), zip(*(c.to_numpy()[due].tolist() for c in columns), strict=True), strict=True):
            try:
                if new[i]:
                    state, broken = None, False
                    state = begin(*row)
                if takes[i] and not broken:
                    keep[i] = step(state, *row)
            except Exception as e:  # noqa: BLE001
                broken, errors[i] = True, str(e) or type(e).__name__
        yield pd.DataFrame({"keep": keep, "error": pd.Series(errors, dtype=object)})


def _fold(begin: Callable, step: Callable):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        return _folded(batches, begin, step)

    # what it says of a row depends on those before it: no filter may go below it
    return F.pandas_udf(run, FOLDED).asNondeterministic()


class Lately:
    """A group's kept texts: as they are while no later one has much in common with them, in an index of windows from then on."""

    #: comparisons with each kept text, and characters times characters of one, before there is an index
    FEW, SMALL = 8, 1 << 20

    def __init__(self, short: Iterable[str] | None):
        self.short = frozenset(short if short is not None else ())
        self.lengths = sorted({len(x) for x in self.short})
        self.texts: list[str] = []
        self.same: set[str] = set()
        self.size = self.asked = 0
        #: short texts that lie in one kept, once many were asked for; windows need no index for these
        self.inside: set[str] | None = None
        self.index: Kept | None = None

    def _indexed(self) -> Kept:
        if self.index is None:
            self.index = Kept(short=self.short)
            for text in self.texts:
                self.index.add(text)
            self.texts, self.same, self.inside = [], set(), None
        return self.index

    def _within(self, text: str) -> set[str]:
        """The short texts that lie in a text."""
        return {part for n in self.lengths for i in range(len(text) - n + 1) if (part := text[i : i + n]) in self.short}

    def _overlaps(self, text: str) -> bool:
        if self.index is None:
            if text in self.same:
                return True
            self.asked += 1
            if self.asked <= self.FEW and len(text) * self.size <= self.SMALL:
                windows = [text[i : i + WINDOW] for i in range(len(text) - WINDOW + 1)]
                need = THRESHOLD * len(windows)
                return any(text in x if not windows else sum(w in x for w in windows) >= need for x in self.texts)
            if len(text) < WINDOW:
                if self.inside is None:
                    self.inside = set().union(*map(self._within, self.texts))
                return text in self.inside
        return self._indexed().overlaps(text)

    def step(self, text: str, given: bool, fresh: bool) -> bool:
        if not (given or fresh) and self._overlaps(text):
            return False
        if self.index is not None:
            self.index.add(text)
        elif text not in self.same:
            self.same.add(text)
            self.texts.append(text)
            self.size += len(text)
            if self.inside is not None:
                self.inside |= self._within(text)
            if self.size > MOST_WINDOWS:
                self._indexed()
        return True


@lru_cache(maxsize=2)
def _slots(bits: int) -> np.ndarray:
    return np.empty(1 << bits, np.int32)


def _windows(text: str) -> np.ndarray:
    """A number for each window; equal windows have equal ones."""
    try:  # eight bytes are a number
        codes = text.encode("latin-1")
        return np.ndarray((len(codes) - WINDOW + 1,), np.uint64, codes, 0, (1,))
    except UnicodeEncodeError:
        rolled, n = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 1
        while n < WINDOW:
            rolled, n = rolled[:-n] * np.uint64(0x9E3779B97F4A7C15) + rolled[n:], 2 * n
        return rolled


#: Pairs of equal windows that are told apart at once, and characters that short texts are looked for in; with more, the steps' index does it.
MOST_PAIRS, MOST_READ = 1 << 22, 1 << 26
#: Of windows this share is looked for among few others.
FEW_ASK = 0.25


class _Piece:
    """Whole groups of texts, in order, and the windows in them as numbers; equal windows of a group have equal ones."""

    def __init__(self, texts: Sequence[str], groups: np.ndarray):
        self.texts, self.groups = texts, groups
        self.joined = "".join(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.totals = np.maximum(self.sizes - WINDOW + 1, 0)
        self.keys = np.zeros(0, np.uint64)

    def hash(self) -> None:
        keys = _windows(self.joined) ^ np.repeat((self.groups.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), self.sizes)[: max(len(self.joined) - WINDOW + 1, 0)]
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0xFF51AFD7ED558CCD)
        self.keys = keys

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the windows of some texts, and whose they are."""
        totals = self.totals[which]
        owner = np.repeat(which, totals)
        return np.arange(len(owner)) - np.repeat(np.cumsum(totals) - totals - self.begins[which], totals), owner

    def like(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of windows that may equal one of those asked (all that do are there), and whose they are."""
        bits = np.uint64(64 - max(12, (16 * len(asked)).bit_length()))
        there = np.zeros(1 << (64 - int(bits)), dtype=bool)
        there[(self.keys[asked] >> bits).view(np.int64)] = True
        at = np.flatnonzero(there[(self.keys >> bits).view(np.int64)])
        owner = np.searchsorted(self.ends, at, "right")
        inside = at + WINDOW <= self.ends[owner]  # else it reaches into the next text
        return at[inside], owner[inside]

    def known(self, asking: np.ndarray) -> np.ndarray:
        """Of each asking text how many of its windows an earlier text of its group has, by hashes: what is alike counts, so it is never too few."""
        asked, owner = self.of(asking)
        at, whose = self.like(asked) if len(asked) < FEW_ASK * len(self.keys) else self.of(np.flatnonzero(self.totals))
        bits = max(16, (4 * len(at)).bit_length())
        first, shift = _slots(bits), np.uint64(64 - bits)
        first[(self.keys[at[::-1]] >> shift).view(np.int64)] = whose[::-1]  # of equal places the last one set stays: that of the earliest text
        known = first[(self.keys[asked] >> shift).view(np.int64)] != owner
        return np.bincount(owner[known], minlength=len(self.texts))[asking]

    def candidates(self, asking: np.ndarray) -> dict[int, list[int]] | None:
        """For each asking text the earlier ones of its group that seem to have enough of its windows; None: there is too much to compare."""
        asked, owner = self.of(asking)
        at, whose = self.like(asked)
        windows, which = np.unique(self.keys[asked], return_inverse=True)
        there = np.minimum(np.searchsorted(windows, self.keys[at]), len(windows) - 1)
        same = windows[there] == self.keys[at]
        pairs = np.unique(there[same] * len(self.texts) + whose[same])
        begin, end = np.searchsorted(pairs, which * len(self.texts)), np.searchsorted(pairs, (which + 1) * len(self.texts))
        n = end - begin
        if n.sum() > MOST_PAIRS:
            return None
        new = np.repeat(owner, n)
        old = pairs[np.arange(len(new)) - np.repeat(np.cumsum(n) - n - begin, n)] % len(self.texts)
        before = (old < new) & (self.groups[old] == self.groups[new])
        found, times = np.unique(new[before] * len(self.texts) + old[before], return_counts=True)
        new, old = np.divmod(found, len(self.texts))
        out: dict[int, list[int]] = {int(i): [] for i in asking}
        enough = times >= THRESHOLD * self.totals[new]
        for i, k in zip(new[enough].tolist(), old[enough].tolist(), strict=True):
            out[i].append(k)
        return out

    def holds(self, i: int, first: int, kept: np.ndarray) -> bool:
        """Does the short text i lie in a kept one before it, from the first of its group on?"""
        text, upto = self.texts[i], int(self.begins[i])
        if not text:
            return i > first  # the first of a group is kept
        at = self.joined.find(text, int(self.begins[first]), upto)
        while at >= 0:
            k = int(np.searchsorted(self.ends, at, "right"))
            inside = at + len(text) <= self.ends[k]
            if inside and kept[k] > 0:
                return True
            at = self.joined.find(text, int(self.ends[k]) if inside else at + 1, upto)
        return False


def _decided(texts: Sequence[str], groups: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Of each text of whole groups: 1 it is kept, -1 it is not, 0 the step has to say."""
    out = np.ones(len(texts), dtype=np.int8)
    if given.all():
        return out
    first: dict[tuple[int, str], int] = {}
    copies = np.fromiter((first.setdefault(x, i) != i for i, x in enumerate(zip(groups.tolist(), texts, strict=True))), bool, len(texts))
    out[copies & ~given] = -1  # the earlier one is kept, or what it overlaps is
    piece, asking = _Piece(texts, groups), ~(copies | given)
    long, short = np.flatnonzero(asking & (piece.totals > 0)), np.flatnonzero(asking & (piece.totals == 0))
    if len(long):
        piece.hash()
        long = long[piece.known(long) >= THRESHOLD * piece.totals[long]]
    if len(long):
        near = piece.candidates(long)
        for i in long.tolist():
            out[i] = 0 if near is None else -1 if any(out[k] > 0 and share_of_windows(texts[i], texts[k]) >= THRESHOLD for k in near[i]) else 1
    if len(short):
        begins = np.searchsorted(groups, groups[short])
        read = piece.begins[short] - piece.begins[begins]
        undecided = set(groups[out == 0].tolist()) if read.sum() <= MOST_READ else set(groups.tolist())
        for i, begin, group in zip(short.tolist(), begins.tolist(), groups[short].tolist(), strict=True):
            out[i] = 0 if group in undecided else -1 if piece.holds(i, begin, out) else 1
    return out


def _with_fresh(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[tuple[pd.Series, ...]]:
    """The batches and, for each text, what is told of it if its group begins in the batch: 1 it is kept, -1 it is not, 0 the step has to say.

    Of groups that end in the batch and leave nothing to the step, only the texts that go meet it.
    """
    for new, takes, short, text, given in batches:
        told = np.zeros(len(new), dtype=np.int8)
        group = np.cumsum(new.to_numpy(bool))
        fixed = given.fillna(False).to_numpy(bool)
        rows = np.flatnonzero(takes.to_numpy(bool) & (group > 0))
        texts = text.to_numpy(object)[rows]
        sizes, at = np.fromiter(map(len, texts), np.int64, len(texts)), group[rows]
        ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1 if len(rows) else []
        done, upto = np.cumsum(sizes), 0
        for i, end in enumerate(ends):
            # whole groups of PIECE characters together
            if i + 1 < len(ends) and done[ends[i + 1] - 1] - (done[upto - 1] if upto else 0) <= PIECE:
                continue
            if done[end - 1] - (done[upto - 1] if upto else 0) <= LARGE:
                told[rows[upto:end]] = _decided(texts[upto:end].tolist(), at[upto:end], fixed[rows[upto:end]])
            upto = end
        taken = takes.to_numpy(bool)
        # the last group may go on; the first one may go on from before
        open_ = np.bincount(group[taken & (told == 0)], minlength=group[-1] + 1 if len(group) else 1) > 0
        open_[[0, -1]] = True
        due = taken & (open_[group] | (told < 0))
        asked = (np.bincount(group[due], minlength=len(open_)) > 0) | open_
        yield new & asked[group], pd.Series(due), short, text, given, pd.Series(told)


def _begin_texts(short, text, given, told) -> Lately:
    return Lately(short)


def _step_texts(kept: Lately, short, text, given, told) -> bool:
    return told >= 0 and kept.step(text, bool(given), told > 0)


def _marked(rows: DataFrame, keys: Sequence[str], order: Sequence, **more: Column) -> DataFrame:
    """The rows dealt by group and in order, with __new where a group begins, and more columns."""
    return rows.withColumns({"__new": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1} | more)


def _kept(rows: DataFrame, fold, takes: Column, *columns: Column, more: Sequence[str] = ()) -> DataFrame:
    """Of marked rows those that the fold keeps, with column error (null: none) and those of census and at that are in more; what had an error before stays."""
    rows = rows.withColumn("__fold", fold(F.col("__new"), F.coalesce(takes, F.lit(False)), *columns))
    before = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    if "census" in more:
        rows = rows.withColumn("census", F.struct(*(F.col(f"__fold.{x}") for x in COUNTS)))
    if "at" in more:
        rows = rows.withColumn("at", F.col("__fold.at"))
    return rows.withColumn("error", F.coalesce(before, "__fold.error")).where(F.col("__fold.keep") | F.col("error").isNotNull()).drop("__new", "__fold")


#: A text with fewer characters than a window, white space left out.
_SHORT = f"^{WS}*+(?:[^{WS[1:]}{WS}*+){{0,{WINDOW - 1}}}+\\z"


def drop_overlapping_texts(rows: DataFrame, keys: Sequence[str], order: Sequence, text: Column, given: Column, *, takes: Column | None = None, place: Column | None = None, opens: Column | None = None, measured: bool = False) -> DataFrame:
    """Rows of each group in order, without those whose text overlaps one kept before; of texts counts what is left without white space, in lower case.

    Rows whose text is null or for which takes isn't true take no part. given: kept whatever it overlaps.
    place, opens: other rows stay only if one before them in the group opened their place (a number).
    measured: the rows get a census of their texts, taken or not, as these are read anyway.
    """
    takes = F.lit(True) if takes is None else F.coalesce(takes, F.lit(False))
    short = F.when(~given & text.rlike(_SHORT), strip_ws(text))
    # one window for both: of the whole group, but in the order of the rows
    rows = _marked(rows, keys, order, __short=F.collect_set(short).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    placed = [] if place is None else [F.coalesce(place.cast("long"), F.lit(-1 << 63)), F.coalesce(opens, F.lit(False))]
    return _kept(rows, _text_fold(measured, bool(placed)), takes & text.isNotNull(), F.when(F.col("__new"), F.col("__short")), text, given, *placed, more=["census"] if measured else []).drop("__short")


def _collapsed(batches: Iterator[tuple[pd.Series, ...]], measures: list | None) -> Iterator[tuple[pd.Series, ...]]:
    """The batches with texts as they are compared; measures gets the census of each batch."""
    for new, takes, short, text, given in batches:
        texts, found = all_collapsed(text.tolist())
        if measures is not None:
            measures.append(found)
        short = [None if x is None else [s for s in map(lowered, x) if len(s) < WINDOW] for x in short.tolist()]
        yield new, takes, pd.Series(short, dtype=object), pd.Series(texts, dtype=object), given


def _opened(batches: Iterator[tuple[pd.Series, ...]], closed: list) -> Iterator[tuple[pd.Series, ...]]:
    """The batches without place and opens; closed gets, of each, the rows whose place no row before opened. These take no part."""
    there: set[int] = set()
    for new, takes, short, text, given, place, opens in batches:
        begins, given_, opens = new.to_numpy(bool), given.fillna(False).to_numpy(bool), opens.to_numpy(bool)
        out, places = np.zeros(len(new), dtype=bool), place.tolist()
        for i in np.flatnonzero(begins | opens | ~given_).tolist():
            if begins[i]:
                there = set()
            if opens[i]:
                there.add(places[i])
            out[i] = not given_[i] and places[i] not in there
        closed.append(out)
        yield new, takes & ~out, short, text, given


@lru_cache(maxsize=4)
def _text_fold(measured: bool, placed: bool = False):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        closed: list = []
        measures: list | None = [] if measured else None
        for out in _folded(_with_fresh(_collapsed(_opened(batches, closed) if placed else batches, measures)), _begin_texts, _step_texts):
            if placed:
                out["keep"] &= ~closed.pop()
            if measures is not None:
                out[list(COUNTS)] = measures.pop()
            yield out

    return F.pandas_udf(run, FOLDED.replace(">", "".join(f",{x}:int" for x in COUNTS) + ">") if measured else FOLDED).asNondeterministic()


def _step_boxes(blocks: Blocks, *of) -> bool:
    return blocks.step(*of)


#: Rows of a group whose boxes are all compared with each other at once.
MOST_ABOVE = 64


def _with_apart(batches: Iterator[tuple[pd.Series, ...]], threshold: float) -> Iterator[tuple[pd.Series, ...]]:
    """The batches without the groups that need no step: they begin and end in the batch, and no two of their rows have the same hash or boxes that may overlap by the threshold."""
    for new, takes, digest, system, *sides in batches:
        if threshold <= 0:
            yield new, takes, digest, system, *sides
            continue
        group = np.cumsum(new.to_numpy(bool))
        asks = np.zeros(group[-1] + 1 if len(group) else 1, dtype=bool)
        asks[[0, -1]] = True
        rows = np.flatnonzero(takes.to_numpy(bool))
        at = group[rows]
        nth = np.arange(len(rows)) - np.searchsorted(at, at)
        asks[at[nth >= MOST_ABOVE]] = True
        codes = pd.factorize(digest.to_numpy(object)[rows])[0]  # null: -1
        x, y, w, h = (s.to_numpy(float)[rows] for s in sides)
        there = (w > 0) & (h > 0) & ~np.isnan(x) & ~np.isnan(y)
        with np.errstate(invalid="ignore", over="ignore"):
            right, top, area = x + w, y + h, w * h
            later = np.flatnonzero((nth > 0) & ~asks[at])
            for k in range(1, MOST_ABOVE):
                later = later[nth[later] >= k]
                if not len(later):
                    break
                o = later - k
                common = np.maximum(0, np.minimum(right[o], right[later]) - np.maximum(x[o], x[later])) * np.maximum(0, np.minimum(top[o], top[later]) - np.maximum(y[o], y[later]))
                # a little less than the threshold will do, and what isn't a number: the step decides
                near = there[o] & there[later] & ~((common <= 0) | (common < 0.999 * threshold * (area[o] + area[later] - common)))
                asks[at[later[near | ((codes[o] == codes[later]) & (codes[later] >= 0))]]] = True
        asked = asks[group]
        yield new & asked, takes & asked, digest, system, *sides


@lru_cache(maxsize=16)
def _box_fold(threshold: float):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        return _folded(_with_apart(batches, threshold), lambda *_: Blocks(threshold), _step_boxes)

    return F.pandas_udf(run, FOLDED).asNondeterministic()


def _numbered(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """For where groups begin and which rows count: how many rows of its group before it count."""
    carried = 0
    for new, counts in batches:
        upto = np.cumsum(counts)
        before = upto - counts
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        at = before + np.where(begin < 0, carried, -before[begin])
        if len(at):
            carried = int(at[-1] + counts[-1])
        yield at


@lru_cache(maxsize=4)
def _block_fold(threshold: float | None):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        # each step takes a batch when the next one asks for it, so what goes beside is that of the batch at hand
        beside, told, flags = [], [], []

        def texts():
            for new, takes, short, text, counts, *box in batches:
                beside.append((new, counts.to_numpy(bool), box))
                yield new, takes, short, text, pd.Series(np.zeros(len(new), dtype=bool))

        def boxes():
            for out in _folded(_with_fresh(_collapsed(texts(), None)), _begin_texts, _step_texts):
                new, counts, box = beside.pop()
                told.append(out)
                flags.append((new.to_numpy(bool), counts | out["keep"].to_numpy(bool)))
                yield new, out["keep"], *box

        def passed():
            for new, takes, *_ in boxes():
                yield pd.DataFrame({"keep": np.ones(len(new), dtype=bool), "error": pd.Series([None] * len(new), dtype=object)})

        numbers = _numbered(iter(flags.pop, None))
        for out in passed() if threshold is None else _folded(_with_apart(boxes(), threshold), lambda *_: Blocks(threshold), _step_boxes):
            before = told.pop()
            out["keep"] &= before["keep"]
            out["error"] = before["error"].where(before["error"].notna(), out["error"])
            out["at"] = next(numbers)
            yield out

    return F.pandas_udf(run, FOLDED.replace(">", ",at:long>")).asNondeterministic()


def drop_overlapping_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence, text: Column, counts: Column, digest: Column, box: Column, threshold: float | None) -> DataFrame:
    """drop_overlapping_texts and, of what that leaves, drop_overlapping_boxes (threshold None: not), in one pass over the rows.

    at: how many rows of the group before one were left by the texts or are such that counts is true.
    """
    sides = [digest, *(box[x] for x in ("coordinate_system", "x", "y", "width", "height"))] if threshold is not None else []
    short = F.when(text.rlike(_SHORT), strip_ws(text))
    rows = _marked(rows, keys, order, __short=F.collect_set(short).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    fold = _block_fold(None if threshold is None else float(threshold))
    return _kept(rows, fold, text.isNotNull(), F.when(F.col("__new"), F.col("__short")), text, F.coalesce(counts, F.lit(False)), *sides, more=["at"]).drop("__short")


def drop_overlapping_boxes(rows: DataFrame, keys: Sequence[str], order: Sequence, digest: Column, box: Column, threshold: float) -> DataFrame:
    """Rows of each group in order: the first of equal hashes, and of boxes that overlap by the threshold or more the one kept first."""
    sides = [box[x] for x in ("coordinate_system", "x", "y", "width", "height")]
    return _kept(_marked(rows, keys, order), _box_fold(float(threshold)), F.lit(True), digest, *sides)


def share_of_windows(new: str, existing: str, window: int = WINDOW) -> float:
    """Share of the new text's windows that the existing one holds; a shorter text is wholly in it or not at all."""
    total = len(new) - window + 1
    if total < 1:
        return float(new in existing)
    if len(existing) < window:
        return 0.0
    if window == 8:
        try:  # eight bytes are a number
            a, b = new.encode("latin-1"), existing.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            asked, there = (np.ndarray((len(x) - 7,), np.uint64, x, 0, (1,)).copy() for x in (a, b))
            there.sort()
            at = np.minimum(np.searchsorted(there, asked), len(there) - 1)
            return int(np.count_nonzero(there[at] == asked)) / total
    there = {existing[i : i + window] for i in range(len(existing) - window + 1)}
    return sum(new[i : i + window] in there for i in range(total)) / total


@lru_cache(maxsize=16)
def _ratio(window: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for new, existing in batches:
            yield pd.Series([None if x is None or y is None else share_of_windows(x, y, window) for x, y in zip(new.tolist(), existing.tolist(), strict=True)], dtype=object)

    return F.pandas_udf(run, "double")


def overlap_ratio(new: Column, existing: Column, window: int = WINDOW) -> Column:
    """share_of_windows of columns; null if one of them is."""
    return _ratio(window)(new, existing)
