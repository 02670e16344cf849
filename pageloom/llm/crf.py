"""A linear-chain conditional random field over word shapes, in numpy.

Tokens are runs of bytes that aren't ASCII white space. A token has a shape
(its classes of characters, runs collapsed), a coarse class (which kinds of
characters it has, and its length), its lower-cased word, and its row's file
class; shape, class and word of both neighbours count too. Shapes and words
that training didn't see share one number each. Training maximises the
penalised log likelihood of a labelled table with Adam; tagging is Viterbi over
batches of lines, whole and of any length, one step for all lines at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pageloom.llm.words import NONSPACE, Words, mix, powers, utf8, words

FILE_CLASSES = 4
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)

LOWER, UPPER, DIGIT, OTHER = range(4)
_CLASS = np.arange(256) + 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = LOWER, UPPER, DIGIT, OTHER
_CLASS_HASH = mix(_CLASS.astype(np.uint64) + np.uint64(0x51A9))
_SIGNS = np.array([0x3D, 0x3A, 0x7B, 0x7D, 0x3B, 0x5F])  # = : { } ; _


class Tokens:
    """Features of the tokens of some rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = self.words = words(data, offsets, NONSPACE)
        lo, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        part = data[lo : lo + n]
        kind = _CLASS[part]
        starts, ends = w.start - lo, w.end - lo
        new = np.ones(n, dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        new[starts] = True
        at = np.flatnonzero(new & NONSPACE[part])
        sums = np.zeros(len(at) + 1, dtype=np.uint64)
        np.cumsum(_CLASS_HASH[part[at]] * powers(_P, len(at)), out=sums[1:])
        a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
        self.shape = mix((sums[b] - sums[a]) * powers(_PI, len(at) + 1)[a] + (b - a).astype(np.uint64))
        size = ends - starts
        coarse = np.searchsorted(np.array([2, 3, 5, 8, 12, 20, 40]), size, "right").astype(np.int64)
        for bit, is_kind in enumerate((kind == LOWER, kind == UPPER, kind == DIGIT, kind == OTHER, (kind > OTHER) & NONSPACE[part])):
            count = np.concatenate([[0], np.cumsum(is_kind, dtype=np.int32)])
            coarse |= ((count[ends] > count[starts]).astype(np.int64)) << (3 + bit)
        self.coarse = coarse
        signs = np.concatenate([[0], np.cumsum(np.isin(part, _SIGNS), dtype=np.int32)])
        rows = offsets - lo
        share = (signs[rows[1:]] - signs[rows[:-1]]) / np.maximum(np.diff(w.first), 1)
        self.file = np.repeat(np.searchsorted(np.array([0.02, 0.1, 0.5]), share), np.diff(w.first))
        breaks = np.unique(np.concatenate([np.flatnonzero(part == 10), rows[1:] - 1]))
        line = np.searchsorted(breaks, starts)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(w.first))
        head = np.ones(len(starts), dtype=bool)
        head[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        self.first = np.flatnonzero(head)
        self.row = row


def _number(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place in the sorted known values plus 1; 0 for the unknown."""
    if not len(known):
        return np.zeros(len(x), np.int64)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return np.where(known[at] == x, at + 1, 0)


class Crf:
    """Labels: 0 is outside; kind k has begin 1 + 2k and inside 2 + 2k."""

    def __init__(self, kinds: list[str], rows: list[tuple[str, list[tuple[int, int, str]]]], *, steps: int = 90, rate: float = 0.15, penalty: float = 2e-5):
        """rows: texts with their spans (start, end in code points, kind)."""
        self.kinds = kinds
        n_labels = self.n_labels = 1 + 2 * len(kinds)
        data, offsets = utf8(pa.array([t for t, _ in rows], pa.string()))
        tokens = Tokens(data, offsets)
        gold = self._gold(tokens.words, rows)
        self.shapes = np.unique(tokens.shape)
        hashes, counts = np.unique(tokens.words.hash, return_counts=True)
        self.vocabulary = hashes[counts >= 4]
        self.sizes = (len(self.shapes) + 1, 256, len(self.vocabulary) + 1)
        ids = self._ids(tokens)
        weights = [np.zeros((n, n_labels)) for n in self.sizes * 3] + [np.zeros((FILE_CLASSES, n_labels)), np.zeros((2, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
        allowed = np.zeros((n_labels, n_labels))
        start = np.zeros(n_labels)
        for k in range(len(kinds)):
            allowed[:, 2 + 2 * k] = -1e4
            allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
            start[2 + 2 * k] = -1e4
        first = np.concatenate([tokens.first, [len(gold)]])
        sizes = np.diff(first)
        grid = np.full((len(sizes), sizes.max()), -1)
        for i, (a, n) in enumerate(zip(first[:-1], sizes, strict=True)):
            grid[i, :n] = np.arange(a, a + n)
        real = grid >= 0
        left, right = np.arange(len(gold)) - 1, np.arange(len(gold)) + 1
        has_left, has_right = np.ones(len(gold), bool), np.ones(len(gold), bool)
        has_left[first[:-1]] = False
        has_right[first[1:] - 1] = False
        one_hot = np.eye(n_labels)[gold]
        gold_grid = np.where(real, gold[grid], 0)
        gold_edges = np.zeros((n_labels, n_labels))
        both = real[:, 1:]
        np.add.at(gold_edges, (gold_grid[:, :-1][both], gold_grid[:, 1:][both]), 1)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for step in range(1, steps + 1):
            e = self._emissions(ids, tokens.file, weights, has_left, has_right)
            p, edges, starts = _marginals(e, grid, real, weights[11] + allowed, weights[12] + start)
            d = one_hot - p
            gradient = []
            for j in range(9):
                use, x = (d, ids[j % 3]) if j < 3 else (d[right[has_right]], ids[j % 3][has_right]) if j < 6 else (d[left[has_left]], ids[j % 3][has_left])
                gradient.append(np.stack([np.bincount(x, use[:, c], minlength=self.sizes[j % 3]) for c in range(n_labels)], 1))
            gradient.append(np.stack([np.bincount(tokens.file, d[:, c], minlength=FILE_CLASSES) for c in range(n_labels)], 1))
            gradient.append(np.stack([d[~has_left].sum(0), d[~has_right].sum(0)]))
            gradient.append(gold_edges - edges)
            gradient.append(one_hot[first[:-1]].sum(0) - starts)
            for w, g, (m, v) in zip(weights, gradient, moments, strict=True):
                g = g / len(sizes) - penalty * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = [w.astype(np.float32) for w in weights]
        self.trans, self.start = (weights[11] + allowed).astype(np.float32), (weights[12] + start).astype(np.float32)

    def _gold(self, w: Words, rows) -> np.ndarray:
        gold = np.zeros(len(w.start), np.int64)
        base = 0
        for i, (text, spans) in enumerate(rows):
            for a, b, kind in spans:
                lo, hi = base + len(text[:a].encode()), base + len(text[:b].encode())
                own = [j for j in range(w.first[i], w.first[i + 1]) if w.end[j] > lo and w.start[j] < hi]
                gold[own] = 2 + 2 * self.kinds.index(kind)
                gold[own[0]] -= 1
            base += len(text.encode())
        return gold

    def _ids(self, tokens: Tokens) -> list[np.ndarray]:
        return [_number(self.shapes, tokens.shape), tokens.coarse, _number(self.vocabulary, tokens.words.hash)]

    def _emissions(self, ids, file, weights, has_left, has_right) -> np.ndarray:
        e = weights[0][ids[0]] + weights[1][ids[1]] + weights[2][ids[2]] + weights[9][file]
        if len(e):
            before = weights[3][ids[0]] + weights[4][ids[1]] + weights[5][ids[2]]
            before = np.concatenate([weights[10][:1], before[:-1]])
            e += np.where(has_left[:, None], before, weights[10][0])
            after = weights[6][ids[0]] + weights[7][ids[1]] + weights[8][ids[2]]
            after = np.concatenate([after[1:], weights[10][1:]])
            e += np.where(has_right[:, None], after, weights[10][1])
        return e

    def tag(self, tokens: Tokens) -> np.ndarray:
        """The best label of each token."""
        n = len(tokens.coarse)
        if not n:
            return np.zeros(0, np.uint8)
        has_left, has_right = np.ones(n, bool), np.ones(n, bool)
        has_left[tokens.first] = False
        has_right[np.concatenate([tokens.first[1:], [n]]) - 1] = False
        e = self._emissions(self._ids(tokens), tokens.file, self.weights, has_left, has_right)
        first = tokens.first
        sizes = np.diff(np.concatenate([first, [n]]))
        labels, place, order = viterbi(e, first, sizes, self.trans, self.start)
        out = np.zeros(n, np.uint8)
        first, sizes = first[order], sizes[order]
        out[np.repeat(first, sizes) + np.arange(n) - np.repeat(place, sizes)] = labels
        return out

    def spans(self, tokens: Tokens) -> list[tuple[int, int, int, str]]:
        """Tagged runs of tokens: row, start and end byte in the data, kind."""
        label = self.tag(tokens).astype(np.int64)
        at = np.flatnonzero(label)
        if not len(at):
            return []
        begins = (label[at] % 2 == 1) | (np.diff(at, prepend=-2) != 1)
        heads = np.flatnonzero(begins)
        ends = np.concatenate([heads[1:], [len(at)]]) - 1
        w = tokens.words
        return [(int(tokens.row[at[h]]), int(w.start[at[h]]), int(w.end[at[t]]), self.kinds[(int(label[at[h]]) - 1) // 2]) for h, t in zip(heads, ends, strict=True)]


def viterbi(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best labels of the pieces, longest first, one after the other; each piece's place in them; the pieces' order."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    place = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n_labels = e.shape[1]
    back = np.zeros((int(sizes.sum()), n_labels), np.uint8)
    score = e[starts] + start
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")  # active[t]: pieces longer than t
    for t in range(1, int(sizes[0])):
        a = int(active[t])
        now = score[:a]
        best, arg = now[:, :1] + trans[0], np.zeros((a, n_labels), np.uint8)
        for i in range(1, n_labels):
            x = now[:, i : i + 1] + trans[i]
            better = x > best
            np.copyto(best, x, where=better)
            arg[better] = i
        back[place[:a] + t] = arg
        score[:a] = best + e[starts[:a] + t]
    labels = np.zeros(len(back), np.uint8)
    last = np.argmax(score, 1).astype(np.uint8)
    now = last.copy()
    for t in range(int(sizes[0]) - 1, -1, -1):
        a = int(active[t])
        longer = int(active[t + 1]) if t + 1 < len(active) else 0
        if longer:
            now[:longer] = back[place[:longer] + t + 1, now[:longer]]
        labels[place[:a] + t] = now[:a]
    return labels, place, order


def _marginals(e: np.ndarray, grid: np.ndarray, real: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: probabilities of labels, summed probabilities of label pairs, summed probabilities of first labels."""
    n, size = grid.shape
    x = np.where(real[..., None], e[grid], 0)
    x -= x.max(2, keepdims=True)
    emit, move = np.exp(x), np.exp(trans)
    forward, backward, norm = np.zeros_like(x), np.ones_like(x), np.ones((n, size))
    forward[:, 0] = np.exp(start) * emit[:, 0]
    for t in range(size):
        if t:
            forward[:, t] = np.where(real[:, t, None], (forward[:, t - 1] @ move) * emit[:, t], forward[:, t - 1])
        norm[:, t] = forward[:, t].sum(1)
        forward[:, t] /= norm[:, t, None]
    edges = np.zeros_like(trans)
    for t in range(size - 1, 0, -1):
        ahead = backward[:, t] * emit[:, t] / norm[:, t, None]
        on = real[:, t]
        edges += move * (forward[on, t - 1].T @ ahead[on])
        backward[:, t - 1] = np.where(on[:, None], ahead @ move.T, 1)
    p = forward * backward
    p /= p.sum(2, keepdims=True)
    return p[real][np.argsort(grid[real])], edges, p[:, 0].sum(0)
