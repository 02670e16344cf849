"""What a task keeps of a group too large for memory: sorted runs of numbered keys, and texts, in temporary files without a name.

They are a task's working space, as spilled sorts are: no other task reads them,
and the system frees them when the task's process lets go of them.
"""

from __future__ import annotations

import tempfile
from array import array

import numpy as np

#: Pairs that a merge of two runs holds at a time.
SLICE = 1 << 18
PAIR = np.dtype([("key", np.int64), ("number", np.int64)])


class Runs:
    """Pairs of key and number, to be found by key, numbers ascending. Later pairs have no smaller numbers. Runs of like size are merged, so there are few."""

    def __init__(self):
        self.runs: list[np.ndarray] = []

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        pairs = np.empty(len(keys), PAIR)
        pairs["key"], pairs["number"] = keys, numbers
        self.runs.append(_stored(pairs[np.lexsort((numbers, keys))]))
        while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            later, earlier = self.runs.pop(), self.runs.pop()
            self.runs.append(_merged(earlier, later))

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each key its numbers."""
        parts: list[list[np.ndarray]] = [[] for _ in keys]
        for run in self.runs:
            key, number = run["key"], run["number"]
            first, end = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            for i in np.flatnonzero(end > first).tolist():
                parts[i].append(number[first[i] : end[i]])
        return [np.concatenate(p) if len(p) > 1 else p[0] if p else np.zeros(0, np.int64) for p in parts]


def _room(n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, PAIR)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * PAIR.itemsize)
        return np.memmap(f, PAIR, "r+", shape=(n,))


def _stored(pairs: np.ndarray) -> np.ndarray:
    out = _room(len(pairs))
    out[:] = pairs
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both runs in one; of equal keys those of a come first. Slices of a and of b end at the same key."""
    out, i, j, at = _room(len(a) + len(b)), 0, 0, 0
    while i < len(a) or j < len(b):
        ends = [run["key"][min(k + SLICE, len(run)) - 1] for run, k in ((a, i), (b, j)) if k < len(run)]
        upto = min(ends)
        x, y = (k + int(np.searchsorted(run["key"][k:], upto, "right")) for run, k in ((a, i), (b, j)))
        both = np.concatenate([a[i:x], b[j:y]])
        out[at : at + len(both)] = both[np.argsort(both["key"], kind="stable")]
        i, j, at = x, y, at + len(both)
    return out


class Texts:
    """Texts by number: 8 bytes each in memory, the texts in a file."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.ends = array("q", [0])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, text: str) -> None:
        self.file.seek(self.ends[-1])
        self.ends.append(self.ends[-1] + self.file.write(text.encode("utf-8", "surrogatepass")))

    def __getitem__(self, k: int) -> str:
        self.file.seek(self.ends[k])
        return self.file.read(self.ends[k + 1] - self.ends[k]).decode("utf-8", "surrogatepass")
