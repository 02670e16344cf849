"""Script conversion by phrase tables: at each place the longest phrase that stands there is replaced, else the character stays.

A table is rows of stage, phrase and replacement. Stages go one after the other
over the whole text, each with the phrases of its own. The table goes to every
task with the function, so its size is checked; a worker compiles it once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of phrases and replacements that a table may have.
MOST_CHARS = 1 << 25


class Phrases:
    """A conversion of texts; equal tables are equal, and compiled once in a process."""

    def __init__(self, rows: Iterable[tuple[int, str, str]]):
        """rows: stage, phrase, replacement; of a phrase that a stage has twice, the first counts."""
        stages: dict[int, dict[str, str]] = {}
        for stage, phrase, replacement in rows:
            if not phrase or replacement is None:
                raise ValueError(f"phrase {phrase!r} of stage {stage} has no text or no replacement")
            stages.setdefault(stage, {}).setdefault(phrase, replacement)
        self.stages = tuple(tuple(sorted(stages[k].items())) for k in sorted(stages))

    @classmethod
    def read(cls, table: DataFrame) -> Phrases:
        """From a table with columns stage, phrase and replacement, of at most MOST_CHARS characters."""
        chars = table.agg(F.sum(F.length("phrase") + F.length("replacement"))).first()[0] or 0
        if chars > MOST_CHARS:
            raise ValueError(f"{chars} characters of phrases; at most {MOST_CHARS} can go to every task")
        return cls(map(tuple, table.select("stage", "phrase", "replacement").orderBy("stage", "phrase", "replacement").collect()))

    def __eq__(self, other) -> bool:
        return isinstance(other, Phrases) and self.stages == other.stages

    def __hash__(self) -> int:
        return hash(self.stages)

    def __call__(self, text: str) -> str:
        for stage in self.stages:
            text = _replaced(text, _automaton(stage))
        return text


@lru_cache(maxsize=32)
def _automaton(stage: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase, replacement in stage:
        made.add_word(phrase, (len(phrase), replacement))
    made.make_automaton()
    return made


def _replaced(text: str, automaton: ahocorasick.Automaton) -> str:
    """Leftmost, then longest: of the matches that begin where the last one taken ended or later, the first to begin; of these the longest."""
    best: dict[int, tuple[int, str]] = {}
    for last, (n, replacement) in automaton.iter(text):
        first = last + 1 - n
        if first not in best or best[first][0] < n:
            best[first] = (n, replacement)
    if not best:
        return text
    out, at = [], 0
    for first in sorted(best):
        if first >= at:
            n, replacement = best[first]
            out += [text[at:first], replacement]
            at = first + n
    return "".join([*out, text[at:]])
