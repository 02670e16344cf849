"""Text cleanup: an ordered chain of rewrites, each recorded if it changed the text.

Rules are rows (kind, pattern, replacement); literal kinds replace plain text.
They can come from a table (`rules_from`), and a script conversion may go first
(`functions.phrases`).

The chain depends on its order and on each step's text, as what a rule writes
may be what a later one looks for. Only a rule that matches the text as it is
can be the first to change it, so one scan over an Arrow batch for all patterns
at once tells which texts can change; the others never leave its buffers. In a
text that can, an Aho-Corasick automaton tells which literal rules occur; the
first of them in order goes, and what it changed is scanned again. Texts are
independent of each other; one that a given conversion fails on has an error
and no text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    replacement: str
    literal: bool = False
    #: a pattern (of re) without which a rule that isn't literal changes nothing, None: not known
    needs: str | None = None


_S = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"

#: Misread words and what they stand for, in their order.
CONFUSIONS = [
    ("竞争力", "競爭力"), ("决策", "決策"), ("虚擬", "虛擬"), ("惠用", "應用"), ("典應用", "與應用"), ("典息用", "與應用"),
    ("典深耕", "與深耕"), ("典社", "與社"), ("典促進", "與促進"), ("典引", "與引"), ("技街", "技術"), ("技術息用典", "技術應用與"),
    ("積櫃", "積極"), ("收国", "攸關"), ("收国國家帶展", "攸關國家發展"), ("国民", "國民"), ("国家", "國家"), ("帶展", "發展"),
    ("福社", "福祉"), ("永績", "永續"), ("尊量", "尊嚴"), ("发", "發"), ("孩系统", "該系統"), ("孩系統", "該系統"),
    ("目操", "目標"), ("虚报", "虛擬"), ("虛報", "虛擬"), ("威测", "感測"), ("接器", "機器"), ("封於", "對於"),
    ("爱制定", "爰制定"), ("愛制定", "爰制定"), ("指揉", "指標"), ("引尊", "引導"), ("基硅", "基礎"), ("海登展", "為發展"),
    ("回鹰", "回應"), ("回鷹", "回應"), ("鷹用", "應用"), ("社合", "社會"), ("揉準", "標準"), ("重工", "電工"),
    ("規範", "規範"), ("规定", "規定"), ("惠法", "憲法"), ("影率", "影響"), ("威測", "感測"), ("選過", "透過"),
    ("預測內容建或決策", "預測、內容、建議或決策"), ("AI 會管理框架", "AI 風險管理框架"), ("明確或医含", "明確或隱含"), ("医含", "隱含"), ("醫含", "隱含"),
]

#: English phrases that lost their spaces, in their order.
PHRASES = [
    ("NationalAI", "National AI"), ("InitiativeActof", "Initiative Act of"), ("InitiativeAct", "Initiative Act"), ("ArtificialIntelligence", "Artificial Intelligence"),
    ("RiskManagementFramework", "Risk Management Framework"), ("RiskManagement", "Risk Management"), ("NationalInstituteof", "National Institute of"),
    ("StandardsandTechnology", "Standards and Technology"), ("U.SCode", "U.S. Code"), ("suchas", "such as"), ("withvarying", "with varying"),
    ("predictions,content", "predictions, content"), ("recommendations,or", "recommendations, or"),
]

#: Spacing, then (after a trim that isn't recorded) punctuation.
SPACING = [(rf"(\p{{Han}}){_S}+(\p{{Han}})", r"\1\2"), (rf"{_S}+([，。；：、！？）】])", r"\1"), (rf"([（【]){_S}+", r"\1"), (r"([A-Za-z])(\p{Han})", r"\1 \2"), (r"(\p{Han})([A-Za-z]{2,})", r"\1 \2"), (rf"{_S}{{2,}}", " ")]
PUNCTUATION = [(r"(\p{Han})·(\p{Han})", r"\1，\2"), (r"([一二三四五六七八九十])[:：]", r"\1、"), (r"(\p{Han})[:：](\p{Han})", r"\1，\2"), (r"，([）】])", r"\1"), (rf"（{_S}*([A-Za-z])", r"（\1"), (rf"([A-Za-z]){_S}*）", r"\1）")]

#: Characters of which the spacing and punctuation rules need one (all Han characters and their punctuation are among them), or white space twice.
_NEEDS = rf"[\u2E80-\u9FFF\uF900-\uFAFF\uFF01-\uFF5E\U00016FE0-\U0003FFFF]|{_S}{_S}"

BEFORE_TRIM = [Rule("ocr_confusion", a, b, True) for a, b in CONFUSIONS] + [Rule("whitespace", a, b, True) for a, b in PHRASES] + [Rule("whitespace", a, b, needs=_NEEDS) for a, b in SPACING]
AFTER_TRIM = [Rule("punctuation", a, b, needs=_NEEDS) for a, b in PUNCTUATION]
RESULT = "struct<text:string,fixes:array<struct<type:string,before:string,after:string>>,error:string>"
#: Rules that a table may have: they go to every task.
MOST_RULES = 10_000


def rules_from(table: DataFrame) -> tuple[list[Rule], list[Rule]]:
    """The rules before and after the trim of a table: ord, kind, pattern, replacement, literal, after_trim (of MOST_RULES rows at most)."""
    rows = table.select("ord", "kind", "pattern", "replacement", "literal", "after_trim").orderBy("ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if bad := [r.ord for r in rows if not r.pattern or r.replacement is None]:
        raise ValueError(f"rules without pattern or replacement: {bad}")
    known = {(x.pattern, x.literal): x.needs for x in (*BEFORE_TRIM, *AFTER_TRIM)}
    made = [(Rule(r.kind, r.pattern, r.replacement, bool(r.literal), known.get((r.pattern, bool(r.literal)))), bool(r.after_trim)) for r in rows]
    return [x for x, after in made if not after], [x for x, after in made if after]


class Chain:
    """Rules in order, compiled: an automaton of the literal ones, and whether any of the others matches."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        self.patterns = {i: regex.compile(r.pattern) for i, r in enumerate(rules) if not r.literal}
        needs = {r.needs for r in rules if not r.literal}
        self.needs = None if None in needs else re.compile("|".join(sorted(needs)))
        self.automaton = None
        of: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            if r.literal:
                of.setdefault(r.pattern, []).append(i)
        if of:
            self.automaton = ahocorasick.Automaton()
            for pattern, numbers in of.items():
                self.automaton.add_word(pattern, numbers)
            self.automaton.make_automaton()

    def _due(self, text: str, after: int) -> list[int]:
        """Rules beyond one that may change the text, in order."""
        due = {i for _, numbers in self.automaton.iter(text) for i in numbers if i > after} if self.automaton is not None else set()
        if self.patterns and (self.needs is None or self.needs.search(text)):
            due |= {i for i in self.patterns if i > after}
        return sorted(due)

    def run(self, text: str) -> Iterator[tuple[Rule, str]]:
        """The rules that change the text, and what it is then."""
        due = self._due(text, -1)
        while due:
            i = due.pop(0)
            rule = self.rules[i]
            new = text.replace(rule.pattern, rule.replacement) if rule.literal else self.patterns[i].sub(rule.replacement, text)
            if new != text:
                text = new
                yield rule, text
                due = self._due(text, i)


_ENDS = regex.compile(f"^{_S}+|{_S}+\\Z")


def clean_text(text: str, before: Sequence[Rule], after: Sequence[Rule], convert: Callable[[str], str] | None = None) -> tuple[str, list[dict]]:
    """The cleaned text and the steps that changed it."""
    fixes: list[dict] = []
    if convert is not None and (new := convert(text)) != text:
        fixes.append({"type": "opencc", "before": text, "after": new})
        text = new
    for chain in (_chain(tuple(before)), _chain(tuple(after))):
        for rule, new in chain.run(text):
            fixes.append({"type": rule.kind, "before": text, "after": new})
            text = new
        if chain.rules == tuple(before):
            text = _ENDS.sub("", text)
    return text, fixes


@lru_cache(maxsize=16)
def _chain(rules: tuple[Rule, ...]) -> Chain:
    return Chain(rules)


def scan_pattern(rules: Sequence[Rule]) -> str | None:
    """One RE2 pattern of all that the rules look for, and of white space at the ends; None if some rule can't be said in RE2."""
    literal = lambda x: re.sub(r"[\\.+*?()|\[\]{}^$]", r"\\\g<0>", x)
    re2 = lambda x: re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", x)
    parts = [literal(r.pattern) if r.literal else f"(?:{re2(r.pattern)})" for r in rules]
    pattern = "|".join([*parts, f"^{re2(_S)}", f"{re2(_S)}$"])
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return None
    return pattern


@lru_cache(maxsize=16)
def _cleaner(before: tuple[Rule, ...], after: tuple[Rule, ...], convert: Callable[[str], str] | None):
    def one(text: str) -> tuple:
        try:
            return *clean_text(text, before, after, convert), None
        except Exception as e:  # noqa: BLE001
            return None, [], str(e) or type(e).__name__

    pattern = None if convert is not None else scan_pattern([*before, *after])

    def run(texts: pa.Array) -> pa.Array:
        can = texts.is_valid() if pattern is None else pc.fill_null(pc.match_substring_regex(texts, pattern), False)
        rows = np.flatnonzero(can.to_numpy(zero_copy_only=False))
        made = [one(t) for t in texts.take(pa.array(rows)).to_pylist()]
        count = np.zeros(len(texts), np.int32)
        count[rows] = [len(fixes) for _, fixes, _ in made]
        flat = [x for _, fixes, _ in made for x in fixes]
        fixes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat, FIX))
        new = pc.replace_with_mask(texts, can, pa.array([t for t, _, _ in made], texts.type))
        errors = pc.replace_with_mask(pa.nulls(len(texts), pa.string()), can, pa.array([e for _, _, e in made], pa.string()))
        return pa.StructArray.from_arrays([new, fixes, errors], ["text", "fixes", "error"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # else a filter on the result would clean the texts once for itself
    return F.arrow_udf(run, RESULT).asNondeterministic()


FIX = pa.struct([("type", pa.string()), ("before", pa.string()), ("after", pa.string())])


def cleaned(text: Column, *, before: Sequence[Rule] = BEFORE_TRIM, after: Sequence[Rule] = AFTER_TRIM, convert: Callable[[str], str] | None = None) -> Column:
    """Struct of text, fixes and error; of null all are null or empty. convert: a script conversion that goes first, none by default."""
    return _cleaner(tuple(before), tuple(after), convert)(text)
