"""Personal data: patterns, and a conditional random field for what they miss.

Patterns find e-mail and IP addresses, card and phone numbers. Each is matched
in time linear in the text: the addresses grow from their "@", digit chains are
read as maximal runs. A linear-chain conditional random field (crf.py), trained
from a small labelled table, tags runs of tokens; a run that overlaps no
pattern's span is added as `crf-<kind>`.

Scale: one narrow pass without shuffle; the model is a few hundred kB.

Defined results: null is empty text. Offsets are code points, ends exclusive.
Rows stay as they are, repeated ones too. Only the columns in `keep` are passed
on; one named `spans` gives way to the result. Texts and lines of any length are
tagged whole. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.crf import Crf, Tokens
from pageloom.llm.store import passed, short_batches
from pageloom.llm.words import row_groups, utf8

Span = tuple[int, int, str]
BASE = ("email", "ip", "card", "phone")
KINDS = ["email", "ip", "phone", "account"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(at + 1, floor))


def _ips(text: str) -> Iterator[Span]:
    for m in _CHAIN.finditer(text):
        if text.find(".", m.start(), m.end()) < 0:
            continue
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in four):
                yield at, at + size, "ip"
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.start(), m.end(), "phone"


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind as listed."""
    out = list(_emails(text)) if "@" in text else []
    if _HAS_DIGIT.search(text):
        out += [*_ips(text), *_cards(text)]
        if "+" in text:
            out += _phones(text)
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


_TRIM = " \"'`<>[]{},;:!?%#*&$|~^=/\\"


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _TRIM:
        a += 1
    while b > a and (text[b - 1] in _TRIM or text[b - 1] == "."):
        b -= 1
    return a, b


def add_spans(text: str, raw: bytes, base: list[Span], found: list[tuple[int, int, str]], least: int) -> list[Span]:
    """The tagged byte ranges as code points, trimmed, without those that overlap a base span or have under `least` characters."""
    out = []
    for a, b, kind in found:
        start = len(raw[:a].decode()) if not text.isascii() else a
        start, end = trimmed(text, start, start + len(raw[a:b].decode()))
        if end - start >= least and all(end <= s or start >= e for s, e, _ in base):
            out.append((start, end, f"crf-{kind}"))
    return out


def _filler(r: random.Random) -> str:
    vowels, consonants = ("aeiouéöü", "bcdfghjklmnprstvwñç") if r.random() < 0.3 else ("aeiou", "bcdfghjklmnprstvw")
    w = "".join(r.choice(consonants) + r.choice(vowels) for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 10])))[r.randint(0, 1) :]
    w = r.choice([w, w, w, w, w.capitalize(), w.upper()])
    return w + r.choice(["", "", "", "", "", ".", ",", "!!", "%%%", "&&&", "***", "###", "$$$", " |"])


def _number_word(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice([lambda: d(4), lambda: f"{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.", lambda: f"{d(1)}.", lambda: f"{d(2)}.{d(1)}.{d(1)}", lambda: d(r.randint(1, 6)), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(2)}%", lambda: f"({d(4)})", lambda: f"{d(3)},{d(3)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"page={d(2)}", lambda: f"#{d(3)}", lambda: f"{d(3)}-{d(3)}", lambda: "@", lambda: "@" + _filler(r).split()[0]])()


def labelled_table(seed: int = 7, n: int = 1500) -> list[tuple[str, list[Span]]]:
    """The labelled table: sentences of made-up words, a third without personal data. Deterministic."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: re.sub(r"[^a-z]", "", _filler(r).lower())[:8] or "x"
    make: dict[str, list[Callable[[], str]]] = {
        "email": [lambda: f"{name()}.{d(2)}@mail{d(1)}.{name()}.com", lambda: f"{name()}@{name()}.org", lambda: f"{name()}_{name()}@{name()}.co.uk", lambda: f"{name()}(at){name()}.com", lambda: f"{name()}[at]{name()}[dot]org"],
        "ip": [lambda: f"{d(3)}.{d(2)}.{d(3)}.{d(3)}", lambda: f"{d(2)}.{d(1)}.{d(2)}.{d(3)}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(2)}:{d(4)}"],
        "phone": [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}"],
        "account": [lambda: d(16), lambda: d(r.randint(13, 19)), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"DE{d(20)}"],
    }
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += "".join((_number_word(r) if r.random() < 0.12 else _filler(r)) + " " for _ in range(r.randint(0, 6)))
            if r.random() < 0.45:
                kind = r.choice(KINDS)
                what = r.choice(make[kind])()
                spans.append((len(text), len(text) + len(what), kind))
                text += what + r.choice(["", "", "", ".", ",", "!!", "%%%", "###"]) + " "
        rows.append((text.rstrip(), spans))
    return [x for x in rows if x[0]]


@lru_cache(maxsize=1)
def model() -> Crf:
    return Crf(KINDS, labelled_table(), steps=130)


def _scan(batches: Iterator[pa.RecordBatch], crf: Crf, base: Callable[[str], list[Span]], least: int, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        for a, b in row_groups(offsets):
            part = batch.slice(a, b - a)
            found: dict[int, list[tuple[int, int, str]]] = {}
            for row, s, e, kind in crf.spans(Tokens(data, offsets[a : b + 1])):
                found.setdefault(row, []).append((s - int(offsets[a + row]), e - int(offsets[a + row]), kind))
            out = []
            for row, text in enumerate(part.column("__text").to_pylist()):
                spans = base(text) if text else []
                extra = add_spans(text, data[offsets[a + row] : offsets[a + row + 1]].tobytes(), spans, found[row], least) if row in found else []
                out.append([{"start": s, "end": e, "kind": k, "base": True} for s, e, k in spans] + [{"start": s, "end": e, "kind": k, "base": False} for s, e, k in extra])
            kept = [part.column(x).cast(fields.field(x).type) for x in part.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, fields.field("spans").type)], schema=fields)


def scan(documents: DataFrame, crf: Crf, base: Callable[[str], list[Span]], *, least: int, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(documents.sparkSession)
    keep = passed(keep, ("spans",))
    source = documents.select(*keep, F.col(text_col).alias("__text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*(source.schema[x] for x in keep), T.StructField("spans", T.ArrayType(span))])
    fields = to_arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(crf)
    return source.mapInArrow(lambda it: _scan(it, shared.value, base, least, fields), schema)


def find_personal(documents: DataFrame, *, crf: Crf | None = None, **options) -> DataFrame:
    """Per row: the columns in keep and spans (start, end, kind, base), base ones first. crf: a model fitted to another labelled table."""
    return scan(documents, crf or model(), base_spans, least=6, **options)


def listed(spans: F.Column, kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.lit(list(kinds)), s["kind"]), F.lit(0)), F.lit(len(kinds) + 1))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("r"), s["kind"].alias("k"), s["end"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["a"], s["e"])), ",")


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(base, kinds), 256).alias("base_sha256"), listed(F.col("spans"), kinds).alias("spans"))


def op5_personal(spark, sf_dir: str) -> DataFrame:
    return digest(find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
