"""Secret scans: patterns, and a conditional random field for what they miss.

Patterns find assignments to words such as password or token, access keys and
long hexadecimal strings. A linear-chain conditional random field (crf.py) tags
tokens as begin, inside or outside of a secret, from their shape, the words and
shapes beside them and how much the file looks like code; a tagged run that
overlaps no pattern's span is added as `crf-secret`.

Scale and defined results: as in personal.py.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from pageloom.llm import personal
from pageloom.llm.crf import Crf
from pageloom.llm.personal import Span

BASE = ("assign", "access", "hex")
KINDS = ["secret"]

_WORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind as listed."""
    low = text.lower()
    out: list[Span] = []
    if any(x in low for x in _WORDS) and (":" in text or "=" in text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def labelled_table(seed: int = 11, n: int = 1500) -> list[tuple[str, list[Span]]]:
    """The labelled table: lines of prose and of settings, with and without secrets. Deterministic."""
    r = random.Random(seed)
    letters, capitals, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda a, k: "".join(r.choice(a) for _ in range(k))
    secrets = [
        lambda: some("0123456789abcdef", r.choice([32, 40, 64])),
        lambda: some(letters + capitals + digits + "+/", r.randint(24, 44)) + r.choice(["", "=", "=="]),
        lambda: "AKIA" + some(capitals + digits, 16),
        lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + some(letters + capitals + digits, r.randint(20, 36)),
        lambda: f"eyJ{some(letters + capitals + digits, 17)}.eyJ{some(letters + capitals + digits, 30)}.{some(letters + capitals + digits + '-_', 43)}",
        lambda: some(letters + capitals + digits + "!@#%", r.randint(12, 20)) + some(digits, 2),
    ]
    before = ["token =", "password:", "secret =", "api_key =", "Bearer", "Authorization: Bearer", "key =", "passwd =", "private key", "credential:", "pwd =", "access key is", "login with"]
    plain = ["name =", "title:", "count =", "color:", "page", "chapter", "see", "version", "id =", "url:"]
    values = [lambda: some(letters, r.randint(3, 9)), lambda: some(digits, r.randint(1, 5)), lambda: f"{some(digits, 1)}.{some(digits, 1)}.{some(digits, 1)}", lambda: some(digits, 16), lambda: f"+1 ({some(digits, 3)}) {some(digits, 3)}-{some(digits, 4)}", lambda: f"{some(digits, 3)}.{some(digits, 2)}.{some(digits, 3)}.{some(digits, 2)}", lambda: f"{some(letters, 5)}.{some(digits, 2)}@mail{some(digits, 1)}.example.com", lambda: f"http://{some(letters, 6)}.org/{some(letters, 8)}-{some(letters, 5)}", lambda: some(letters, r.randint(14, 22)), lambda: some(capitals, r.randint(8, 18)) + "!!", lambda: some(letters, 10) + r.choice(["%%%", "&&&", "###"])]
    rows: list[tuple[str, list[Span]]] = []
    for _ in range(n):
        text, spans = "", []
        prose = r.random() < 0.7
        for _ in range(r.randint(1, 3)):
            text += "".join(personal._filler(r) + " " for _ in range(r.randint(0, 8) if prose else r.randint(0, 1)))
            x = r.random()
            quote = r.choice(["", "", '"', "'"])
            if x < 0.4:
                text += r.choice([*before, ""]) + " " + quote
                text = text.lstrip(" ")
                what = r.choice(secrets[:5] if text.endswith(" ") and not text.rstrip().endswith(("=", ":")) else secrets)()
                spans.append((len(text), len(text) + len(what), "secret"))
                text += what + quote + r.choice(["", "", ".", ";", "!!", "###"]) + " "
            elif x < 0.75:
                text += r.choice([*plain, "", ""]) + " " + quote + r.choice(values)() + quote + " "
        rows.append((text.rstrip(), spans))
    return [x for x in rows if x[0].strip()]


@lru_cache(maxsize=1)
def model() -> Crf:
    return Crf(KINDS, labelled_table(), steps=130)


def find_secrets(documents: DataFrame, *, crf: Crf | None = None, **options) -> DataFrame:
    """Per row: the columns in keep and spans (start, end, kind, base), base ones first. crf: a model fitted to another labelled table."""
    return personal.scan(documents, crf or model(), base_spans, least=12, **options)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return personal.digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
