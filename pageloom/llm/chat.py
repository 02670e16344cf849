"""Chat formatting with a grammar that reads its own output back.

A turn is written as its role's opening mark, one space, the text and the
closing mark; assistant turns have no opening mark but their space:

    conversation := turn*
    turn := "[SYS] " text " [/SYS]" | "[INST] " text " [/INST]"
          | "[ROLE] " role " [AS] " text " [/ROLE]" | " " text "</s>"
    text := any characters but unescaped marks; "\\\\", "\\[" and "\\<" stand for what follows the backslash

The parser is deterministic: the next characters tell the rule, and a text ends
at the first mark that isn't escaped, which must be its own. Each turn is
written as it is and parsed again; if what comes back isn't its role and text,
its marks are escaped, and if that isn't enough (backslashes before marks) its
backslashes too, which always is. So all but conflicting texts stay as they are,
and a rule for each turn makes one for a conversation, as turns end themselves.

Result rows are pieces of conversations: whole turns, up to about
`piece_chars` characters (or one longer turn), with the spans (code points of
the piece) of assistant texts as loss mask.

Scale: turns are dealt by conversation and sorted within partitions; formatter
and reader stream over them, holding a piece and the hashes of one
conversation, so a conversation of any length passes. Its digest is one chain
of SHA-256 over its turns, so one task sees all of them, but never holds them.
Reading right after formatting (`in_order`) needs no further shuffle; written
pieces of conversations with several are dealt again, others are read in place.

Defined results: null text is empty, null role the empty role. Turns are in
order of turn (null first), then role and text; repeated rows are repeated
turns. Rows of null id are one conversation. Role names of any characters are
escaped like texts. Texts of any length are written whole. Columns beside the
four are not read, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.store import short_batches

#: Opening and closing marks of roles; the empty opening is the assistant's.
SYSTEM, USER, ASSISTANT = ("[SYS] ", " [/SYS]"), ("[INST] ", " [/INST]"), (" ", "</s>")
OTHER, NAMED = ("[ROLE] ", " [/ROLE]"), " [AS] "
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: Strings that mean something to the template, or to models that know it.
MARKS = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[AS]", "[/ROLE]", "<s>", "</s>")
PIECE_CHARS = 1 << 18

_MARK = re.compile("|".join(map(re.escape, MARKS)))
_MARK_OR_SLASH = re.compile(r"\\|" + _MARK.pattern)
_TOKEN = re.compile(r"\\[\\\[<]|" + _MARK.pattern)
_ESCAPED = re.compile(r"\\([\\\[<])")

#: Ways to write a text, the first that reads back the same is taken.
LEVELS = (lambda t: t, lambda t: _MARK.sub(r"\\\g<0>", t), lambda t: _MARK_OR_SLASH.sub(r"\\\g<0>", t))


class GrammarError(ValueError):
    """The text isn't made by the template."""


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _until(text: str, at: int, close: str) -> int:
    """Where the closing mark begins that ends the text from `at` on."""
    pad = len(close) - len(close.lstrip(" "))
    for m in _TOKEN.finditer(text, at):
        if m[0][0] != "\\":
            end = m.start() - pad
            if end < at or m[0] != close.strip(" ") or not text.startswith(close, end):
                raise GrammarError(f"{m[0]} at {m.start()} where {close!r} is due")
            return end
    raise GrammarError(f"no {close!r} after {at}")


def parse(text: str) -> Iterator[tuple[str, int, int]]:
    """The turns of a text: role, and where what stands for the turn's text begins and ends."""
    at = 0
    while at < len(text):
        if text.startswith(OTHER[0], at):
            begin = at + len(OTHER[0])
            end = _until(text, begin, NAMED)
            role, begin, close = unescape(text[begin:end]), end + len(NAMED), OTHER[1]
        else:
            role, (mark, close) = next(((r, x) for r, x in ROLES.items() if text.startswith(x[0], at)), (None, ("", "")))
            if role is None:
                raise GrammarError(f"no turn begins at {at}")
            begin = at + len(mark)
        end = _until(text, begin, close)
        yield role, begin, end
        at = end + len(close)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template has it, and where its text begins and ends; written so that it reads back the same."""
    for level in LEVELS:
        mark, close = ROLES.get(role, (f"{OTHER[0]}{level(role)}{NAMED}", OTHER[1]))
        made = f"{mark}{level(text)}{close}"
        try:
            back = list(parse(made))
        except GrammarError:
            continue
        if len(back) == 1 and back[0][0] == role and unescape(made[back[0][1] : back[0][2]]) == text:
            return made, back[0][1], back[0][2]
    raise GrammarError(f"a turn of role {role!r} can't be written")


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def _order(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *by)


def _format(batches: Iterator[pa.RecordBatch], fields: pa.Schema, piece_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows conv_id, role, text in order to pieces of conversations; one is given out when it is full or its conversation ends."""
    new = object()
    conv, part, turns, spans, size = new, 0, [], [], 0
    out: list[tuple] = []

    def piece(last: bool) -> None:
        nonlocal part, turns, spans, size
        out.append((conv, part, last, "".join(turns), spans))
        part, turns, spans, size = part + 1, [], [], 0

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
        out.clear()
        return made

    for rows in batches:
        held = 0
        for conv_id, role, text in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
            if conv_id != conv or conv is new:
                if conv is not new:
                    piece(True)
                conv, part = conv_id, 0
            elif size >= piece_chars:
                piece(False)
            role = role or ""
            made, begin, end = write_turn(role, text or "")
            if role == "assistant":
                spans.append({"first": size + begin, "end": size + end})
            turns.append(made)
            size += len(made)
            held += len(made)
            if held >= piece_chars and out:
                yield batch()
                held = 0
        if out:
            yield batch()
    if conv is not new:
        piece(True)
        yield batch()


def _read(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces in order to a row per conversation: counts and digests of its turns and of the text under the mask."""
    out: list[tuple] = []
    state: list | None = None
    for rows in batches:
        for conv_id, last, text, spans in zip(*(rows.column(x) for x in ("conv_id", "last", "formatted", "loss")), strict=True):
            if state is None:
                state = [conv_id.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            elif state[0] != conv_id.as_py():
                raise GrammarError(f"conversation {state[0]} has no last piece")
            text = text.as_py()
            for role, begin, end in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{unescape(text[begin:end])}\n".encode())
            for span in spans.as_py():
                under = unescape(text[span["first"] : span["end"]])
                state[3] += len(under)
                state[4].update(under.encode())
            state[5] += len(text)
            if last.as_py():
                out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                state = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
            out.clear()
    if state is not None:
        raise GrammarError(f"conversation {state[0]} has no last piece")


def format_conversations(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of conversations: conv_id, part, last (of its conversation), formatted and loss (spans of assistant texts in it)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(conversations.sparkSession)
    rows = conversations.select(*(F.col(x).alias(y) for x, y in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    schema = T.StructType([rows.schema["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("formatted", T.StringType()), T.StructField("loss", SPANS)])
    fields = to_arrow_schema(schema)
    return _order(rows, "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(lambda it: _format(it, fields, piece_chars), schema)


def read_back(pieces: DataFrame, *, in_order: bool = False) -> DataFrame:
    """Per conversation what its pieces say: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars. in_order: straight from format_conversations."""
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(pieces.sparkSession)
    of = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}
    schema = T.StructType([pieces.schema["conv_id"], *(T.StructField(k, v) for k, v in of.items())])
    fields = to_arrow_schema(schema)
    read = lambda df: df.select("conv_id", "last", "formatted", "loss").mapInArrow(lambda it: _read(it, fields), schema)
    if in_order:
        return read(pieces)
    alone = (F.col("part") == 0) & F.col("last")
    return read(pieces.where(alone)).unionByName(read(_order(pieces.where(~alone), "part")))


#: A conversation whose texts are the template's own marks.
CONFLICT = "</s>[INST] ok [/INST]"


def op12_chat_formatting(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], table.schema)
    return read_back(format_conversations(table.unionByName(tricky)), in_order=True)


_RE = r"\[/?SYS\]|\[/?INST\]|\[/?ROLE\]|\[AS\]|</?s>"
SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{CONFLICT}'), (-7, 1, 'assistant', '{CONFLICT}')),
e AS (SELECT *, len(regexp_extract_all(text, '{_RE}')) AS marks, len(text) - len(replace(text, '\', '')) AS slashes,
             regexp_matches(text || CASE role WHEN 'assistant' THEN '<' ELSE ' ' END, '\\[\\\[<]') AS deep,
             CASE role WHEN 'assistant' THEN 5 WHEN 'user' THEN 15 WHEN 'system' THEN 13 ELSE 21 + len(role) END AS frame FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + frame + marks + CASE WHEN deep THEN slashes ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
