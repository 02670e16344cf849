"""The template against its own parser, a plain version of the digests, and edges."""

import hashlib
import random

import pytest

from pageloom.llm import chat as C

ROLES = ["user", "assistant", "system", "tool", "", "[AS]", "as\\", "role ] [ROLE] x [AS] ", "user "]
PIECES = [*C.MARKS, "\\", "\\\\", "[", "<", " ", "\n", "é", "\U0001f600", "text", "/", "]", ">"]


def texts(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))


def test_turns_read_back_the_same():
    rng = random.Random(5)
    for _ in range(4000):
        turns = [(rng.choice(ROLES), texts(rng)) for _ in range(rng.randrange(4))]
        made = "".join(C.write_turn(*t)[0] for t in turns)
        assert [(r, C.unescape(made[a:b])) for r, a, b in C.parse(made)] == turns


def test_only_conflicts_are_escaped():
    assert C.write_turn("user", "C:\\temp \\n 1 < 2 [x]")[0] == "[INST] C:\\temp \\n 1 < 2 [x] [/INST]"
    assert C.write_turn("user", "a [INST] b")[0] == "[INST] a \\[INST] b [/INST]"
    assert C.write_turn("assistant", "end\\")[0] == " end\\\\</s>"
    assert C.write_turn("user", "end\\")[0] == "[INST] end\\ [/INST]"
    assert C.write_turn("user", "\\[INST] \\x")[0] == "[INST] \\\\\\[INST] \\\\x [/INST]"


@pytest.mark.parametrize("bad", ["text", "[INST] a", "[INST] a</s>", "[INST] a [/SYS]", " a [INST] b</s>", "[ROLE] x [/ROLE]", "[INST] a[/INST]", " a</s>\n"])
def test_what_the_grammar_does_not_make(bad):
    with pytest.raises(C.GrammarError):
        list(C.parse(bad))


def plain(rows):
    out, key = [], lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        made = "".join(C.write_turn(*t)[0] for t in turns)
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(made)))
    return sorted(out, key=str)


def table(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice([*ROLES, None]), rng.choice([texts(rng), texts(rng), None])) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "assistant", "tie"), (41, 0, "assistant", "long \\ [INST] " * 20000)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(3000)]  # one conversation with most rows
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, formatted string").repartition(5)


def test_digests_from_formatted_and_from_written_pieces(spark, tmp_path):
    rows, frame = table(spark)
    want = plain(rows)
    made = C.format_conversations(frame, piece_chars=500)
    assert sorted(map(tuple, C.read_back(made, in_order=True).collect()), key=str) == want
    made.write.parquet(str(tmp_path / "pieces"))
    written = spark.read.parquet(str(tmp_path / "pieces"))
    assert written.where("conv_id = 50").count() > 20
    assert sorted(map(tuple, C.read_back(written.repartition(7)).collect()), key=str) == want
    assert C.read_back(C.format_conversations(frame.limit(0)), in_order=True).count() == 0


def test_lost_pieces_are_told(spark):
    made = C.format_conversations(table(spark)[1], piece_chars=500)
    with pytest.raises(Exception, match="has no last piece"):
        C.read_back(made.where("not (conv_id = 50 and last)")).collect()
