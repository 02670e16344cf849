"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A piece (a pre-token) is a string over 512 symbols: the 256 byte characters and
their word-final forms. An Aho-Corasick automaton over the tokens gives the
longest token at each position. The encoder takes the longest token that is
compatible with the one before it, else its next shorter prefix, else steps
back over the last token; a position that was given up is never tried again, so
the work is linear in the piece. Two adjacent tokens are compatible if BPE,
merging their concatenation, ends with just these two; answers are kept in a
table of pairs. A sequence whose neighbours are all compatible is the one that
the merges give.

Decoding is a gather from one byte string of all token texts through a table of
offsets.

Scale: one narrow pass over the rows, no shuffle. Encoded pieces are remembered
in a table of bounded size in each Python worker.

Defined results: null and empty texts have no tokens and decode to "". Special
tokens in a text become their ids. Repeated rows stay. Only the columns in
`keep` are passed on.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.store import passed, short_batches
from pageloom.llm.words import row_groups

TOKENIZER = "word_bpe_49k.json"
#: Pieces and pairs that a worker remembers before it starts afresh.
REMEMBERED = 400_000
FINAL = 0x10000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class OffsetTable:
    """Texts by number in one byte string."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(x) for x in texts], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        place = np.repeat((self.at[ids] - ends + size).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        return self.bytes[place]


class WordBpe:
    """A tokenizer of BPE with word ends, from its JSON file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        chars = byte_characters()
        self.symbol = {c: c for c in chars}
        spelled: dict[str, str] = {c: c for c in chars} | {c + suffix: chr(ord(c) + FINAL) for c in chars}
        n = max([*vocab.values(), *self.specials.values()]) + 1
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            token = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = rank
            if a + b not in spelled:
                spelled[a + b] = spelled[a] + spelled[b]
                self.rank[token], self.left[token], self.right[token] = rank, vocab[a], vocab[b]
        self.length = [0] * n
        self.shorter = [-1] * n
        longest: dict[str, int] = {}
        automaton = ahocorasick.Automaton()
        for text, s in spelled.items():
            if text in vocab:
                longest[s] = vocab[text]
                automaton.add_word(s, (len(s), vocab[text]))
                self.length[vocab[text]] = len(s)
        automaton.make_automaton()
        for s, token in longest.items():
            self.shorter[token] = next((longest[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in longest), -1)
        self.matches = automaton.iter
        self.bytes = [c.encode() for c in chars]
        self.chars = chars
        self.table = OffsetTable([(" " + x).encode() for x in _by_id(vocab | self.specials, n)])
        self.known: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Does BPE on the text of a and b leave the two as they are?"""
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[a, b] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges next to the border, latest first. Until what stands left of it is merged away (at a_until)
        # and what stands right of it (b_until), a merge across the border would come first. Of two equal merges the
        # left one comes first.
        a_until = b_until = 1 << 60
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < a_until and across <= b_until:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, a_until = self.right[a], ra
            else:
                b, b_until = self.left[b], rb

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        s = "".join([self.chars[x] for x in raw[:-1]]) + chr(ord(self.chars[raw[-1]]) + FINAL)
        n = len(s)
        best = [-1] * n
        size = [0] * n
        for end, (k, token) in self.matches(s):
            if k > size[end - k + 1]:
                size[end - k + 1], best[end - k + 1] = k, token
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, best[0]
        while at < n:
            while token >= 0:
                end = at + self.length[token]
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = best[at] if at < n else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.length[token]
        return out

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        got = array("i", self.encode_piece(piece)).tobytes()
        if len(piece) <= 64:
            self.pieces[piece] = got
        return got

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character is lowered by itself
        known, out = self.pieces.get, []
        for x in self.find(text.lower()):
            out.append(known(x) or self._piece(x))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if self.special_split is None or "<|" not in text:
            return np.frombuffer(self._plain(text), np.int32)
        parts = self.special_split.split(text)
        return np.frombuffer(b"".join(array("i", [self.specials[x]]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts) if x), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts joined by one space, as a tokenizer without decoder has it."""
        return self.table.gather(ids).tobytes()[1:]


def _by_id(vocab: dict[str, int], n: int) -> list[str]:
    out = [""] * n
    for text, i in vocab.items():
        out[i] = text
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str | None) -> WordBpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return WordBpe(path)


def _run(batches: Iterator[pa.RecordBatch], path: str | None, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path)
    for batch in batches:
        column = batch.column("__text")
        sizes = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)]))
        for a, b in row_groups(sizes, 1 << 19):
            part = batch.slice(a, b - a)
            ids = [bpe.encode(t) if t else np.zeros(0, np.int32) for t in part.column("__text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            decoded = [bpe.decode(x) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            kept = [part.column(x).cast(fields.field(x).type) for x in part.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, lists.cast(fields.field("ids").type), pa.array(decoded, pa.binary()).cast(pa.string())], schema=fields)


def encode_decode(documents: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: the columns in keep, ids (array of int) and decoded (string). path: the tokenizer's file on each machine.

    ids and decoded win over columns in keep with their names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(documents.sparkSession)
    keep = passed(keep, ("ids", "decoded"))
    source = documents.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*(source.schema[x] for x in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    fields = to_arrow_schema(schema)
    return source.mapInArrow(lambda it: _run(it, path, fields), schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
