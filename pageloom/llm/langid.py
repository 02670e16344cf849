"""Language identification by interpolated Kneser-Ney character models.

Per language, character 4-grams of letters (lower case; all else is one space)
are counted over a bounded sample of labelled documents: the SAMPLE documents
of each language with the least hash of their id, texts whole. The models of
all languages share sorted arrays of n-grams with a row of log probabilities
per language, so a text's n-grams are looked up once. The language with the
least cross-entropy per character wins. A fifth of the sample is held back to
calibrate: the temperature of the score, and per language and length of BANDS
the median and spread (from the median absolute deviation) of the cross-entropy
of pieces of its own texts; a text further off than REJECT_AT spreads for its
length is rejected. Of each text at most PIECES pieces count, and neither
measure is moved by odd texts as long as these are well under half. Texts longer
than the last of BANDS are held to its limit, so that parts unlike the language
are allowed in them; shorter ones than the first to its spread, scaled.

Scale: sampling ranks narrow columns with a per-task limit before the shuffle;
the model is bounded by SAMPLE; prediction is one narrow pass over the texts.

Defined results: a text that is null or has no letter is `und` with score 0 and
rejected. Rows without id are not held out and never learned from. Without any
labelled text all is `und`. Only the columns in `keep` are passed on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.store import passed, short_batches
from pageloom.llm.words import row_groups, utf8

ORDER, SAMPLE, REJECT_AT, UND = 4, 400, 8.0, "und"
BANDS, PIECES = (8, 16, 32), 16


@cache
def _fold() -> np.ndarray:
    """For each code point the 16-bit symbol of its lower-case letter; a space for what is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint16)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            v = ord(low[0]) if len(low) else c
            out[c] = (v ^ (v >> 16) * 40503) & 0xFFFF if v > 0xFFFF else v
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts, each with ORDER - 1 spaces before and one after, and the texts' offsets. A text without letters has none."""
    pad = " " * (ORDER - 1)
    joined = pad.join(["", *(x + "\0" for x in texts)]) if texts else ""
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _fold()[cps]
    sizes = np.array([len(x) + 1 + ORDER - 1 for x in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    letter = s != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a letter
    kept = np.concatenate([[0], np.cumsum(keep)])
    counts = np.diff(kept[first])
    # ORDER - 1 spaces before each text that has letters
    out_sizes = np.where(counts > 0, counts + ORDER - 1, 0)
    out_first = np.concatenate([[0], np.cumsum(out_sizes)])
    out = np.full(out_first[-1], 32, dtype=np.uint16)
    place = np.repeat(out_first[:-1] + ORDER - 1 - kept[first[:-1]], counts) + np.arange(kept[-1]) if kept[-1] else np.zeros(0, np.int64)
    out[place] = s[keep]
    return out, out_first


def codes(s: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each symbol, as a 64-bit number; the first n - 1 are short."""
    out = s.astype(np.uint64)
    for j in range(1, n):
        out[j:] |= s[: len(s) - j].astype(np.uint64) << np.uint64(16 * j)
    return out


def _suffix(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * n)) - 1)


def _ends(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the symbols to predict."""
    skip = np.zeros(len(s), dtype=bool)
    starts = first[:-1][np.diff(first) > 0]
    for j in range(ORDER - 1):
        skip[starts + j] = True
    return np.flatnonzero(~skip)


class KneserNey:
    """One language: per order sorted n-grams with interpolated probabilities, and sorted contexts with the mass left to the order below."""

    def __init__(self, texts: list[str]):
        s, first = symbols(texts)
        grams, counts = np.unique(codes(s, ORDER)[_ends(s, first)], return_counts=True)
        counts = counts.astype(np.float64)
        levels = [(grams, counts)]
        for n in range(ORDER - 1, 0, -1):  # below, each longer gram counts once
            keys, inverse = np.unique(_suffix(levels[-1][0], n), return_inverse=True)
            levels.append((keys, np.bincount(inverse, minlength=len(keys)).astype(np.float64)))
        levels.reverse()
        self.floor = 1.0 / (len(levels[0][0]) + 1)
        self.keys: list[np.ndarray] = []
        self.prob: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.mass: list[np.ndarray] = []
        for n, (keys, c) in enumerate(levels, 1):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, c), np.bincount(inverse)
            mass = d * kinds / total
            below = np.full(len(keys), self.floor) if n == 1 else self.prob[-1][np.searchsorted(self.keys[-1], _suffix(keys, n - 1))]
            self.keys.append(keys)
            self.prob.append(np.maximum(c - d, 0) / total[inverse] + mass[inverse] * below)
            self.contexts.append(contexts)
            self.mass.append(mass)


def _at(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return at, (keys[at] == x) if len(keys) else np.zeros(len(x), dtype=bool)


class Mixture:
    """All languages in shared sorted arrays; a row has one value per language."""

    def __init__(self, models: dict[str, KneserNey]):
        self.langs = sorted(models)
        of = [models[x] for x in self.langs]
        self.floor = np.log(np.array([m.floor for m in of], dtype=np.float32))
        self.keys, self.logs, self.contexts, self.back = [], [], [], []
        for n in range(ORDER):
            contexts = np.unique(np.concatenate([m.contexts[n] for m in of]))
            back = np.zeros((len(contexts), len(of)), dtype=np.float32)
            for j, m in enumerate(of):
                back[np.searchsorted(contexts, m.contexts[n]), j] = np.log(m.mass[n])
            keys = np.unique(np.concatenate([m.keys[n] for m in of]))
            self.contexts.append(contexts)
            self.back.append(back)
            logs = self._below(keys, n)
            for j, m in enumerate(of):
                logs[np.searchsorted(keys, m.keys[n]), j] = np.log(m.prob[n])
            self.keys.append(keys)
            self.logs.append(logs)

    def _below(self, x: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of (n + 1)-grams by the order below and the contexts' mass."""
        out = np.repeat(self.floor[None], len(x), 0) if n == 0 else self.log_prob(_suffix(x, n), n - 1)
        at, seen = _at(self.contexts[n], x >> np.uint64(16))
        out[seen] += self.back[n][at[seen]]
        return out

    def log_prob(self, x: np.ndarray, n: int = ORDER - 1) -> np.ndarray:
        at, seen = _at(self.keys[n], x)
        out = self.logs[n][at] if len(self.keys[n]) else np.zeros((len(x), len(self.langs)), np.float32)
        if not seen.all():
            rest = np.flatnonzero(~seen)
            out[rest] = self._below(x[rest], n)
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the sum of log probabilities; per text the number of symbols."""
        logs, n = self.by_symbol(texts)
        out = np.zeros((len(texts), len(self.langs)))
        if len(logs):
            has = np.flatnonzero(n)
            starts = np.concatenate([[0], np.cumsum(n[has])])[:-1]
            out[has] = np.add.reduceat(logs, starts, axis=0)
        return out, n

    def by_symbol(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities per symbol of all texts and language; per text the number of symbols."""
        s, first = symbols(texts)
        n = np.maximum(np.diff(first) - (ORDER - 1), 0)
        if not len(s):
            return np.zeros((0, len(self.langs))), n
        grams, inverse = np.unique(codes(s, ORDER)[_ends(s, first)], return_inverse=True)
        return self.log_prob(grams)[inverse].astype(np.float64), n


def pieces(logs: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Cross-entropies per symbol of pieces of `size` symbols, at most PIECES spread over each text."""
    sums = np.concatenate([[0.0], np.cumsum(logs)])
    starts = [a + np.linspace(0, k - size, min(PIECES, k // size)).astype(np.int64) for a, k in zip(np.cumsum(n) - n, n.tolist(), strict=True) if k >= size]
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (sums[at] - sums[at + size]) / size


class Identifier:
    """A mixture with the calibration of scores and rejection."""

    def __init__(self, samples: dict[str, list[str]], reject_at: float = REJECT_AT):
        samples = {k: t for k, v in sorted(samples.items()) if (t := [x for x in v if any(map(str.isalpha, x))])}
        self.langs, self.reject_at = sorted(samples), reject_at
        if not self.langs:
            return
        held = {k: v[::5] if len(v) >= 10 else v for k, v in samples.items()}
        part = Mixture({k: KneserNey([x for i, x in enumerate(v) if i % 5] if len(v) >= 10 else v) for k, v in samples.items()})
        self.middle, self.spread = np.zeros((len(self.langs), len(BANDS))), np.zeros((len(self.langs), len(BANDS)))
        margins = []
        for j, lang in enumerate(self.langs):
            sums, n = part.totals(held[lang])
            logs, _ = part.by_symbol(held[lang])
            middle, spread = np.median(-sums[:, j] / n), 1.0
            for k, size in enumerate(BANDS):
                entropy = pieces(logs[:, j], n, size)
                if len(entropy):
                    middle = np.median(entropy)
                    spread = max(1.4826 * np.median(np.abs(entropy - middle)) * np.sqrt(size), 1.0)  # of one symbol
                self.middle[j, k], self.spread[j, k] = middle, spread
            others = np.delete(sums, j, 1)
            margins.append(sums[:, j] - (others.max(1) if others.shape[1] else sums[:, j] - 50.0))
        margin = np.concatenate(margins)
        grid = np.array([1.0, 2.0, 4.0, 8.0, 16.0])
        self.heat = float(grid[np.argmin([np.logaddexp(0, -margin / t).mean() for t in grid])])
        self.mixture = Mixture({k: KneserNey(v) for k, v in samples.items()})

    def limit(self, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The most cross-entropy per symbol of texts of these languages (by number) and sizes."""
        at = np.interp(np.log2(size), np.log2(BANDS), np.arange(len(BANDS)))
        low = at.astype(np.int64)
        high, share = np.minimum(low + 1, len(BANDS) - 1), at - low
        between = lambda x: x[lang, low] * (1 - share) + x[lang, high] * share
        return between(self.middle) + self.reject_at * between(self.spread) / np.sqrt(np.minimum(size, BANDS[-1]))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy per symbol (nats), rejected."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        sums, n = self.mixture.totals(texts)
        size = np.maximum(n, 1)
        best = np.argmax(sums, 1)
        top = sums[np.arange(len(texts)), best]
        score = np.where(n > 0, 1.0 / np.exp((sums - top[:, None]) / self.heat).sum(1), 0.0)
        entropy = -top / size
        rejected = (n == 0) | (entropy > self.limit(best, size))
        return [self.langs[b] if k else UND for b, k in zip(best.tolist(), n.tolist(), strict=True)], score, entropy, rejected


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Identifier:
    """Learn from the `sample` labelled rows of each language with the least hash of their id (at most sample rows a language reach the driver)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    narrow = rows.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l")).distinct()
    share = F.least(F.lit(1.0), F.lit(4.0 * sample + 100) / F.count("*"))
    place = F.xxhash64("i").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    least = narrow.join(narrow.groupBy("l").agg(share.alias("share")), "l").where(place <= F.col("share"))  # about four times as many as are taken
    rank = F.row_number().over(Window.partitionBy("l").orderBy(place, "i"))
    chosen = least.withColumn("k", rank).where(F.col("k") <= sample).select("i", "l")
    texts = rows.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).join(F.broadcast(chosen), ["i", "l"])
    found: dict[str, dict[object, str]] = {}
    for r in texts.toLocalIterator():
        of = found.setdefault(r.l, {})
        of[r.i] = min(of.get(r.i, r.t), r.t)
    return Identifier({k: [v[i] for i in sorted(v, key=lambda x: (zlib.crc32(str(x).encode()), str(x)))] for k, v in found.items()})


def _predict(batches: Iterator[pa.RecordBatch], model: Identifier, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("__text")
        _, offsets = utf8(column)
        for a, b in row_groups(offsets, 1 << 19):
            part = batch.slice(a, b - a)
            lang, score, entropy, rejected = model.predict([x or "" for x in part.column("__text").to_pylist()])
            kept = [part.column(x).cast(fields.field(x).type) for x in part.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], schema=fields)


def identify(documents: DataFrame, model: Identifier, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: the columns in keep, lang_pred, score, cross_entropy and rejected, which win over columns in keep with their names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(documents.sparkSession)
    keep = passed(keep, ("lang_pred", "score", "cross_entropy", "rejected"))
    source = documents.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*(source.schema[x] for x in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    fields = to_arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(lambda it: _predict(it, shared.value, fields), schema)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents.where(~held_out(F.col("doc_id"))))
    return identify(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
