"""Benchmark decontamination by winnowing.

Both sides keep, of every run of WINDOW - K + 1 consecutive K-grams of words,
the one with the least hash. Any shared span of WINDOW words holds one such run
whole, so both sides keep the same K-gram of it: no span of that length is
missed. A kept K-gram that occurs on both sides is extended to the windows
around it, and these are compared word by word. Items of fewer words than a
window are one window of their own length; at a length of n, winnowing with
one n-gram a run keeps every n-gram, so the same guarantee holds.

Scale: documents are never shuffled. Items are dealt into blocks of about
`block_bytes` of text; a block's fingerprints and windows go to the executors as
sorted arrays of some 30 bytes a word. With more blocks than one the documents
are written once with a row number, searched once per block, and only the rows
with hits of later blocks are brought together by their number.

Defined results: null and empty texts have no words and no hits. Items without
id, or without words, never occur. Equal item ids count once. Rows with the
same doc_id stay separate rows. Other columns of documents are passed on only
if named in `keep`; of those with a name of the result the result's is returned.
Texts of any length are read whole. Empty tables give empty or clean results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.store import Scratch, passed, short_batches, small
from pageloom.llm.words import ALNUM, LOWER, Words, grams, row_groups, utf8, words

WINDOW, K = 10, 5
#: Text bytes of the items that are searched for in one pass over documents.
BLOCK_BYTES = 8 << 20


def winnow(h: np.ndarray, room: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of the k-grams kept. h: the k-grams' hashes; room: words from each word to its row's end."""
    run, n = window - k + 1, len(h) - (window - k)
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[run - 1 : run - 1 + n].copy(), np.full(n, run - 1, dtype=np.int8)
    for j in range(run - 2, -1, -1):
        x = h[j : j + n]
        less = x < best
        np.copyto(best, x, where=less)
        at[less] = j
    valid = np.flatnonzero(room[:n] >= window)
    kept = np.zeros(len(h), dtype=bool)
    kept[valid + at[valid]] = True
    return np.flatnonzero(kept)


def _room(w: Words) -> np.ndarray:
    return np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.start))


def _joined(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, lower-cased, each with one space after it, and the place of each."""
    size = (w.end - w.start).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(place[-1], 32, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place[:-1], size) + within] = LOWER[w.data[np.repeat(w.start, size) + within]]
    return out, place


class Benchmark:
    """Fingerprints and windows of a block of items, in sorted arrays; the windows' bytes lie in one buffer."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, k: int = K):
        self.window, self.k, self.ids = window, k, sorted({i for i, _ in items})
        number = {x: j for j, x in enumerate(self.ids)}
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        w = words(data, offsets, ALNUM)
        self.prints = np.unique(grams(w.hash, k)[winnow(grams(w.hash, k), _room(w), window, k)]) if len(w.start) >= window else np.zeros(0, np.uint64)
        self.text, place = _joined(w)
        own = np.array([number[i] for i, _ in items], np.int32)
        size = np.diff(w.first)
        item, length, room = np.repeat(own, size), np.repeat(np.minimum(size, window), size), _room(w)
        #: by length: hashes in order, and the windows' items, first bytes and ends
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(length).tolist():
            at = np.flatnonzero((length == n) & (room >= n))
            h = grams(w.hash, n)[at]
            order = np.argsort(h, kind="stable")
            at = at[order]
            self.windows[n] = h[order], item[at], place[at], place[at + n] - 1
        self.prints.flags.writeable = False

    def search(self, w: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """For each word, whether it is hit; for each row with hits, its items' numbers."""
        edges = np.zeros(len(w.start) + 1, dtype=np.int32)
        items: dict[int, set[int]] = defaultdict(set)
        if not len(w.start) or not self.windows:
            return edges[:-1] > 0, items
        room = _room(w)
        for n, (hashes, of, first, end) in self.windows.items():
            if len(w.start) < n:
                continue
            if n == self.window:
                kg = grams(w.hash, self.k)
                at = winnow(kg, room, n, self.k)
                at = at[_among(self.prints, kg[at])]
                near = (at[:, None] - np.arange(n - self.k + 1)).ravel()
                starts = np.unique(near[near >= 0])
                starts = starts[starts <= len(w.start) - n]
            else:
                starts = np.arange(len(w.start) - n + 1)
            starts = starts[room[starts] >= n]
            h = grams(w.hash, n)[starts]
            hit = _among(hashes, h)
            starts, h = starts[hit], h[hit]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            rows = np.searchsorted(w.first, starts, "right") - 1
            for s, a, b, row in zip(starts.tolist(), lo.tolist(), hi.tolist(), rows.tolist(), strict=True):
                text = w.bytes_of(s, s + n)
                same = [e for e in range(a, b) if self.text[first[e] : end[e]].tobytes() == text]
                if same:
                    edges[s] += 1
                    edges[s + n] -= 1
                    items[row].update(of[same].tolist())
        return np.cumsum(edges[:-1]) > 0, items


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def _search(batches: Iterator[pa.RecordBatch], index: Benchmark, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        n_words, n_hit, items, spans = [], [], [], []
        for a, b in row_groups(offsets):
            w = words(data, offsets[a : b + 1], ALNUM)
            hit, of = index.search(w)
            n_words.append(np.diff(w.first))
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_hit.append(np.diff(sums[w.first]))
            for row in range(b - a):
                items.append([index.ids[i] for i in sorted(of.get(row, ()))])
                if row in of:
                    x = np.diff(np.concatenate([[0], hit[w.first[row] : w.first[row + 1]].astype(np.int8), [0]]))
                    spans.append([{"first": int(p), "end": int(q)} for p, q in zip(np.flatnonzero(x == 1), np.flatnonzero(x == -1), strict=True)])
                else:
                    spans.append([])
        got = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n_hit)]
        kept = [batch.column(x) for x in batch.schema.names if x != "__text"]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, fields.field("spans").type)], fields, strict=True)], schema=fields)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about block_bytes, one at a time on the driver."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0]
    if not total:
        return
    n = -(-total * 5 // (4 * block_bytes))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else items
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of documents: the columns in keep, n_words, n_hit, items (ids, sorted as strings) and spans (hit runs of words, end exclusive)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = documents.sparkSession
    short_batches(spark)
    found = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))])

    def one(source: DataFrame, items: list[tuple[str, str]], names: list[str]) -> DataFrame:
        source = source.select(*names, "__text")
        schema = T.StructType([source.schema[x] for x in names] + found.fields)
        fields = to_arrow_schema(schema)
        index = spark.sparkContext.broadcast(Benchmark(items, window, k))
        return source.mapInArrow(lambda it: _search(it, index.value, fields), schema)

    keep = passed(keep, found.names)
    every = blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(every, []), next(every, None)
    if second is None:
        return one(documents.select(*keep, F.col(text_col).alias("__text")), first, list(keep))
    with Scratch(spark, "decontaminate") as scratch:
        packed = documents.select(F.struct(F.lit(0).alias("__none"), *keep).alias("__kept"), F.col(text_col).alias("__text"))
        numbered = scratch.keep(packed.withColumn("__row", F.monotonically_increasing_id()), "rows")
        later = [scratch.keep(one(numbered.select("__row", "__text"), items, ["__row"]).where("n_hit > 0"), f"hits-{i}") for i, items in enumerate((second, *every))]
        hits = later[0]
        for more in later[1:]:
            hits = hits.unionByName(more)
        flat = lambda x: F.flatten(F.collect_list(x))
        hits = scratch.keep(hits.groupBy("__row").agg(flat("items").alias("__items"), flat("spans").alias("__spans")), "hits")
    rows = one(numbered, first, ["__row", "__kept"]).join(small(hits), "__row", "left")
    spans = F.array_sort(F.concat("spans", "__spans"))
    merged = F.aggregate(
        spans,
        F.lit([]).cast("array<struct<first:bigint,end:bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["first"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    more = F.col("__spans").isNotNull()
    rows = rows.withColumn("spans", F.when(more, merged).otherwise(F.col("spans"))).withColumn("items", F.when(more, F.array_sort(F.array_distinct(F.concat("items", "__items")))).otherwise(F.col("items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    return rows.select(*(F.col("__kept")[x].alias(x) for x in keep), "n_words", n_hit.alias("n_hit"), "items", "spans")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS x
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, n, s, item_id FROM dw JOIN iw USING (n, x)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
