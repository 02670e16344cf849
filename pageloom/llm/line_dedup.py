"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of each two lines in succession ends a chunk
where its remainder by AVERAGE_LINES is 0, so boundaries move with the lines
and shared passages fall into the same chunks. Of a chunk of two lines or more
that occurs more than once anywhere, the first occurrence (least id, then text
hash and place) stays, the others are removed, once all bytes under its 128-bit
key have been compared.

Chunks alone miss short shared passages, the edges of long ones and chunks of
one line. With whole_runs (op4 and the pipeline) each two lines in succession
that aren't both in one removed chunk are then compared the same way, so every
repeated run of two or more lines is found at its whole length: a line goes if
it and the line before or after it occur in succession earlier. The earliest
occurrence of a line always stays. Lines of no bytes don't count here. Where a
pair overlaps its first occurrence (three equal lines), that occurrence stays.

Scale: keys of chunks are aggregated without their texts; only texts of
repeated chunks are grouped to compare them, with partial aggregation, so a
chunk that a third of all rows share costs a row per task. Tables that go to
all executors have a counted size of at most BROADCAST_BYTES; beyond that they
are joined by shuffle. The tables joined on keys are computed before,
so Spark's skew join can split a key's rows.

Defined results: null and empty texts have no lines and stay. Lines of no bytes
belong to the chunk before them. Rows of equal id and text are one document
to this operator: what stays in one stays in the other. Columns beside id and
text pass through unchanged, but for those named n_lines and n_removed, whose
place the result's take. Texts of any length are read whole. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.store import Scratch, passed, short_batches, small
from pageloom.llm.words import grams, row_groups, utf8, words

AVERAGE_LINES = 3
IN_LINE = np.ones(256, dtype=bool)
IN_LINE[10] = False


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk: row, number of lines, first byte, end byte (up to the next chunk or the row's end)."""
    w = words(data, offsets, IN_LINE)
    n = len(w.start)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    head = np.ones(n, dtype=bool)
    head[1:] = row[1:] != row[:-1]
    if n > 2:
        cut = np.zeros(n, dtype=bool)  # a chunk ends with the line before
        cut[2:] = grams(w.hash, 2)[: n - 2] % np.uint64(AVERAGE_LINES) == 0
        cut[1:] &= ~head[:-1]  # the two lines are in one row
        head |= cut
    first = np.flatnonzero(head)
    own = row[first]
    last = np.concatenate([own[1:] != own[:-1], [True]]) if len(own) else np.zeros(0, bool)
    start = w.start[first]
    end = np.where(last, offsets[own + 1], np.concatenate([start[1:], [0]])) if len(own) else start
    start = np.where(np.concatenate([[True], own[1:] != own[:-1]]), offsets[own], start) if len(own) else start
    return own, np.diff(np.concatenate([first, [n]])), start, end


def _text(data: np.ndarray, a: int, b: int) -> bytes:
    """A chunk's lines, without the line ends around them."""
    return data[a:b].tobytes().strip(b"\n")


def _keys(batches: Iterator[pa.RecordBatch], fields: pa.Schema, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        for a, b in row_groups(offsets):
            row, lines, start, end = chunks(data, offsets[a : b + 1])
            place = np.arange(len(row)) - np.searchsorted(row, row)
            at = np.flatnonzero(lines > 1)
            texts = [_text(data, s, e) for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in texts), ">i8").reshape(-1, 2).astype(np.int64)
            out = [pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            if with_text:
                out.append(pa.array(texts, pa.binary()))
            else:
                take = pa.array(row[at] + a)
                out += [batch.column("__id").take(take), batch.column("__th").take(take), pa.array(place[at].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, fields, strict=True)], schema=fields)


def _gone_lines(gone: pa.Array, row: np.ndarray, lines: np.ndarray, n_rows: int) -> np.ndarray:
    """Per line: is it in a chunk of these places?"""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    drop = np.zeros(len(row), dtype=bool)
    for i, places in enumerate(gone.to_pylist()):
        if places:
            drop[first[i] + np.array(places)] = True
    return np.repeat(drop, lines)


def _pairs(batches: Iterator[pa.RecordBatch], fields: pa.Schema, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Each two lines in succession that aren't both in one removed chunk; with texts only those at the places __at."""
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        for a, b in row_groups(offsets):
            own = offsets[a : b + 1]
            w = words(data, own, IN_LINE)
            row = np.repeat(np.arange(b - a), np.diff(w.first))
            if with_text:
                at = [int(w.first[i]) + p for i, places in enumerate(batch.column("__at").slice(a, b - a).to_pylist()) for p in places]
                at = np.array(at, np.int64)
            else:
                chunk_row, lines, _, _ = chunks(data, own)
                gone = _gone_lines(batch.column("__gone").slice(a, b - a), chunk_row, lines, b - a)
                chunk = np.repeat(np.arange(len(lines)), lines)
                at = np.flatnonzero((row[1:] == row[:-1]) & ~((chunk[1:] == chunk[:-1]) & gone[1:]))
            view = memoryview(data)
            bounds = zip(w.start[at].tolist(), w.end[at].tolist(), w.start[at + 1].tolist(), w.end[at + 1].tolist(), strict=True) if len(at) else ()
            texts = [view[s:f] if t == e + 1 else view[s:e].tobytes() + b"\n" + view[t:f].tobytes() for s, e, t, f in bounds]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in texts), ">i8").reshape(-1, 2).astype(np.int64)
            out = [pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            if with_text:
                out.append(pa.array([bytes(x) for x in texts], pa.binary()))
            else:
                take = pa.array(row[at] + a)
                out += [batch.column("__id").take(take), batch.column("__th").take(take), pa.array((at - w.first[row[at]]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, fields, strict=True)], schema=fields)


def _cut(batches: Iterator[pa.RecordBatch], fields: pa.Schema, text_at: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        for a, b in row_groups(offsets):
            part, own = batch.slice(a, b - a), offsets[a : b + 1]
            row, lines, _, _ = chunks(data, own)
            drop = _gone_lines(part.column("__gone"), row, lines, b - a)
            w = words(data, own, IN_LINE)
            texts, n_removed = [], np.zeros(b - a, np.int64)
            for i, (text, pairs) in enumerate(zip(part.column("__text"), part.column("__runs").to_pylist(), strict=True)):
                x, y = int(w.first[i]), int(w.first[i + 1])
                for code in pairs or ():  # twice the place, and one more where the first line stays
                    drop[x + code // 2 + code % 2 : x + code // 2 + 2] = True
                n_removed[i] = drop[x:y].sum()
                if n_removed[i]:
                    start = [int(own[i]), *w.start[x + 1 : y].tolist(), int(own[i + 1])]
                    kept = b"".join(data[start[j] : start[j + 1]].tobytes() for j in np.flatnonzero(~drop[x:y]).tolist())
                    texts.append(kept.decode().removesuffix("\n") if drop[y - 1] else kept.decode())
                else:
                    texts.append(text.as_py())
            made = {text_at: pa.array(texts, fields.field(text_at).type), "n_lines": pa.array(np.diff(w.first).astype(np.int64)), "n_removed": pa.array(n_removed)}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in fields], schema=fields)


def _with(rows: DataFrame, id_col: str, table: DataFrame, how: str) -> DataFrame:
    """The rows with the columns that the table has for their id and text hash."""
    right = small(table.withColumnsRenamed({"__id": "__i", "__th": "__t"}))
    return rows.join(right, rows[id_col].eqNullSafe(right["__i"]) & (rows["__th"] == right["__t"]), how).drop("__i", "__t")


def _repeated(found: DataFrame) -> DataFrame:
    return found.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__th", "place")).alias("first")).where("n > 1")


def _equal(repeated: DataFrame, texts: DataFrame) -> DataFrame:
    """The repeated keys under which all bytes are equal."""
    compared = texts.groupBy("k1", "k2", "chunk").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("kinds")).where("kinds = 1")
    return repeated.join(compared.select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", "first")


def _later(found: DataFrame, equal: DataFrame) -> DataFrame:
    return found.join(small(equal), ["k1", "k2"]).where(~F.struct("__id", "__th", "place").eqNullSafe(F.col("first")))


def dedup_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", whole_runs: bool = False) -> DataFrame:
    """The documents with repeated chunks (and with whole_runs all repeated runs of lines) removed from their text, and n_lines and n_removed (lines)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = documents.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "lines")
    id_type = documents.schema[id_col].dataType
    key = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
    place = T.StructType([*key, T.StructField("__id", id_type), T.StructField("__th", T.LongType()), T.StructField("place", T.IntegerType())])
    with_text = T.StructType([*key, T.StructField("chunk", T.BinaryType())])
    narrow = documents.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__text"))

    place_fields, text_fields = to_arrow_schema(place), to_arrow_schema(with_text)
    found = scratch.hold(narrow.mapInArrow(lambda it: _keys(it, place_fields, False), place), "places")
    repeated = scratch.hold(_repeated(found), "repeated")
    texts = narrow.select("__text").mapInArrow(lambda it: _keys(it, text_fields, True), with_text).join(small(repeated.select("k1", "k2")), ["k1", "k2"])
    equal = scratch.hold(_equal(repeated, texts), "equal")
    gone = scratch.keep(_later(found, equal).groupBy("__id", "__th").agg(F.collect_set("place").alias("__gone")), "gone")
    scratch.drop("places", "repeated", "equal")
    removed = gone.withColumn("__runs", F.lit(None).cast("array<int>"))

    if whole_runs:  # what the chunks' edges and chunks of one line leave, by each two lines in succession
        pairs = scratch.hold(_with(narrow, "__id", gone, "left").mapInArrow(lambda it: _pairs(it, place_fields, False), place), "pairs")
        repeated = scratch.hold(_repeated(pairs), "repeated-pairs")
        at = scratch.keep(pairs.join(small(repeated.select("k1", "k2")), ["k1", "k2"]).groupBy("__id", "__th").agg(F.collect_set("place").alias("__at")), "at")
        texts = _with(narrow, "__id", at, "inner").select("__text", "__at").mapInArrow(lambda it: _pairs(it, text_fields, True), with_text)
        equal = scratch.hold(_equal(repeated, texts), "equal-pairs")
        overlaps = F.struct("__id", "__th", F.col("place") - 1).eqNullSafe(F.col("first"))  # the first occurrence's second line stays
        codes = _later(pairs, equal).withColumn("code", 2 * F.col("place") + overlaps.cast("int"))
        runs = codes.groupBy("__id", "__th").agg(F.collect_set("code").alias("__runs"))
        both = removed.unionByName(runs.withColumn("__gone", F.lit(None).cast("array<int>")))
        removed = scratch.keep(both.groupBy("__id", "__th").agg(F.first("__gone", True).alias("__gone"), F.first("__runs", True).alias("__runs")), "removed")
        scratch.drop("pairs", "repeated-pairs", "at", "equal-pairs", "gone")

    others = [x for x in passed(documents.columns, ("n_lines", "n_removed")) if x != text_col]
    packed = documents.select(F.col(id_col).alias("__key"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__text"), F.struct(F.lit(0).alias("__none"), *others).alias("__kept"))
    joined = _with(packed, "__key", removed, "left").select("__kept", "__text", "__gone", "__runs")
    schema = T.StructType([joined.schema["__kept"], T.StructField("__out", documents.schema[text_col].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    fields = to_arrow_schema(schema)
    cut = joined.mapInArrow(lambda it: _cut(it, fields, "__out"), schema)
    return cut.select(*(F.col("__out").alias(x) if x == text_col else F.col("__kept")[x].alias(x) for x in documents.columns if x == text_col or x in others), "n_lines", "n_removed")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), whole_runs=True)
