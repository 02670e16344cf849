"""Vector code compression: product codes of integer vectors, trained by tree aggregation.

Components become integers floor(scale * x). Vectors lie in columnar blocks, an
array of dimensions by vectors each, cut into `parts` equal runs of dimensions.
A part's codebook starts as that part of the `entries` smallest ids and goes
through `rounds` of assignment to the nearest entry and replacement by floored
means. A round is one treeAggregate over the RDD of blocks: in a block the
distances to all entries of a part accumulate dimension by dimension, np.add.at
adds assigned components and counts into int64 tensors, and these merge through
the reduction tree. All arithmetic is in integers, so results don't depend on
the order of blocks or merges. The first entries come the same way: each block
gives its smallest ids, the tree merges them.

Scale: vectors are never shuffled. Blocks are written once (4 bytes a
component) and read once a round; tasks send tensors of parts x entries x
components to the tree, which the driver gets merged, as it gets the codebooks,
whose size doesn't depend on the rows. A block is some `block_rows` vectors.
Errors by label are partial sums; the table of sums is broadcast only up to
a counted size.

Defined results: rows whose vector is null, or holds null or non-finite
components, are dropped. Rows of null id are coded but never start a codebook;
of rows with equal ids the least vector does. With fewer ids than entries
codebooks are shorter; without any (no rows, or all ids null) they are empty
and no row is coded. Ties go to the lower index; equal vectors get equal codes.
A vector of another length than the rest, a length that the parts don't divide,
or a scaled component beyond +-2**24 raises ValueError. Empty vectors have parts
without components: code 0, error 0. Other columns are passed on only
if named in `keep`; those with a name of the result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.store import Scratch, passed, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS = 4096
#: Of scaled components, so that squared distances and their sums stay within int64.
MOST = 1 << 24
#: Of rows whose distances are held at once.
STRIDE = 1024
MADE = ("code", "error", "label_error")


def _blocks(batches: Iterator[pa.RecordBatch], fields: pa.Schema, scale: float) -> Iterator[pa.RecordBatch]:
    """Rows of __id, __vec and others to a row per batch: the sound rows' ids, other columns, and vectors as int32, dimensions first."""
    for batch in batches:
        vec = batch.column("__vec")
        lists = vec.cast(pa.list_(pa.float64()))
        start = np.asarray(lists.offsets)
        flat = lists.values
        bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False)) if not flat.null_count else np.asarray(flat.is_null()) | ~np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False))
        sums = np.concatenate([[0], np.cumsum(bad)])
        rows = np.flatnonzero((sums[start[1:]] == sums[start[:-1]]) & np.asarray(lists.is_valid()))
        size = np.unique(start[rows + 1] - start[rows])
        if not len(rows):
            continue
        if len(size) > 1:
            raise ValueError(f"vectors of {size[0]} and {size[-1]} components")
        dims = int(size[0])
        x = np.floor(flat.fill_null(0).to_numpy(zero_copy_only=False)[start[rows][:, None] + np.arange(dims)] * scale)
        if x.size and np.abs(x).max() > MOST:
            raise ValueError(f"a scaled component is beyond {MOST}")
        taken = batch.take(pa.array(rows))
        made = {"__n": pa.array([len(rows)], pa.int32()), "__dims": pa.array([dims], pa.int32()), "__x": pa.array([np.ascontiguousarray(x.T.astype(np.int32)).tobytes()], pa.binary())}
        wrapped = {n: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), taken.column(n)) for n in batch.schema.names if n != "__vec"}
        made |= wrapped
        yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in fields], schema=fields)


def unpack(x: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(x, np.int32).reshape(dims, n)


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors (dimensions by vectors) the nearest entries (entries by dimensions) and squared distances; ties to the lower index."""
    code, error = np.empty(x.shape[1], np.int64), np.empty(x.shape[1], np.int64)
    for at in range(0, x.shape[1], STRIDE):
        part = x[:, at : at + STRIDE].astype(np.int64)
        far = np.zeros((len(book), part.shape[1]), np.int64)
        for values, of in zip(part, book.T, strict=True):
            apart = values - of[:, None]
            apart *= apart
            far += apart
        code[at : at + STRIDE] = far.argmin(axis=0)
        error[at : at + STRIDE] = far.min(axis=0)
    return code, error


def gather(x: np.ndarray, code: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add the vectors to the sums (dimensions by entries) and counts of their entries."""
    np.add.at(counts, code, 1)
    for values, of in zip(x, sums, strict=True):
        np.add.at(of, code, values)


def _round(block: tuple, books: np.ndarray, acc: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """The tensors (sums: parts, dimensions, entries; counts: parts, entries) with those of a block added."""
    parts, entries, width = books.shape
    sums, counts = acc or (np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64))
    x = unpack(*block)
    for p in range(parts):
        own = x[p * width : (p + 1) * width]
        gather(own, assign(own, books[p])[0], sums[p], counts[p])
    return sums, counts


def _merged(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    return a[0] + b[0], a[1] + b[1]


def _least(of: dict, n: int) -> dict:
    return {k: of[k] for k in sorted(of)[:n]}


def _smallest(a: tuple | None, b: tuple | None, n: int) -> tuple | None:
    """(number of components, {id: least vector} of the n smallest ids) of two such."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        raise ValueError(f"vectors of {min(a[0], b[0])} and {max(a[0], b[0])} components")
    both = dict(a[1])
    for k, v in b[1].items():
        both[k] = min(both[k], v) if k in both else v
    return a[0], _least(both, n)


def _seeds(row, n: int) -> tuple:
    x, found = unpack(row["__x"], row["__n"], row["__dims"]), {}
    ids = row["__id"]
    known = sorted({i for i in ids if i is not None})[:n]
    wanted = set(known)
    for j, i in enumerate(ids):
        if i in wanted:
            v = tuple(x[:, j].tolist())
            found[i] = min(found[i], v) if i in found else v
    return row["__dims"], found


def train(blocks: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, depth: int = 2) -> np.ndarray | None:
    """Codebooks (parts, entries, dimensions of a part) of a table of blocks; None if no id is known."""
    start = blocks.select("__id", "__n", "__dims", "__x").rdd.treeAggregate(None, lambda acc, row: _smallest(acc, _seeds(row, entries), entries), lambda a, b: _smallest(a, b, entries), depth)
    if start is None or not start[1]:
        return None
    dims, seeds = start
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    books = np.array([seeds[i] for i in sorted(seeds)], np.int64).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2).copy()
    columnar: RDD = blocks.select("__x", "__n", "__dims").rdd.map(tuple)
    for _ in range(rounds):
        sums, counts = columnar.treeAggregate(None, lambda acc, block, books=books: _round(block, books, acc), _merged, depth)
        used = counts > 0
        means = sums.transpose(0, 2, 1) // np.maximum(counts, 1)[:, :, None]
        books = np.where(used[:, :, None], means, books)
    return books


def _coded(batches: Iterator[pa.RecordBatch], fields: pa.Schema, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        for row in range(batch.num_rows):
            n, dims = batch.column("__n")[row].as_py(), batch.column("__dims")[row].as_py()
            x = unpack(batch.column("__x")[row].as_buffer(), n, dims)
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                code, far = assign(x[p * width : (p + 1) * width], books[p])
                codes[:, p] = code
                error += far
            text = codes.tobytes().hex()
            made = {"code": pa.array([text[i : i + 2 * parts] for i in range(0, 2 * parts * n, 2 * parts)]), "error": pa.array(error)}
            of = lambda name: batch.column(name)[row].values  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([(made[f.name] if f.name in made else of(f.name)).cast(f.type) for f in fields], schema=fields)


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components, decimal and comma-joined, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray | None]:
    """The sound rows with id, label, the columns in keep, code (two hex digits a part), error and label_error; and the codebooks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kept = [x for x in passed(keep, (*MADE, id_col, label_col))]
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.struct(F.lit(0).alias("__none"), *kept).alias("__kept"), F.col(vec_col).alias("__vec"))
    own = [rows.schema[x] for x in ("__id", "__label", "__kept")]
    packed = T.StructType([T.StructField("__n", T.IntegerType()), T.StructField("__dims", T.IntegerType()), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in own), T.StructField("__x", T.BinaryType())])
    packed_fields = to_arrow_schema(packed)
    setting, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(setting, str(block_rows))
    try:
        blocks = scratch.keep(rows.mapInArrow(lambda it: _blocks(it, packed_fields, scale), packed), "blocks")
    finally:
        spark.conf.set(setting, before)
    books = train(blocks, parts=parts, entries=entries, rounds=rounds)
    coded_schema = T.StructType([T.StructField(f.name, f.dataType) for f in own] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        coded = spark.createDataFrame([], coded_schema)
    else:
        fields = to_arrow_schema(coded_schema)
        coded = scratch.keep(blocks.mapInArrow(lambda it: _coded(it, fields, books), coded_schema), "coded")
    scratch.drop("blocks")
    sums = coded.groupBy(F.col("__label").alias("__of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(small(sums), F.col("__label").eqNullSafe(F.col("__of")))
    return out.select(F.col("__id").alias(id_col), F.col("__label").alias(label_col), *(F.col("__kept")[x].alias(x) for x in kept), "code", "error", "label_error"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    nearest = "min(list_sum([CAST((v.x[i] - c.x[i]) AS BIGINT) * (v.x[i] - c.x[i]) FOR i IN range(1, len(v.x) + 1)]) * 16 + k) AS m"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, p, {nearest} FROM v JOIN c{r} c USING (p) GROUP BY row, p)")
        if r < rounds:
            steps.append(f"u{r} AS (SELECT p, m % 16 AS k, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT row, p, m, x, unnest(range(1, len(x) + 1)) AS i FROM v JOIN a{r} USING (row, p)) GROUP BY p, m % 16, i)")
            steps.append(f"m{r} AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM u{r} GROUP BY p, k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.k, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON c{r}.p = m{r}.p AND c{r}.k = m{r}.k)")
    return f"""
WITH q AS (SELECT row_number() OVER () AS row, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT row, vec_id, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS x FROM q, (SELECT unnest(range(8)) AS p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM (SELECT DISTINCT vec_id FROM q WHERE vec_id IS NOT NULL)),
c0 AS MATERIALIZED (SELECT p, k, min(x) AS x FROM v JOIN s USING (vec_id) WHERE k < 16 GROUP BY p, k),
{", ".join(steps)},
e AS (SELECT row, string_agg(format('{{:02x}}', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS digest FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM q JOIN e USING (row), b
"""


#: Of rows with equal ids and different vectors it takes the least part, not the least vector, for codebooks to start with; ids are unique in the given tables.
SQL = _sql()
