"""Near-dedup by bottom-k sketches.

A document's set is its distinct 2-word shingles. Documents of equal sets form a
class at once. Of each class the `sketch` least shingle hashes are retained.
Inverted lists of retained values give candidates, a signature of the sketch and
then the estimate from the union of two sketches filter them, and the Jaccard
similarity of the whole sets of words, compared as bytes, decides. Components of
the links give the groups.

Candidates without quadratic lists. Two sets of similarity 0.8 share at least
half of their retained values, but for a chance of about 1e-8 at 64 of them
(whole sets of up to `whole` shingles: surely 4/5 of them); with sketch=None
whole sets are retained, and nothing is left to chance. So with all values in
one order, two such sketches share at least OVERLAPS values among the first
`retained - shared + OVERLAPS` of each; only these are indexed. The order is by
how often values are retained, rarest first, so that common shingles hardly ever
are: counted over all classes in COUNTERS counters, which go to the executors as
a byte each (their logarithm), whatever the size of the corpus. Values that fall
into one counter count together; that makes lists longer, never misses a pair.
  1. In each list every member of a fitting size is compared with the least one
     (a pair a row); of three members the other two as well.
  2. Members of longer but still short lists that aren't connected yet are
     compared in pairs.
  3. Long lists whose members aren't all connected are dealt in blocks of BLOCK
     rows; a task compares two blocks by size and signature, and what these
     can't exclude by sketches and at last by whole sets. Each pair counts in
     one list only, that of the least value which both index. At most one link
     for each two connected parts comes of a task.
Nothing is capped or sampled.

Signatures. A sketch's values flip bits of 256; those of two sketches differ in
at most as many bits as values are in one of them only. So what a signature
excludes can't share enough, and 32 bytes a side tell most pairs apart before
any sketch is fetched.

Scale: equal sets are aggregated before anything is compared. Signatures and
sketches travel with pairs of fitting size, a text once per pair and once per
PARTNERS partners. Sides of skewed joins are tables computed before, so that
Spark can split them. They are written to the shared folder, but for small ones
that the executors hold and compute again if one is lost. Tables sent to all
executors are counted and of at most BROADCAST_BYTES. No link or component
reaches the driver. Within a family of near copies that are too different to
link, step 3 deals each member to size / BLOCK tasks and compares there.

Defined results: null and empty texts have no shingles, are linked with nothing
and are kept. Every row is a document of its own; rows of equal id have the
shingles of their own text (SQL below takes ids for unique). The least id of a
component names it; null ids name none unless alone. Only the id column is
passed on, so other columns can't clash; an id column with a result's name is an
error. Texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.store import Scratch, fresh, short_batches, small
from pageloom.llm.words import NONSPACE, grams, mix, row_groups, utf8, words

SKETCH, OVERLAPS = 64, 4
SHORT_LIST, BLOCK, COLUMNS, PARTNERS = 16, 8192, 1024, 64
#: Rows and shingles of whole sets that one block of the last comparison holds; rows compared at once.
BLOCK_TEXTS, BLOCK_SHINGLES, TILE = 2048, 2_000_000, 1024
#: Classes' numbers end in their size band: bands are a factor of STEP wide, fitting sizes at most APART bands apart.
BANDS, STEP, APART = 128, 1.15, 2
#: Counters of retained values, a byte each for the executors; parts that are summed by themselves.
COUNTERS, PART, SHIFT = 1 << 23, 1 << 17, np.uint32(9)
RESULT = ("n_shingles", "component_id", "kept")
SIGNATURE = ("s0", "s1", "s2", "s3")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per row the sorted distinct hashes (signed) of its 2-word shingles; of its word if it has only one."""
    w = words(data, offsets, NONSPACE, sound=True)
    pairs = grams(w.hash, 2)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        own = pairs[a : b - 1] if b - a > 1 else mix(w.hash[a:b])
        out.append(np.unique(own.view(np.int64)))
    return out


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """The set itself."""
    w = text.translate(_LOWER).split()
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()


def signature(sketch: np.ndarray) -> list[int]:
    """256 bits as four signed numbers; each value flips one."""
    at = (mix(sketch.view(np.uint64)) >> np.uint64(56)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=256).astype(np.uint8) & 1).view(np.int64).tolist()


def _sketches(batches: Iterator[pa.RecordBatch], fields: pa.Schema, sketch: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        for a, b in row_groups(offsets):
            sets = shingle_sets(data, offsets[a : b + 1])
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)
            signed = np.array([signature(s[:sketch]) for s in sets], np.int64).reshape(-1, 4)
            columns = [batch.column("id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *(pa.array(signed[:, i]) for i in range(4)), pa.array([s[:sketch] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def similar(shared, a, b):
    """Is the similarity of sets of a and b shingles with that many shared 0.8 or more?"""
    return 100 * shared >= 80 * (a + b - shared)


class Limits:
    """What two sets of similarity 0.8 share of their retained values."""

    def __init__(self, sketch: int | None):
        self.sketch = sketch
        self.half = None if sketch is None else sketch // 2
        self.whole = None if sketch is None else sketch * 4 // 5

    def retained(self, n: Column) -> Column:
        return n if self.sketch is None else F.least(n, F.lit(self.sketch))

    def shared(self, n: Column) -> Column:
        """Values that a set of n shingles surely (or but for the chance above) shares with one similar to it."""
        own = F.ceil(n * 4 / 5).cast("int")
        return own if self.sketch is None else F.when(n <= self.whole, own).otherwise(self.half)

    def flips(self, a: Column, b: Column) -> Column:
        """Bits in which the signatures of two similar sets differ at most."""
        return self.retained(a) + self.retained(b) - 2 * F.greatest(self.shared(a), self.shared(b))

    def shared_of(self, n: np.ndarray) -> np.ndarray:
        own = -(-n * 4 // 5)
        return own if self.sketch is None else np.where(n <= self.whole, own, self.half)

    def retained_of(self, n: np.ndarray) -> np.ndarray:
        return n if self.sketch is None else np.minimum(n, self.sketch)


def fitting(a, b):
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def band(n: Column) -> Column:
    """Sizes of fitting sets lie at most APART bands apart."""
    return F.least(F.floor(F.ln(n.cast("double")) / F.ln(F.lit(STEP))), F.lit(BANDS - 1))


def _keys(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The retained values of all rows as 32 bits; values of a set that clash count as one. Their rows."""
    sizes = pc.list_value_length(sketches).to_numpy(zero_copy_only=False)
    return (mix(sketches.flatten().to_numpy().view(np.uint64)) >> np.uint64(32)).astype(np.uint32), np.repeat(np.arange(len(sketches)), sizes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often values are retained, in COUNTERS counters by the values' first bits, dealt in parts."""
    counts = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        keys, _ = _keys(batch.column(0))
        at, n = np.unique(keys >> SHIFT, return_counts=True)
        counts[at] += n.astype(np.uint32)
    for part in range(COUNTERS // PART):
        own = counts[part * PART : (part + 1) * PART]
        if own.any():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["part", "counts"])


def _total(table: pa.Table) -> pa.Table:
    """A part's sums, by their logarithm: a byte a counter."""
    total = np.zeros(PART, np.uint64)
    for counts in table.column("counts"):
        total += np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
    level = np.minimum(np.round(4 * np.log2(total + 1.0)), 255).astype(np.uint8)
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([level.tobytes()], pa.binary())})


def _rarest(batches: Iterator[pa.RecordBatch], levels: np.ndarray, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Of each class the values to index: the rarest by their counters, as many as any similar sketch must share OVERLAPS of."""
    for batch in batches:
        keys, row = _keys(batch.column("sketch"))
        n = batch.column("n").to_numpy().astype(np.int64)
        order = np.lexsort((keys, levels[keys >> SHIFT], row))
        keys, row = keys[order], row[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        keys, row = keys[new], row[new]
        shared = limits.shared_of(n)
        take = limits.retained_of(n) - shared + np.minimum(OVERLAPS, shared)
        use = np.arange(len(keys)) - np.searchsorted(row, row) < take[row]
        offsets = np.searchsorted(row[use], np.arange(batch.num_rows + 1)).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[use].view(np.int32)))
        yield pa.record_batch([batch.column("c"), batch.column("n"), values], ["c", "n", "values"])


def _verify(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows a, part, b, text sorted by these, where b is null in the row with the text of a: the pairs that are similar."""
    mine, own, own_set = None, np.zeros(0, np.int64), set()
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        a_of, b_of = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        found = []
        for lo, hi in row_groups(offsets):
            for i, x in zip(range(lo, hi), shingle_sets(data, offsets[lo : hi + 1]), strict=True):
                raw = data[offsets[i] : offsets[i + 1]]
                if b_of[i] is None:
                    mine, own, own_set = raw.tobytes(), x, None
                elif similar(len(np.intersect1d(own, x, assume_unique=True)), len(own), len(x)):
                    own_set = shingles(mine) if own_set is None else own_set
                    other = shingles(raw.tobytes())
                    if similar(len(own_set & other), len(own_set), len(other)):
                        found.append((a_of[i], b_of[i]))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], schema=fields)


def groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys in sorted rows, each as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(held) and any(h.column(k)[0].as_py() != batch.column(k)[0].as_py() for h in held[:1] for k in key)
        starts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            if new[a] and held:
                yield pa.concat_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _sides(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The two blocks' rows; within one block each row with the later ones only."""
    block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def _fits(n: np.ndarray, part: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = n[x][:, None], n[y][None]
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (part[x][:, None] != part[y][None])


def _tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(left), TILE):
        for b in range(0, len(right), TILE):
            yield left[a : a + TILE], right[b : b + TILE]


def _by_signature(table: pa.RecordBatch, limits: Limits) -> np.ndarray:
    """Rows that size, part and signature don't exclude from a link between the two blocks."""
    keep = np.zeros(table.num_rows, dtype=bool)
    n, part = table.column("n").to_numpy().astype(np.int64), table.column("part").to_numpy()
    bits = np.stack([table.column(s).to_numpy() for s in SIGNATURE], 1).view(np.uint64)
    has, shared = limits.retained_of(n), limits.shared_of(n)
    for x, y in _tiles(*_sides(table)):
        fit = _fits(n, part, x, y)
        p, q = np.nonzero(fit)
        if not len(p):
            continue
        p, q = x[p], y[q]
        differ = np.bitwise_count(bits[p] ^ bits[q]).sum(1)
        hit = differ <= has[p] + has[q] - 2 * np.maximum(shared[p], shared[q])
        keep[p[hit]] = keep[q[hit]] = True
    return keep


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared values of each left with each right row, by products of incidence matrices of COLUMNS values at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not sets:
        return out
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[at]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for lo in range(0, int((counts > 1).sum()), COLUMNS):
        a, b = np.searchsorted(place, [lo, lo + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[a:b], place[a:b] - lo] = 1
        out += has[left] @ has[right].T
    return out


def _by_sketch(table: pa.RecordBatch, limits: Limits) -> np.ndarray:
    """Rows that their sketches don't exclude, in the one list that counts for the pair: no lesser value is indexed by both."""
    keep = np.zeros(table.num_rows, dtype=bool)
    n, part, v = table.column("n").to_numpy().astype(np.int64), table.column("part").to_numpy(), table.column("v")[0].as_py()
    sets = [x.values.to_numpy() for x in table.column("sketch")]
    indexed = [x.values.to_numpy() for x in table.column("values")]
    lesser = [x[x < v] for x in indexed]
    need = limits.shared_of(n)
    for x, y in _tiles(*_sides(table)):
        hit = _fits(n, part, x, y)
        if not hit.any():
            continue
        use = np.unique(np.concatenate([x[hit.any(1)], y[hit.any(0)]]))
        at = np.full(table.num_rows, -1)
        at[use] = np.arange(len(use))
        px, py = x[hit.any(1)], y[hit.any(0)]
        shared = _overlaps([sets[r] for r in use], at[px], at[py]).astype(np.int64)
        fit = _fits(n, part, px, py) & (shared >= np.maximum(need[px][:, None], need[py][None]))
        fit &= _overlaps([lesser[r] for r in use], at[px], at[py]) == 0
        keep[px[fit.any(1)]] = True
        keep[py[fit.any(0)]] = True
    return keep


def _filtered(batches: Iterator[pa.RecordBatch], fields: pa.Schema, rule: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ("v", "i", "j")):
        keep = rule(table)
        if keep.any():
            yield table.filter(pa.array(keep)).select(fields.names)


def _link(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole sets between parts, at most one for each two parts that they join."""
    left, right = _sides(table)
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return none, none
    part, c = table.column("part").to_numpy(), table.column("c").to_numpy()
    data, offsets = utf8(table.column("text"))
    sets = [s for x, y in row_groups(offsets) for s in shingle_sets(data, offsets[x : y + 1])]
    n = np.array([len(s) for s in sets])
    shared = _overlaps(sets, left, right).astype(np.int64)
    x, y = np.nonzero(similar(shared, n[left][:, None], n[right][None]) & (part[left][:, None] != part[right][None]))
    x, y = left[x], right[y]
    parent: dict[int, int] = {}

    def root(p: int) -> int:
        while (q := parent.get(p, p)) != p:
            parent[p] = p = parent.get(q, q)
        return p

    exact: dict[int, set] = {}

    def of(row: int) -> set:
        if row not in exact:
            exact[row] = shingles(data[offsets[row] : offsets[row + 1]].tobytes())
        return exact[row]

    chosen = []
    for k in range(len(x)):
        p, q = root(int(part[x[k]])), root(int(part[y[k]]))
        if p != q and similar(len(of(int(x[k])) & of(int(y[k]))), len(of(int(x[k]))), len(of(int(y[k])))):
            parent[max(p, q)] = min(p, q)
            chosen.append(k)
    return c[x[chosen]], c[y[chosen]]


def _links(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ("v", "i", "j")):
        a, b = _link(table)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=fields)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """c and root, the least node connected with it, for all nodes of edges (a, b): alternating large and small stars."""
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges-0")
    state, step = None, 0
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            return now.select(F.col("u").alias("c"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        state, step = tuple(found), step + 1
        both = now.union(now.select("v", "u"))
        least = scratch.hold(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"least-{step}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u <> v").distinct(), f"large-{step}")
        low = scratch.hold(large.groupBy("u").agg(F.min("v").alias("m")), f"low-{step}")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        old, now = f"edges-{step - 1}", scratch.keep(small.where("u <> v").distinct(), f"edges-{step}")
        scratch.drop(old, f"least-{step}", f"large-{step}", f"low-{step}")


def dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of lists v, each in as many pairs of blocks i, j as its list has blocks."""
    several = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("c"), F.col("blocks")))
    pair = lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"))
    return several.withColumn("ij", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))).select("*", "ij.i", "ij.j").drop("ij", "blocks")


class Found:
    """The rows' sets and the components of their classes: f1, f2 name a class."""

    def __init__(self, sets: DataFrame, answer: DataFrame, scratch: Scratch):
        self.sets, self.answer, self.scratch = sets, answer, scratch


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> Found:
    scratch = Scratch(documents.sparkSession, "near")
    with scratch:
        return _find(documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("__text")), scratch, Limits(sketch))


def _find(rows: DataFrame, scratch: Scratch, limits: Limits) -> Found:
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(rows.sparkSession)
    keep, hold, sketch = scratch.keep, scratch.hold, limits.sketch
    number = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    schema = T.StructType([rows.schema["id"], *number("th"), T.StructField("n", T.IntegerType()), *number("f1", "f2", *SIGNATURE), T.StructField("sketch", T.ArrayType(T.LongType()))])
    fields = to_arrow_schema(schema)
    wide = keep(rows.mapInArrow(lambda it: _sketches(it, fields, sketch), schema), "wide")

    # one row for each distinct set
    first = [F.first(x).alias(x) for x in ("n", *SIGNATURE, "sketch")]
    classes = wide.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.min(F.struct("id", "th")).alias("of"), *first)
    # the last digits of a class's number tell its size
    classes = keep(classes.withColumn("c", F.monotonically_increasing_id() * BANDS + band(F.col("n"))), "classes")
    sets = keep(wide.select("id", "th", "n", "f1", "f2"), "sets")
    scratch.drop("wide")

    # the rarest retained values of each, by list
    rarity = keep(classes.select("sketch").mapInArrow(_count, "part int, counts binary"), "rarity").groupBy("part").applyInArrow(_total, "part int, counts binary")
    levels = np.zeros(COUNTERS, np.uint8)
    for part in rarity.toLocalIterator():  # COUNTERS bytes in all
        levels[part.part * PART : (part.part + 1) * PART] = np.frombuffer(part.counts, np.uint8)
    levels = rows.sparkSession.sparkContext.broadcast(levels)
    index_schema = "c bigint, n int, values array<int>"
    indexed = keep(classes.select("c", "n", "sketch").mapInArrow(lambda it: _rarest(it, levels.value, limits), index_schema), "indexed")
    lists = indexed.select("c", "n", F.explode("values").alias("v"))
    heads = lists.groupBy("v").agg(F.count("*").alias("size"), F.min("c").alias("head"), F.max("c").alias("tail")).where("size > 1")
    heads = keep(heads, "heads")
    listed = keep(lists.join(heads, "v"), "listed")
    scratch.drop("rarity", "heads")

    signed = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), *(F.col(s).alias(f"{s}_{x}") for s in SIGNATURE))

    def estimated(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs a, b that sizes, signatures and then sketches don't exclude."""
        differ = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SIGNATURE), F.lit(0))
        near = pairs.join(signed("a"), "a").join(signed("b"), "b").where(fitting(F.col("n_a"), F.col("n_b")) & (differ <= limits.flips(F.col("n_a"), F.col("n_b"))))
        near = keep(near.select("a", "b", "n_a", "n_b"), f"{name}-near")
        ends = small(keep(near.select(F.col("a").alias("c")).union(near.select("b")).distinct(), f"{name}-ends"))
        sketches = keep(classes.select("c", "sketch").join(ends, "c"), f"{name}-sketches")
        sketched = lambda x: sketches.select(F.col("c").alias(x), F.col("sketch").alias(f"s_{x}"))
        both = near.join(sketched("a"), "a").join(sketched("b"), "b").withColumn("shared", F.array_intersect("s_a", "s_b"))
        exact = similar(F.size("shared"), F.col("n_a"), F.col("n_b"))
        if sketch is None:
            return both.where(exact).select("a", "b")
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, sketch)
        estimate = F.size(F.array_intersect("shared", union)) * sketch >= F.size(union) * limits.half
        return both.where(F.when(F.greatest("n_a", "n_b") <= sketch, exact).otherwise(estimate)).select("a", "b")

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        pairs = keep(candidates, f"{name}-candidates")
        parts = small(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")))
        pairs = keep(pairs.join(parts, "a").select("a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), "b"), f"{name}-pairs")
        wanted = pairs.select("a", "part", "b", F.col("b").alias("c")).union(pairs.select("a", "part", F.lit(None).cast("long"), "a").distinct())
        texts = text_of(wanted.select("a", "part", "b", "c"), ["a", "part", "b"])
        texts = texts.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        links = keep(texts.select("a", "b", "text").mapInArrow(lambda it: _verify(it, pair), "a bigint, b bigint"), name)
        scratch.drop(*(f"{name}-{x}" for x in ("near", "ends", "sketches", "candidates", "pairs")))
        return links

    def text_of(needed: DataFrame, key: list[str]) -> DataFrame:
        """The rows needed with the text of their class c; of several equal texts one."""
        of = needed.join(classes.select("c", F.col("of.id").alias("__i"), F.col("of.th").alias("__t")), "c")
        of = small(keep(of.select(*key, "__i", "__t"), f"of-{len(asked)}"))
        asked.append(of)
        found = rows.join(of, rows["id"].eqNullSafe(of["__i"]) & (rows["th"] == of["__t"]))
        return found.groupBy(*key).agg(F.first(F.coalesce("__text", F.lit(""))).alias("text"))

    asked: list[DataFrame] = []

    # 1: with the least member of each list; lists of up to three members are done by that
    both = lambda a, b, when: F.when(when & (F.abs(a % BANDS - b % BANDS) <= APART), F.struct(a.alias("a"), b.alias("b")))
    own, head, tail = F.col("c"), F.col("head"), F.col("tail")
    with_head = both(head, own, own != head)
    with_tail = both(own, tail, (F.col("size") == 3) & (own != tail) & (own != head))
    pairs = listed.select(F.explode(F.filter(F.array(with_head, with_tail), lambda x: x.isNotNull())).alias("p")).select("p.*").distinct()
    links = verified(estimated(hold(pairs, "first-raw"), "first"), "first")
    scratch.drop("first-raw")
    label = hold(links.groupBy("b").agg(F.min("a").alias("a")), "label")
    above = label.select(F.col("b").alias("a"), F.col("a").alias("top"))
    parts = keep(label.join(above, "a", "left").select(F.col("b").alias("c"), F.coalesce("top", "a").alias("part")), "parts")
    placed = listed.where("size > 3").join(small(parts), "c", "left").select("v", "c", "n", "size", F.coalesce("part", "c").alias("part"))
    placed = keep(placed, "placed")
    open_lists = placed.groupBy("v").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("v")
    placed = keep(placed.join(small(keep(open_lists, "open-lists")), "v", "left_semi"), "open")
    scratch.drop("listed", "label", "placed", "open-lists")

    # 2: short lists, in pairs. Pairs of different parts share open lists only, or were compared in step 1
    long_ones = placed.where(F.col("size") > SHORT_LIST)
    in_long = long_ones.groupBy("c").agg(F.count("*").alias("in_long"))
    short = placed.where(F.col("size") <= SHORT_LIST).join(small(keep(in_long, "in-long")), "c", "left").select("v", F.struct("c", "part", "n", F.coalesce("in_long", F.lit(0)).cast("int").alias("in_long")).alias("m"))
    members = short.groupBy("v").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    later = lambda x: F.filter("ms", lambda y: (y["c"] > x["c"]) & (y["part"] != x["part"]) & fitting(x["n"], y["n"]))
    pairs = F.flatten(F.transform("ms", lambda x: F.transform(later(x), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b"), x["n"].alias("n_a"), y["n"].alias("n_b"), F.least(x["in_long"], y["in_long"]).alias("in_long")))))
    ell = F.least(F.lit(OVERLAPS), limits.shared(F.least("n_a", "n_b")))
    second = members.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b", "n_a", "n_b", "in_long").agg(F.count("*").alias("k")).where(F.col("k") + F.col("in_long") >= ell).select("a", "b")
    more = verified(estimated(hold(second, "second-raw"), "second"), "second")
    scratch.drop("second-raw", "in-long")

    # 3: long lists, in blocks
    def blocked(table: DataFrame, extra: list[str], rule: Callable[[pa.RecordBatch], np.ndarray], name: str) -> DataFrame:
        """The rows that the rule keeps, by list and pair of blocks."""
        out = "v int, i int, j int, block int, c bigint, part bigint, n int"
        kept = pa.schema([("v", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("c", pa.int64()), ("part", pa.int64()), ("n", pa.int32())])
        sorted_rows = table.select(*kept.names, *extra).repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
        return keep(sorted_rows.mapInArrow(lambda it: _filtered(it, kept, rule), out), name)

    long_rows = dealt(long_ones, F.ceil(F.col("size") / BLOCK).cast("int")).join(classes.select("c", *SIGNATURE), "c")
    near = blocked(long_rows, list(SIGNATURE), lambda t: _by_signature(t, limits), "third-near")
    near = near.join(classes.select("c", "sketch"), "c").join(indexed.select("c", "values"), "c")
    may = blocked(near, ["sketch", "values"], lambda t: _by_sketch(t, limits), "third-may")
    members = may.select("v", "c", "part", "n").distinct()
    members = keep(members, "third-members")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int")
    sizes = members.groupBy("v").agg(blocks.alias("blocks"))
    last = dealt(members.join(small(keep(sizes, "third-sizes")), "v").drop("n"), F.col("blocks"))
    texts = text_of(last, ["v", "i", "j", "block", "part", "c"]).repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest = keep(texts.mapInArrow(lambda it: _links(it, pair), "a bigint, b bigint"), "third")
    scratch.drop("open", "indexed", "third-near", "third-may", "third-members", "third-sizes")

    roots = components(links.union(more).union(rest), scratch)
    rooted = hold(classes.select("c", "f1", "f2", "id").join(small(roots), "c", "left").withColumn("root", F.coalesce("root", "c")), "rooted")
    named = hold(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "named")
    answer = keep(rooted.join(named, "root").select("f1", "f2", "root", "component_id"), "answer")
    scratch.drop("classes", "rooted", "named", "parts", "first", "second", "third", *(f"of-{i}" for i in range(len(asked))))
    return Found(sets, answer, scratch)


def near_dedup(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id connected) and kept (the two ids are equal)."""
    fresh([id_col], RESULT)
    found = find(documents, id_col=id_col, text_col=text_col, sketch=sketch)
    rows = found.sets.join(found.answer, ["f1", "f2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """The documents with all their columns, of each component one row: that with the least id (null ids last), of
    equal ids the least hash of the text, of rows repeated in both one. Rows without shingles all stay."""
    found = find(documents, id_col=id_col, text_col=text_col, sketch=sketch)
    scratch = found.scratch
    with scratch:
        rank = F.struct(F.col("id").isNull().alias("last"), "id", "th")
        rows = found.sets.where("n > 0").join(found.answer, ["f1", "f2"])
        chosen = scratch.keep(rows.groupBy("root").agg(F.min(rank).alias("one")).select("one.id", "one.th"), "chosen")
        every = scratch.keep(rows.groupBy("id", "th").agg(F.count("*").alias("copies")), "every")
        same = every["id"].eqNullSafe(chosen["id"]) & (every["th"] == chosen["th"])
        gone = scratch.keep(every.join(chosen, same, "left_anti").select(F.col("id").alias("__i"), F.col("th").alias("__t")), "gone")
        twice = scratch.keep(every.where("copies > 1").join(chosen, same, "left_semi").select(F.col("id").alias("__i"), F.col("th").alias("__t")), "twice")
        scratch.drop("sets", "answer", "chosen", "every")
    of = lambda table: (F.col(id_col).eqNullSafe(table["__i"])) & (F.xxhash64(text_col) == table["__t"])
    some = small(gone)
    left = documents.join(some, of(some), "left_anti")
    if twice.isEmpty():
        return left
    again = small(twice)
    columns = [F.col(x) for x in documents.columns]
    single = left.join(again, of(again), "left_semi").groupBy(F.col(id_col).alias("__i"), F.xxhash64(text_col).alias("__t")).agg(F.first(F.struct(*columns)).alias("__row"))
    return left.join(again, of(again), "left_anti").unionByName(single.select("__row.*"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT s.*, n FROM s JOIN n USING (doc_id)),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM k WHERE 100 * k >= 80 * (na + nb - k) UNION ALL SELECT b, a FROM k WHERE 100 * k >= 80 * (na + nb - k)),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS other FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id, w.doc_id <= coalesce(other, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
