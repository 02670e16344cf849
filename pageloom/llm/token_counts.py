"""Token counts: additive totals by source, language and tokenizer version, kept by deltas.

A change is a signed row: an insert adds a document and its tokens, a delete
takes both away, a revised count adds the difference. A batch of changes is
summed by key (partial sums first, so a hot source costs a row per task) and
written under its batch id; a batch that was committed is never counted again,
and one that broke off is overwritten by its next commit. Totals are the last
snapshot plus the batches that it doesn't hold. Deltas are kept until the
snapshot after the one that holds them is valid, so a reader of the snapshot
before loses nothing; then they and older snapshots go. Ids of batches stay in
tables, and a commit looks up its own id there.

Defined results: null keys are keys. A key whose documents come to none has no
row in the totals. An empty batch commits as an empty batch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.store import Scratch

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, d_docs bigint, d_tokens bigint"


def summed(changes: DataFrame, *more: str) -> DataFrame:
    """Changes summed by key (and by the columns named)."""
    return changes.groupBy(*more, *KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))


class Rollup:
    """A folder of committed batches and snapshots, in a store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._at(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(folder)) if self.fs.exists(self._at(f"{folder}/{x.getPath().getName()}/_SUCCESS")))

    def batches(self) -> list[str]:
        """Ids of the committed batches that are still kept as deltas."""
        return self._names("deltas")

    def _names_snapshots(self) -> list[str]:
        return [x for x in self._names("snapshots") if x.isdigit()]

    def committed(self, batch: str) -> bool:
        return self.fs.exists(self._at(f"deltas/{batch}/_SUCCESS")) or self._held_in(self._last(), batch)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sum and write the changes; False, and nothing done, if this batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        summed(changes).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")  # _SUCCESS comes last
        return True

    def _last(self) -> str | None:
        """The last whole snapshot."""
        return next((n for n in reversed(self._names_snapshots()) if self.fs.exists(self._at(f"snapshots/{n}-batches/_SUCCESS"))), None)

    def _ids(self, snapshot: str) -> DataFrame:
        """Ids of all batches in the snapshot."""
        return self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{snapshot}-batches")

    def _held_in(self, snapshot: str | None, batch: str) -> bool:
        return snapshot is not None and not self._ids(snapshot).where(F.col("batch") == batch).isEmpty()

    def _new(self, last: str | None) -> list[str]:
        """Kept deltas that the snapshot doesn't hold: those of at most two snapshots' time are looked up."""
        kept = self.batches()
        if last is None or not kept:
            return kept
        held = {r.batch for r in self._ids(last).where(F.col("batch").isin(kept)).collect()}
        return [x for x in kept if x not in held]

    def _sums(self, last: str | None, new: list[str]) -> DataFrame:
        paths = [f"{self.path}/deltas/{x}" for x in new] + ([f"{self.path}/snapshots/{last}"] if last else [])
        return summed(self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA))

    def totals(self) -> DataFrame:
        last = self._last()
        return self._sums(last, self._new(last)).where("d_docs <> 0").select(*KEYS, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Write a snapshot of all committed batches; its list of batches comes last and makes it valid. Then prune."""
        last = self._last()
        new = self._new(last)
        older = [x for x in self.batches() if x not in new]
        name = f"{int(last or 0) + 1:09d}"
        self._sums(last, new).write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}")
        ids = self.spark.createDataFrame([(x,) for x in new], "batch string")
        (self._ids(last).unionByName(ids) if last else ids).write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}-batches")
        for x in older:  # held by the snapshot before too
            self.fs.delete(self._at(f"deltas/{x}"), True)
        for n in self._names_snapshots():
            if last and int(n) < int(last):
                self.fs.delete(self._at(f"snapshots/{n}-batches"), True)
                self.fs.delete(self._at(f"snapshots/{n}"), True)


def word_count(text: F.Column) -> F.Column:
    """Runs of bytes that aren't ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def corpus_changes(documents: DataFrame) -> DataFrame:
    """The feed of a first load: estimates for all documents, then exact word counts, then deletes of what has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("source", "lang", word_count(F.col("text")).alias("words"), F.ceil(F.length(text) / 4).cast("long").alias("quarter"), (F.length(text) - F.length(F.translate(text, " ", "")) + 1).cast("long").alias("rough"))
    change = lambda batch, version, docs, tokens: F.struct(F.lit(batch).alias("batch"), F.lit(version).alias("tokenizer_version"), F.lit(docs).cast("long").alias("d_docs"), tokens.alias("d_tokens"))
    gone = F.col("words") == 0
    feed = F.array(
        change("1-load", "chars4-1", 1, F.col("quarter")),
        change("1-load", "words-1", 1, F.col("rough")),
        change("2-recount", "words-1", 0, F.col("words") - F.col("rough")),
        F.when(gone, change("3-delete", "chars4-1", -1, -F.col("quarter"))),
        F.when(gone, change("3-delete", "words-1", -1, -F.col("words"))),
    )
    return rows.select("source", "lang", F.explode(F.filter(feed, lambda x: x.isNotNull())).alias("c")).select("c.batch", "source", "lang", "c.tokenizer_version", "c.d_docs", "c.d_tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    changes = scratch.hold(summed(corpus_changes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "batch"), "changes")
    rollup = Rollup(spark, f"{scratch.root}/rollup")
    for batch in ("1-load", "2-recount", "2-recount", "3-delete", "1-load"):  # what is sent again isn't counted again
        rollup.commit(batch, changes.where(F.col("batch") == batch))
    return rollup.totals()


SQL = r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM documents)
SELECT source, lang, v AS tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM (SELECT source, lang, 'chars4-1' AS v, (length(t) + 3) // 4 AS n FROM d WHERE w > 0 UNION ALL SELECT source, lang, 'words-1', w FROM d WHERE w > 0)
GROUP BY source, lang, v
"""
