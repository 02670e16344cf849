"""The corpus pipeline: each stage takes what the one before it kept.

Every stage but the last returns the columns of documents. Texts without a
recognised language go; repeated runs of lines are cut out, and a document
goes if nothing of it is left, as of every later copy of two lines or more; of
each group of near-duplicates the document with the least id stays; documents
that hold a benchmark passage go; what remains is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import bpe, langid, line_dedup, near_dedup
from pageloom.llm.decontaminate import decontaminate
from pageloom.llm.store import Scratch

#: SQL can't express the language models, nor the chunks of lines.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """The rows beside id and text as one column, so that no column of theirs meets one that an operator makes."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("__doc"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(_packed(docs), model, keep=("__doc",)).where("not rejected").select("__doc.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [x for x in docs.columns if x not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *rest).alias("__doc"))
    cut = line_dedup.dedup_lines(packed, whole_runs=True).where("n_lines = 0 or n_removed < n_lines")
    own = {x: F.col("__doc")[x] for x in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(own["n_chars"])
    return cut.select(*(own[x].alias(x) for x in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("__doc",))
    return found.where("n_hit = 0").select("__doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
