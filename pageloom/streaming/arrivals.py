"""The flow over documents as they arrive: each micro-batch of whole documents is ingested by itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.plans.ingest import Ingested, ingest
from pageloom.plans.options import IngestOptions
from pageloom.sources import tables
from pageloom.sources.readers import items_of, kids, kids_error, pages_of

ARRIVALS = "document_id bigint, page_info string, pass_1 string, pass_2 string"


def parse_arrivals(arrived: DataFrame) -> DataFrame:
    """document_id, pass_1 and pass_2 (parsed), pages, and error (null: none) of page information or parser JSON that can't be read."""
    passes = ("pass_1", "pass_2")
    wrong = [kids_error(F.col(x), kids(F.col(x)), F.lit(i + 1)).alias(f"wrong_{i + 1}") for i, x in enumerate(passes)]
    rows = arrived.select("document_id", F.col("page_info").alias("output"), *(kids(F.col(x)).alias(x) for x in passes), *wrong)
    rows = pages_of(rows, *passes, "wrong_1", "wrong_2")
    told = F.concat_ws("; ", "error", "wrong_1", "wrong_2")
    return rows.select("document_id", *passes, "pages", F.when(told != "", told).alias("error"))


def ingest_arrivals(arrived: DataFrame, options: IngestOptions = IngestOptions()) -> Ingested:  # noqa: B008
    """Rows of document_id, page-information text and the parser JSON of both passes to what ingest returns. The texts are parsed once; documents that can't be read are among the rejects."""
    parsed = tables.written(parse_arrivals(arrived))
    good = parsed.where("error is null")
    passes = F.explode(F.array(F.struct(F.lit(1).alias("pass"), F.col("pass_1").alias("kids")), F.struct(F.lit(2).alias("pass"), F.col("pass_2").alias("kids"))))
    items = items_of(good.select("document_id", passes.alias("p")).select("document_id", "p.pass", "p.kids"))
    done = ingest(items, good.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.*"), options)
    unread = parsed.where("error is not null").select("document_id", F.lit("read").alias("stage"), "error")
    return replace(done, rejects=unread.unionByName(done.rejects))


def stream_blocks(spark: SparkSession, source: str, target: str, checkpoint: str, *, options: IngestOptions = IngestOptions(), then: Callable[[Ingested, int], None] | None = None, **trigger) -> StreamingQuery:  # noqa: B008
    """Ingest files of JSON rows (ARRIVALS) in folder source as they come; the blocks of micro-batch n go to target/batch=n, written anew if n is repeated.

    Documents that can't be read, or that a step fails on, go to target-rejects/batch=n with stage and error; the others of the batch are ingested.
    Intermediate tables go at the end of their batch.
    """

    def one(arrived: DataFrame, n: int) -> None:
        with tables.scope():
            done = ingest_arrivals(arrived, options)
            done.rejects.write.mode("overwrite").parquet(f"{target}-rejects/batch={n}")
            done.blocks.write.mode("overwrite").parquet(f"{target}/batch={n}")
            if then is not None:
                then(done, n)

    rows = spark.readStream.schema(ARRIVALS).json(source)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(one).start()
