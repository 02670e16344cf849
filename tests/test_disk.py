"""What the flow leaves on the disks on its way."""

import os
import time

from pyspark.sql import functions as F

from pageloom.functions.order import numbered
from pageloom.operators import merge
from pageloom.plans.catalog import REPAIR, Flow
from pageloom.plans.ingest import ingest
from pageloom.sources import tables

DIR = "/root/testdata/sf0.001"


def shuffle_files(spark):
    return set(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))


def test_shuffles_of_a_written_table_go_with_its_query(spark):
    before, was = shuffle_files(spark), spark.conf.get(tables.CLEANUP, None)
    table = tables.written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while (left := {x for x in shuffle_files(spark) - before if x.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    assert not left and len(table.collect()) == 7 and spark.conf.get(tables.CLEANUP, None) == was


def test_merge_deals_the_texts_once(spark):
    plan = merge.merge_passes(Flow(spark, DIR).items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_numbers_go_on_from_batch_to_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if g == 3 else g, (i * 37) % 50) for g in range(6) for i in range(50)]
        got = numbered(spark.createDataFrame(rows, "g long, i int").repartition(3, "g"), "g", [F.desc("i")]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 300 and all(r.seq == 49 - r.i for r in got)


def test_parts_change_nothing_and_passing_tables_go(spark, monkeypatch):
    f, found, left = Flow(spark, DIR), [], []
    for most in (tables.PART_BYTES, 1):
        monkeypatch.setattr(tables, "PART_BYTES", most)
        there = set(os.listdir(tables.shared_dir(spark).removeprefix("file:")))
        done = ingest(f.items, f.infos, REPAIR, lines=f.lines, attempts=f.attempts)
        left.append(len(set(os.listdir(tables.shared_dir(spark).removeprefix("file:"))) - there))
        found.append({x: sorted(map(str, getattr(done, x).collect())) for x in ("blocks", "detections", "report", "warnings", "rejects")})
    # page statistics, pages to repair, blocks, rejects and warnings stay; merged items and paragraphs don't
    assert found[0] == found[1] and found[0]["blocks"] and left == [5, 5]
