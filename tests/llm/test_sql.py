"""op2 against its SQL on families of near copies."""

import duckdb

from pageloom.llm import near_dedup
from tests.llm.test_near_dedup import families


def test_near_dedup_sql(spark):
    frame = spark.createDataFrame(families(8), "doc_id bigint, text string")
    documents = frame.toPandas()
    want = duckdb.sql(near_dedup.SQL).fetchall()
    assert sorted(map(tuple, near_dedup.near_dedup(frame).collect())) == sorted(want) and len(documents) == len(want)
