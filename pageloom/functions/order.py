"""Numbers of rows in their group, without an exchange."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _numbers():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        last, n = object(), 0
        for column in batches:
            keys = column.to_pylist()
            begins = np.fromiter((a != b for a, b in zip(keys, [last, *keys], strict=False)), bool, len(keys))
            at = np.arange(len(keys))
            begin = np.maximum.accumulate(np.where(begins, at, -1))
            numbers = np.where(begin < 0, at + n, at - begin)
            if keys:
                last, n = keys[-1], int(numbers[-1]) + 1
            yield pa.array(numbers, pa.int32())

    # what it says of a row depends on those before it: no filter may go below it, no sort may go
    return F.arrow_udf(run, "int").asNondeterministic()


def numbered(rows: DataFrame, key: str, order: Sequence, name: str = "seq") -> DataFrame:
    """Rows with their number in the group of their key in this order, from 0. All rows of a group must lie in one partition, as a fold leaves them.

    After a Python function Spark doesn't know any more how rows lie, so a window would deal them, texts and all, once more.
    """
    return rows.sortWithinPartitions(key, *order).withColumn(name, _numbers()(F.col(key)))
