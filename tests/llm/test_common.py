"""Bounds of Arrow batches, and names that clash with nothing."""

import pytest

from cairn.llm import common

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize(
    "rows,size,after",
    [("10000", "67108864b", ("1000", str(16 << 20))), ("0", "100m", ("1000", str(16 << 20))), ("64", "2m", ("64", "2m")), ("1000", "1g", ("1000", str(16 << 20)))],
)
def test_bounds_are_only_lowered(spark, rows, size, after):
    before = spark.conf.get(ROWS), spark.conf.get(BYTES)
    try:
        spark.conf.set(ROWS, rows), spark.conf.set(BYTES, size)
        common.bounded(spark.range(1))
        assert (spark.conf.get(ROWS), spark.conf.get(BYTES)) == after
    finally:
        spark.conf.set(ROWS, before[0]), spark.conf.set(BYTES, before[1])


def test_fresh_names(spark):
    frame = spark.createDataFrame([(1, 2)], "__of int, KEY__ int")
    assert common.fresh(frame, "__of", "key", "key__", "key") == ["__of_", "key", "key___", "key_"]
