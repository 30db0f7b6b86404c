"""Session builder and table loading."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Settings that every session of this library expects; a cluster's own settings win where they are set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts go to Python workers: a batch is bounded by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "cairn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; keyword arguments (dots as ``__``) override them."""
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def bounded(rows: DataFrame) -> DataFrame:
    """``rows``, to be sent to Python in batches no larger than those of ``DEFAULTS``, also in sessions built elsewhere.

    A larger bound, such as Spark's ten thousand rows, is lowered and stays so, since Spark reads it when the plan runs.
    """
    conf = rows.sparkSession.conf
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", conf.get(name).lower()).groups()
        now = int(number) << 10 * " kmg".index(unit or " ")
        if now <= 0 or now > int(DEFAULTS[name]):
            conf.set(name, DEFAULTS[name])
    return rows


def finish(spark: SparkSession) -> None:
    """Ends a session and removes what it has stored in the shared folder."""
    from cairn.storage import clean

    clean(spark)
    spark.stop()


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, which may be on any store that Spark reads.

    ``spread``: for work that takes far longer than a shuffle of the rows. A small table may be a single row group,
    which one task would read; where a scan has fewer tasks than there are cores, its rows are dealt out. Large tables
    have more and are read as they lie.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if spread and rows.rdd.getNumPartitions() < cores else rows
