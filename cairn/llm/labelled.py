"""Labelled rows: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.storage import store

#: UTF-8 bytes of text that a sample holds of each class, at most.
SAMPLE_BYTES = 32 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that are never learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def usable(labels: DataFrame, label: str, classes: list[int]) -> DataFrame:
    """(doc_id, label) outside the held-out fifth, a row a doc_id. Labels that are null or of no class given do not count, and a
    doc_id with labels of more than one class is left out."""
    told = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(*classes))
    told = told.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    return told.where("label = other").select("doc_id", "label")


def sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], max_bytes: int = SAMPLE_BYTES
) -> tuple[list[bytes], np.ndarray, dict[int, int]]:
    """Texts and labels of at most ``per_class`` rows and ``max_bytes`` of each class, and how many rows each class has.

    The rows are those of the smallest hashes of doc_id outside the held-out fifth, so the sample depends neither on
    how the tables are stored nor on retries; rows are taken in that order as long as they fit into ``max_bytes``, and
    one that alone does not fit is passed over. Of several texts of one doc_id the smallest stands; a doc_id with
    labels of more than one class is left out, as are labels that are null or of no class given.
    """
    told = usable(labels, label, list(per_class))
    counts = {r.label: r.n for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value, most in per_class.items():
        part = told.where(F.col("label") == value).orderBy(_place(), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = [(r.doc_id, r.label) for r in chosen.collect()]  # sum(per_class.values()) rows at most
    if not rows:
        return [], np.zeros(0, int), counts
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame(rows, "doc_id bigint, label int"))  # as many rows, 12 bytes each
    found = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = store(found, "labelled")
    sizes = found.df.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    left, fits = dict.fromkeys(per_class, max_bytes), []
    for r in sizes.orderBy(_place(), "doc_id").collect():
        if r.n <= left[r.label]:
            left[r.label] -= r.n
            fits.append((r.doc_id,))
    within = F.broadcast(spark.createDataFrame(fits, "doc_id bigint"))
    table = found.df.join(within, "doc_id", "left_semi").toArrow()
    found.remove()
    texts = [x or b"" for x in table.column("text").cast("binary").to_pylist()]
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    return [texts[i] for i in order], table.column("label").to_numpy()[order].astype(int), counts


def _place() -> Column:
    return F.xxhash64("doc_id", F.lit(11))
