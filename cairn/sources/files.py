"""Sources: delimited text, JSON, Parquet unions, tables in memory, JDBC, binary objects, pinned snapshots."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.validation import nulls_as_empty
from cairn.storage import _path, open_store


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A delimited file whose columns are all strings; empty fields are empty strings, not null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return nulls_as_empty(spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"'))


def read_jsonl(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """JSON lines of a known schema; a line that breaks it fails the query with its file and number.

    Lines are counted from where a split of the file begins: from its first line in files that are read whole, else
    the message also names the byte. ``optional``: nothing at ``path`` is an empty table.
    """
    wanted = T.StructType.fromDDL(schema)
    if optional and not exists(spark, path):
        return spark.createDataFrame([], wanted)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n = None, 0
        for batch in batches:
            lines = []
            for at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                here, n = (here, n + 1) if at == here else (at, 1)
                lines.append(n)
            yield batch.append_column("line", pa.array(lines, pa.int64()))

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    rows = rows.mapInArrow(numbered, "file string, start bigint, value string, line bigint").where("trim(value) <> ''")
    with_error = T.StructType([*wanted.fields, T.StructField("_corrupt", T.StringType())])
    rows = rows.withColumn("x", F.from_json("value", with_error, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    place = F.concat(F.col("file"), F.when(F.col("start") > 0, F.concat(F.lit(" from byte "), F.col("start").cast("string"))).otherwise(""), F.lit(" line "), F.col("line").cast("string"))
    checked = F.when(F.col("x._corrupt").isNotNull(), F.raise_error(F.concat(place, F.lit(": not an object of the schema"))).cast(with_error)).otherwise(F.col("x"))
    return rows.select(checked.alias("x")).select(*(F.col("x")[f.name].alias(f.name) for f in wanted.fields))


def read_json_auto(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """JSON with an inferred schema: lines of objects, or (``multiline``) files that hold one object or array each."""
    return spark.read.json(path, multiLine=multiline)


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _path(spark, path)
    return bool(store.globStatus(at))


def from_arrow(spark: SparkSession, table: pa.Table, name: str | None = None) -> DataFrame:
    """A table in memory as a frame, and as a view of this session where ``name`` is given."""
    rows = spark.createDataFrame(table)
    if name:
        rows.createOrReplaceTempView(name)
    return rows


def create_table_as(spark: SparkSession, name: str, query: str) -> DataFrame:
    """The result of a query as a table of the catalog, replaced if it is there.

    It is written as a table of its own first, and takes the name once it is whole: a query that fails leaves the old
    table, and one may read the table that it replaces.
    """
    fresh = f"{name}_new_{uuid.uuid4().hex[:12]}"
    try:
        spark.sql(query).write.saveAsTable(fresh)
        spark.sql(f"drop table if exists {name}")
        spark.sql(f"alter table {fresh} rename to {name}")
    except Exception:
        spark.sql(f"drop table if exists {fresh}")
        raise
    return spark.table(name)


def read_jdbc_snapshot(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], order: list[str] | None = None, ranges: tuple[str, int, int, int] | None = None
) -> DataFrame:
    """A table or query over JDBC; ``ranges`` (column, lowest, highest, parts) reads it in parallel, ``order`` sorts it."""
    if ranges:
        column, low, high, parts = ranges
        rows = spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
    else:
        rows = spark.read.jdbc(url, table, properties=properties)
    return rows.orderBy(*order) if order else rows


def read_json_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with what could not be parsed in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def read_parquet_union(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of one table, united by column name; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(p) for p in paths))


def read_objects(spark: SparkSession, path: str, pattern: str = ".*", key: str = r"([^/]+)$") -> DataFrame:
    """Objects below ``path`` whose path matches: object_key, content, length, sha256; listed by Spark."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(pattern))
    return rows.select(F.regexp_extract("path", key, 1).alias("object_key"), "content", "length", F.sha2("content", 256).alias("sha256"))


def attach_objects(manifest: DataFrame, objects: DataFrame, key: str = "object_key") -> DataFrame:
    """Manifest rows with their object; rows without one stay, ``file_exists`` false."""
    return manifest.join(objects, key, "left").withColumn("file_exists", F.col("length").isNotNull())


class SnapshotError(RuntimeError):
    """A file is not the one that was pinned."""


def _sha256(files: DataFrame) -> str:
    """SHA-256 of a single file that a task streams from its store, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as file:
                    while piece := file.read(1 << 20):
                        digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["sha256"])

    return files.mapInArrow(run, "sha256 string").first().sha256


def verify_snapshot(spark: SparkSession, path: str, contract: dict, id_column: str | None = None, ids: DataFrame | None = None) -> dict:
    """Size, hash and number of records of a pinned file, on any store, against its contract; what was found.

    Records are the rows of a Parquet file or the lines of any other. ``contract`` may hold bytes, sha256, rows or lines, and
    distinct_ids. ``ids`` (one column) are the record ids that a Parquet file must hold, each once: both sides are compared as
    frames, and what lacks, is too much or repeated is counted as missing_ids, unknown_ids and repeated_ids, which must be 0.
    """
    at, store = _path(spark, path)
    if not store.exists(at):
        raise SnapshotError(f"{path}: there is no such file")
    found: dict = {"bytes": store.getFileStatus(at).getLen(), "sha256": _sha256(spark.createDataFrame([(path,)], "path string"))}
    wanted = dict(contract)
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
        found["rows"] = rows.count()
        if id_column:
            held = rows.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("n"))
            found |= held.agg(F.count("*").alias("distinct_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids")).first().asDict()
            if ids is not None:
                pinned = ids.select(F.col(ids.columns[0]).cast(held.schema["id"].dataType).alias("id")).distinct()
                found["missing_ids"], found["unknown_ids"] = pinned.join(held, "id", "left_anti").count(), held.join(pinned, "id", "left_anti").count()
                wanted |= {"missing_ids": 0, "unknown_ids": 0, "repeated_ids": 0}
    else:
        found["lines"] = spark.read.text(path).count()
    wrong = [f"{k}: expected {wanted[k]}, found {found[k]}" for k in found if k in wanted and wanted[k] != found[k]]
    if wrong:
        raise SnapshotError(f"{path}: " + "; ".join(wrong))
    return found


def load_contract(path: str) -> dict:
    return json.loads(Path(path).read_text())
