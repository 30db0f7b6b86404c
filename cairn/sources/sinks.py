"""Sinks: atomic Parquet, delimited text with nested columns as JSON, JSON lines, keyed objects, manifests."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.sources.versions import KEY, ObjectSink, checked_key, object_rows, write_object
from cairn.storage import _path, open_store, remove


def replace_atomic(spark: SparkSession, made: dict[str, str]) -> None:
    """Renames written tables (new path: target) into place, each in one step; if one cannot be, all go back."""
    done: list[tuple[str, str | None]] = []
    try:
        for fresh, target in made.items():
            at, store = _path(spark, target)
            old = f"{target}.old-{uuid.uuid4().hex}" if store.exists(at) else None
            if old:
                store.rename(at, _path(spark, old)[0])
            done.append((target, old))
            store.mkdirs(at.getParent())
            if not store.rename(_path(spark, fresh)[0], at):
                raise OSError(f"{target} could not be replaced")
    except Exception:
        for target, old in reversed(done):
            remove(spark, target)
            if old:
                _path(spark, target)[1].rename(_path(spark, old)[0], _path(spark, target)[0])
        raise
    for _, old in done:
        if old:
            remove(spark, old)


def _write_atomic(df: DataFrame, targets: dict[str, str], **options: str) -> None:
    """Writes every format beside its target before any target is touched, so a failure leaves all as they were."""
    spark = df.sparkSession
    made = {f"{path}.new-{uuid.uuid4().hex}": (path, kind) for path, kind in targets.items()}
    try:
        for fresh, (_, kind) in made.items():
            df.write.options(**options).format(kind).save(fresh)
        replace_atomic(spark, {fresh: path for fresh, (path, _) in made.items()})
    finally:
        for fresh in made:
            remove(spark, fresh)


def write_parquet_atomic(df: DataFrame, path: str) -> None:
    """Writes beside the target and renames; a failure leaves the old table.

    Between the two renames there is none for a moment: where readers must always find one, use ``versions``.
    """
    _write_atomic(df, {path: "parquet"})


def write_jsonl_atomic(df: DataFrame, path: str) -> None:
    """JSON lines with null fields kept, replaced as ``write_parquet_atomic`` does."""
    _write_atomic(df, {path: "json"}, ignoreNullFields="false")


def write_ordered(df: DataFrame, path: str, *order: str | Column) -> None:
    """Parquet whose files follow each other in ``order``: ranges of it are dealt to tasks, which sort their own."""
    write_parquet_atomic(df.repartitionByRange(*order).sortWithinPartitions(*order), path)


def _nested(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]


def sorted_keys(value: Column, kind: T.DataType) -> Column:
    """A nested value with the fields of its structs and the keys of its maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(sorted_keys(value[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), sorted_keys(e["value"], kind.valueType).alias("value"))
        return F.map_from_entries(F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), entry))
    return value


def flat(df: DataFrame, as_json: bool = True) -> DataFrame:
    """Nested columns as JSON text with sorted keys, nulls kept, or left out."""
    if not as_json:
        return df.drop(*_nested(df))
    return df.withColumns({c: F.to_json(sorted_keys(F.col(c), df.schema[c].dataType), {"ignoreNullFields": "false"}) for c in _nested(df)})


def write_csv(df: DataFrame, path: str, as_json: bool = True) -> None:
    """Delimited text with a header, nested columns as ``flat`` gives them, replaced as ``write_parquet_atomic`` does."""
    _write_atomic(flat(df, as_json), {path: "csv"}, header="true", escape='"')


def write_dual(df: DataFrame, path: str) -> None:
    """The table as Parquet and as JSON lines: both are written before either takes the place of what was there."""
    _write_atomic(df, {f"{path}/parquet": "parquet", f"{path}/jsonl": "json"}, ignoreNullFields="false")


def publish_objects(df: DataFrame, folder: str, key: str) -> DataFrame:
    """One JSON object a row at ``folder/<key>.json``, written by the executors; returns (key, bytes).

    A key that is no plain name is refused. Objects are seen as they are written; ``publish_batch`` shows them at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            keys, sizes = batch.column(0).to_pylist(), []
            for name, body in zip(keys, batch.column(1).to_pylist(), strict=True):
                write_object(store, root, checked_key(name), body.encode())
                sizes.append(len(body.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], ["key", "bytes"])

    return object_rows(df, key).mapInArrow(run, "key string, bytes bigint")


def publish_batch(df: DataFrame, folder: str, key: str, batch: str) -> dict:
    """Objects of one batch below ``folder/<batch>/``, a summary, and the batches before it removed.

    Spark's commit protocol writes them: tasks tell what they wrote, and only when all have ended well is the summary
    ``_summary.json`` put in place, which names the batch that readers should use. If the job fails, its batch is removed and
    the summary is that of before. Only then do other batches go, each as a whole prefix, so readers never meet a
    mixture. Keys are unique and plain names: repeated ones are an error, found before anything is written.
    """
    spark = df.sparkSession
    checked_key(batch)
    keys = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    for odd in keys.where((F.col("n") > 1) | ~F.coalesce(F.col("key").rlike(f"^(?U:{KEY})\\z"), F.lit(False))).limit(1).collect():
        checked_key(odd.key)
        raise ValueError(f"the key {odd.key!r} is there {odd.n} times")
    summary_at = f"{folder}/_summary.json"
    store, root = open_store(folder)
    if store.get_file_info(f"{root}/{batch}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} has a batch {batch}")
    spark.dataSource.register(ObjectSink)
    try:
        object_rows(df, key).write.format("cairn_objects").options(folder=folder, batch=batch).mode("append").save()
    except Exception:
        remove(spark, f"{folder}/{batch}")  # what tasks wrote that ended after the job was given up
        raise
    store, root = open_store(summary_at)
    with store.open_input_stream(root) as file:
        summary = json.loads(file.read())
    at, store = _path(spark, folder)
    for found in store.listStatus(at):
        if found.isDirectory() and found.getPath().getName() != batch:
            store.delete(found.getPath(), True)
    return summary


def write_manifest(spark, path: str, content: dict) -> None:
    """Run facts as JSON with sorted keys, on any store that Spark writes."""
    at, store = _path(spark, path)
    out = store.create(at, True)
    out.write(bytearray(json.dumps(content, sort_keys=True, indent=2).encode()))
    out.close()


def write_jdbc_snapshot(df: DataFrame, url: str, name: str, properties: dict[str, str]) -> None:
    """Replaces the rows of a table over JDBC in one transaction; its definition stays.

    Tasks fill a table of their own beside it; its rows then take the place of the old ones in a single transaction of
    the database, so readers see the old snapshot or the new one, and a failure leaves the old.
    """
    if not re.fullmatch(r"\w+(\.\w+)?", name):
        raise ValueError(f"{name} is not a plain table name")
    jvm, staging = df.sparkSession._jvm, f"{name}_new_{uuid.uuid4().hex[:12]}"
    df.write.jdbc(url, staging, mode="overwrite", properties=properties)
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        columns = ", ".join(f'"{c}"' for c in df.columns)
        try:
            statement.executeUpdate(f"delete from {name}")
            statement.executeUpdate(f"insert into {name} ({columns}) select {columns} from {staging}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            statement.executeUpdate(f"drop table {staging}")
            connection.commit()
    finally:
        connection.close()
