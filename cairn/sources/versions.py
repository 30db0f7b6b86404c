"""Tables by version, and batches of keyed objects: what readers see changes by one small object, in one step.

Renames are not atomic on object stores, and a table that is renamed away is missing for a moment on any store. Here
every write goes to a folder of its own; ``_current.json`` names the one that counts, and is swapped last: by an atomic
rename on file systems, by a single put on object stores. A write that fails, whose checks fail, or whose tasks are
killed leaves the pointer as it was, so nothing of it is visible. The version before stays for readers that have begun.

Metrics that checks need are observed in the pass that writes; no second scan counts rows.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cairn.storage import _path, open_store, remove

POINTER = "_current.json"
#: Schemes whose renames are atomic but do not replace; fixed values.
_RENAMED = ("hdfs", "viewfs", "webhdfs")


class CheckFailed(RuntimeError):
    """What was written does not pass its checks; it was not published."""


def swap_pointer(spark: SparkSession, folder: str, content: dict) -> None:
    """Makes ``content`` the pointer of ``folder``: readers see the one before or this one."""
    data = json.dumps(content, sort_keys=True).encode()
    store, root = open_store(folder)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(root, recursive=True)
        fresh = f"{root}/.{POINTER}.{uuid.uuid4().hex}"
        with open(fresh, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(fresh, f"{root}/{POINTER}")
    elif folder.split(":", 1)[0] in _RENAMED:
        jvm = spark._jvm
        fresh, target = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (f".{POINTER}.{uuid.uuid4().hex}", POINTER))
        out = _path(spark, folder)[1].create(fresh, True)
        out.write(bytearray(data))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, how)
    else:
        with store.open_output_stream(f"{root}/{POINTER}") as out:
            out.write(data)


def current(folder: str) -> dict | None:
    """The pointer of a folder; None before its first version."""
    store, root = open_store(folder)
    try:
        with store.open_input_stream(f"{root}/{POINTER}") as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return None


@dataclass
class Checks:
    """What is observed of the rows that are written, and what must hold of it.

    ``metrics``: name and aggregate; ``rules``: text of a rule and what holds of the metrics; a rule of ``warnings`` is
    told but does not stop the write. The number of rows is always there as ``rows``.
    """

    metrics: dict[str, Column] = field(default_factory=dict)
    rules: dict[str, Callable[[dict], bool]] = field(default_factory=dict)
    warnings: dict[str, Callable[[dict], bool]] = field(default_factory=dict)

    def observed(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation(f"checks-{uuid.uuid4().hex}")
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in self.metrics.items())), seen

    def verdict(self, found: dict) -> list[str]:
        """Texts of the warnings; raises where a rule does not hold."""
        broken = [text for text, holds in self.rules.items() if not holds(found)]
        if broken:
            raise CheckFailed(f"{'; '.join(broken)}: {found}")
        return [text for text, holds in self.warnings.items() if not holds(found)]


def write_version(df: DataFrame, folder: str, checks: Checks | None = None, keep: int = 2, partition_by: tuple[str, ...] = ()) -> dict:
    """Writes ``df`` as the next version of the table in ``folder``; returns its pointer, which holds what was observed.

    Rows are scanned once: the metrics of ``checks`` are gathered by the write itself, and the pointer is swapped only if
    their rules hold. Of older versions ``keep`` - 1 stay.
    """
    spark, checks = df.sparkSession, checks or Checks()
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    seen_rows, seen = checks.observed(df)
    try:
        seen_rows.write.parquet(f"{folder}/{name}", partitionBy=list(partition_by) or None)
        found = dict(seen.get)
        pointer = {"version": name, "metrics": {k: v if isinstance(v, (int, float, str, bool, type(None))) else str(v) for k, v in found.items()}, "warnings": checks.verdict(found)}
    except Exception:
        remove(spark, f"{folder}/{name}")
        raise
    swap_pointer(spark, folder, pointer)
    _forget(spark, folder, name, keep)
    return pointer


def _forget(spark: SparkSession, folder: str, newest: str, keep: int) -> None:
    """Removes versions older than the newest ``keep``; never one that is being written, which is newer."""
    at, store = _path(spark, folder)
    older = sorted(n for f in store.listStatus(at) if f.isDirectory() and (n := f.getPath().getName()).startswith("v-") and n <= newest)
    for name in older[: -max(1, keep)]:
        remove(spark, f"{folder}/{name}")


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a table; the frame stays with it when a later one is written."""
    pointer = current(folder)
    if pointer is None:
        raise FileNotFoundError(f"{folder} has no version")
    return spark.read.parquet(f"{folder}/{pointer['version']}")


# --- keyed objects -----------------------------------------------------------------------------------------------

#: What a key may be: letters, digits and ``._-=+@ `` besides, neither first a dot nor longer than a file's name may be.
KEY = r"[\w\-=+@ ][\w.\-=+@ ]{0,199}"


def checked_key(key: str | None) -> str:
    """The key, if it names an object in its folder and no other place."""
    if key is None or not re.fullmatch(KEY, key):
        raise ValueError(f"{key!r} is not a key of an object")
    return key


@dataclass
class _Wrote(WriterCommitMessage):
    objects: int
    bytes: int


class ObjectWriter(DataSourceArrowWriter):
    """Writes (key, body) rows as ``folder/<batch>/<key>.json``; the batch is visible once its pointer is swapped.

    Tasks write below the batch's own folder only. A task that is repeated writes the same keys again; one that dies
    leaves objects that no pointer names, and they go when the job is given up or the next batch is there.
    """

    def __init__(self, folder: str, batch: str):
        self.folder, self.batch = folder, checked_key(batch)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        store, root = open_store(f"{self.folder}/{self.batch}")
        objects = total = 0
        store.create_dir(root, recursive=True)
        for rows in iterator:
            for key, body in zip(rows.column("key").to_pylist(), rows.column("body").to_pylist(), strict=True):
                data = body.encode()
                write_object(store, root, checked_key(key), data)
                objects, total = objects + 1, total + len(data)
        return _Wrote(objects, total)

    def commit(self, messages: list[_Wrote | None]) -> None:
        """The pointer of the whole batch: numbers of its objects and bytes."""
        done = [m for m in messages if m is not None]
        summary = {"batch": self.batch, "objects": sum(m.objects for m in done), "bytes": sum(m.bytes for m in done)}
        store, root = open_store(self.folder)
        store.create_dir(root, recursive=True)
        write_object(store, root, "_summary", json.dumps(summary, sort_keys=True, indent=2).encode())

    def abort(self, messages: list[_Wrote | None]) -> None:
        store, root = open_store(f"{self.folder}/{self.batch}")
        store.delete_dir_contents(root, missing_dir_ok=True)
        store.delete_dir(root)


def write_object(store: fs.FileSystem, root: str, key: str, data: bytes) -> None:
    """An object that is there whole or not at all: by a rename where files are written in place, else by a single put."""
    at = f"{root}/{key}.json"
    if isinstance(store, (fs.LocalFileSystem, fs.HadoopFileSystem)):
        fresh = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as out:
            out.write(data)
        store.move(fresh, at)
    else:
        with store.open_output_stream(at) as out:
            out.write(data)


class ObjectSink(DataSource):
    """``df.write.format("cairn_objects").option("folder", f).option("batch", b).mode("append").save()``."""

    @classmethod
    def name(cls) -> str:
        return "cairn_objects"

    def schema(self) -> str:
        return "key string, body string"

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["folder"], self.options["batch"])


def object_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, body) of each row: all its columns as JSON with sorted names, nulls kept."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("body"))
