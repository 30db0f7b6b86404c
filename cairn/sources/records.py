"""A data source of raw web records: partitions are runs of byte ranges of an archive that a manifest names.

The manifest is a Parquet table (``write_manifest_table``) that gives for each record: path, offset, length, and optionally
url, record_id, digest and sha256. The driver lists its files; tasks read its rows, choose them by pushed filters, read exactly their ranges,
from any store or over HTTP, parse each record (header lines, an empty line, HTTP headers, an empty line, the body) and
check that it is the record asked for. Ranges of one archive that overlap are an error of the manifest, found before it is written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import operator
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringStartsWith,
)

from cairn.sources.ranges import HttpFile
from cairn.storage import open_store, scratch

#: Bytes and records of one task.
TASK_BYTES, TASK_RECORDS = 32 << 20, 256
SCHEMA = "path string, offset bigint, length bigint, url string, record_id string, captured_at string, content_type string, html binary"


class RecordError(RuntimeError):
    """A record is not what the manifest says."""


def validate_specs(specs: list[dict]) -> list[dict]:
    """Specs with positive ranges that do not overlap within an archive."""
    ends: dict[str, int] = {}
    for s in sorted(specs, key=lambda s: (s["path"], s["offset"])):
        if s["offset"] < 0 or s["length"] <= 0:
            raise RecordError(f"bad range in {s['path']}: {s['offset']}+{s['length']}")
        if s["offset"] < ends.get(s["path"], 0):
            raise RecordError(f"ranges overlap in {s['path']} at {s['offset']}")
        ends[s["path"]] = s["offset"] + s["length"]
    return specs


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers (names in lower case) and body."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    http, _, body = rest.partition(b"\r\n\r\n")
    fields = lambda block: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:]) if k}
    record = fields(head)
    if "content-length" in record:
        body = body[: max(0, int(record["content-length"]) - len(http) - 4)]
    return record, fields(http), body


def packed(specs: list[dict], most_bytes: int = TASK_BYTES, most_records: int = TASK_RECORDS) -> list[list[dict]]:
    """Specs of one archive side by side, in tasks of a bounded number of records and bytes."""
    out: list[list[dict]] = []
    size = 0
    for s in sorted(specs, key=lambda s: (s["path"], s["offset"])):
        fits = out and out[-1][-1]["path"] == s["path"] and len(out[-1]) < most_records and size + s["length"] <= most_bytes
        if not fits:
            out.append([])
            size = 0
        out[-1].append(s)
        size += s["length"]
    return out


def payload_digest(http_body: bytes) -> str:
    """The digest that a record's header states for its payload."""
    return "sha1:" + base64.b32encode(hashlib.sha1(http_body).digest()).decode()


def checked(s: dict, data: bytes) -> tuple:
    """The row of one record, once it is the one that its spec asks for."""
    at = f"the record at {s['offset']} of {s['path']}"
    if len(data) != s["length"]:
        raise RecordError(f"{s['path']} has no {s['length']} bytes at {s['offset']}")
    if s.get("sha256") and hashlib.sha256(data).hexdigest() != s["sha256"]:
        raise RecordError(f"{at} has another hash")
    record, http, body = parse_record(data)
    url, record_id = record.get("warc-target-uri", ""), record.get("warc-record-id", "")
    if s.get("url") and url != s["url"]:
        raise RecordError(f"{at} is of {url}, not {s['url']}")
    if s.get("record_id") and record_id != s["record_id"]:
        raise RecordError(f"{at} is {record_id}, not {s['record_id']}")
    stated = record.get("warc-payload-digest")
    if (stated and stated != payload_digest(body)) or (s.get("digest") and s["digest"] != payload_digest(body)):
        raise RecordError(f"{at} has another payload digest")
    kind = http.get("content-type", "")
    if "html" not in kind.lower():
        raise RecordError(f"{url} is {kind or 'of no type'}, not html")
    return s["path"], s["offset"], s["length"], url, record_id, record.get("warc-date", ""), kind, body


# --- the manifest as a table -------------------------------------------------------------------------------------

MANIFEST = "path string, offset bigint, length bigint, url string, record_id string, digest string, sha256 string"
#: Columns of the records that the manifest has too; the first three are never null in it.
_SHARED = ("path", "offset", "length", "url", "record_id")
#: Bytes of a manifest's file that one task plans and reads the records of; rows of its groups are TASK_RECORDS.
PLANNED_BYTES = 16 << 10


def manifest_frame(spark: SparkSession, specs: list[dict] | DataFrame) -> DataFrame:
    """A manifest of MANIFEST's columns; those that are missing are null."""
    wanted = T.StructType.fromDDL(MANIFEST)
    if not isinstance(specs, DataFrame):
        return spark.createDataFrame([tuple(s.get(c) for c in wanted.names) for s in specs], wanted)
    return specs.select(*((F.col(f.name) if f.name in specs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields))


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """(path, offset, error) of ranges without a place or length and of those that overlap the one before."""
    before = F.lag(F.col("offset") + F.col("length")).over(Window.partitionBy("path").orderBy("offset", "length"))
    bad = F.coalesce((F.col("path") == "") | (F.col("offset") < 0) | (F.col("length") <= 0), F.lit(True))
    error = F.when(bad | F.col("path").isNull(), "bad range").when(F.col("offset") < before, "ranges overlap")
    return manifest.select("path", "offset", error.alias("error")).where("error is not null")


def write_manifest_table(specs: list[dict] | DataFrame, path: str, spark: SparkSession | None = None) -> str:
    """Writes a manifest as Parquet in order of path and offset, in row groups of TASK_RECORDS; errors come before it."""
    manifest = manifest_frame(spark or specs.sparkSession, specs)
    wrong = manifest_errors(manifest).limit(1).collect()
    if wrong:
        raise RecordError(f"{wrong[0].error} in {wrong[0].path} at {wrong[0].offset}")
    manifest.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").write.option("parquet.block.row.count.limit", str(TASK_RECORDS)).parquet(path)
    return path


class _Part(InputPartition):
    """The row groups of a manifest's file that begin between two of its bytes."""

    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


_COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _condition(f: Filter) -> pc.Expression | None:
    """A pushed filter as a condition on the manifest: true for every row that may fulfil it. None: not one of these."""
    if isinstance(f, Not) or len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in _SHARED:
        return None
    field = pc.field(f.attribute[0])
    if type(f) in _COMPARED:
        value = pa.scalar(f.value)
        at = {"==": field == value, ">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value}[_COMPARED[type(f)]]
    elif isinstance(f, In):
        at = field.isin(list(f.value))
    elif isinstance(f, StringStartsWith):
        at = pc.starts_with(field, f.value)
    else:
        return None
    return at | field.is_null()  # what the manifest leaves open is only known once the record is read


class RecordReader(DataSourceReader):
    """Plans by the sizes of the manifest's files alone; its rows are read by the tasks that read their records.

    Filters on path, offset, length, url and record_id choose manifest rows, by the statistics of row groups first, so
    what they leave out is never fetched. Spark applies them to the records as well.
    """

    def __init__(self, manifest: str, tries: int = 4, follow: int = 0):
        self.manifest, self.tries, self.follow = manifest, tries, follow
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _condition(f) is not None:
                self.kept.append(f)
            yield f

    def partitions(self) -> list[_Part]:
        store, path = open_store(self.manifest)
        files = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".parquet")]
        return [_Part(f.path, at, at + PLANNED_BYTES) for f in files for at in range(0, f.size, PLANNED_BYTES)] or [_Part("", 0, 0)]

    def _specs(self, part: _Part) -> list[dict]:
        """The manifest rows of a part that the filters leave."""
        store, _ = open_store(self.manifest)
        chosen = reduce(operator.and_, map(_condition, self.kept)) if self.kept else None
        whole = ds.ParquetFileFormat().make_fragment(part.file, store)
        mine = [g.id for g in whole.row_groups if part.first <= self._begin(whole, g.id) < part.last]
        if not mine:
            return []
        return whole.subset(row_group_ids=mine).to_table(filter=chosen).to_pylist()

    @staticmethod
    def _begin(fragment: ds.ParquetFileFragment, group: int) -> int:
        column = fragment.metadata.row_group(group).column(0)
        return column.dictionary_page_offset or column.data_page_offset

    def read(self, partition: _Part) -> Iterator[tuple]:
        """The records of each archive through one handle, each by its own range."""
        if not getattr(partition, "file", ""):
            return
        for specs in packed(self._specs(partition)):
            with self._opened(specs[0]["path"]) as file:
                for s in specs:
                    yield checked(s, file.read_at(s["length"], s["offset"]))

    def _opened(self, path: str):
        if path.startswith(("http://", "https://")):
            return HttpFile(path, tries=self.tries, follow=self.follow)
        store, at = open_store(path)
        return store.open_input_file(at)


class RecordSource(DataSource):
    """``spark.read.format("cairn_records").option("manifest", folder).load()``; options tries and follow are of HTTP."""

    @classmethod
    def name(cls) -> str:
        return "cairn_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["manifest"], int(self.options.get("tries", 4)), int(self.options.get("follow", 0)))


def read_records(spark: SparkSession, specs: list[dict] | DataFrame | str, **options: str | int) -> DataFrame:
    """The records of a manifest: a folder of ``write_manifest_table``, or rows that are written as one first."""
    manifest = specs if isinstance(specs, str) else write_manifest_table(specs, scratch(spark, "manifest"), spark)
    spark.dataSource.register(RecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # Spark keeps what a frame's last filters have left for scans of it without any: this one makes every scan push its own.
    return spark.read.format("cairn_records").options(manifest=manifest, **options).load().where("offset >= 0")
