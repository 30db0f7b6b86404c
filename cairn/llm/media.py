"""Media columns: payloads stored as images in archives, and read back by a data source of its own.

A payload is stored as a greyscale PNG of 8-bit samples, WIDTH a line, without loss. Writers put the images of a task
into archives (ZIP, members stored as they are) in the shared folder, through temporary names. The folder's manifest is
a Parquet table that the same job writes: Spark commits only the rows of tasks that ended well, so attempts that were
lost or repeated name no archive, and ``remove_orphans`` deletes what they left.

The data source plans partitions from the manifest alone: byte ranges of archives, as many of them as make about
RANGE_BYTES, so neither the archives' number nor their sizes decide how many tasks there are. A task reads an
archive's directory, takes the members whose header begins in its range, and streams payload batches through Arrow. A
member is fetched by its offset, on its own, through the range's handle: a failed read or checksum is tried again with
a fresh one, and what stays broken becomes a row with an error instead of failing the other members. Archives are
bounded (ARCHIVE_BYTES and one member), and so are the directories that a task reads. Paths are opened through
``storage.open_store``, so the folder may be on any store that pyarrow knows.

Defined cases: a null text is an empty one; the payload of an empty text is one block of fill bytes; rows stay as
they are, repeated or null ids too; other columns are ignored; an empty table writes no archive and reads no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.llm.common import bounded, slices, utf8
from cairn.session import table
from cairn.storage import open_store, scratch

#: A payload is a positive multiple of BLOCK bytes, filled up with FILL; an image has WIDTH samples a line.
BLOCK, FILL, WIDTH = 576, 255, 24
#: Bytes of an archive, of a partition's ranges, and of a batch of payloads.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 16 << 20, 4 << 20
TRIES = 3
MANIFEST = "manifest.parquet"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """The text, filled up to a positive multiple of BLOCK."""
    blocks = max(1, -(-len(text) // BLOCK))
    return text + bytes([FILL]) * (blocks * BLOCK - len(text))


# --- the image format --------------------------------------------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """A greyscale image of 8-bit samples, lines unfiltered."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(lines), width + 1), np.uint8)
    raw[:, 1:] = lines
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """The samples, line by line; raises ValueError where the image is not one that ``encode_png`` makes."""
    if image[:8] != _SIGNATURE:
        raise ValueError("no image signature")
    at, data, size = 8, [], None
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != image[at + 8 + n : at + 12 + n]:
            raise ValueError("checksum of a chunk differs")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit greyscale")
            size = height, width
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[0], size[1] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered lines")
    return raw[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, variance and change along the lines in thousandths, and a histogram of sixteen steps in hexadecimal."""
    x = samples.astype(np.int64)
    n, total, squares = x.size, int(x.sum()), int((x * x).sum())
    change = int(np.abs(np.diff(x, axis=1)).sum())
    steps = np.bincount(samples.ravel() >> 4, minlength=16) * 255 // n
    return f"{total * 1000 // n}:{(squares * n - total * total) * 1000 // (n * n)}:{change * 1000 // n}:{bytes(steps.astype(np.uint8)).hex()}"


# --- archives ----------------------------------------------------------------------------------------------------


class _Archives:
    """Writes members into archives of bounded size; names them only once they are whole."""

    def __init__(self, folder: str):
        self.store, self.root = open_store(folder)
        self.done: list[tuple[str, int, int]] = []
        self.n, self.buffer, self.zip = 0, None, None

    def add(self, name: str, data: bytes) -> None:
        if self.zip is None:
            self.buffer = io.BytesIO()
            self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        self.zip.writestr(zipfile.ZipInfo(name), data)
        self.n += 1
        if self.buffer.tell() >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.zip is None:
            return
        self.zip.close()
        name = f"{uuid.uuid4().hex}.zip"
        data = self.buffer.getbuffer()
        with self.store.open_output_stream(f"{self.root}/.{name}") as out:
            out.write(data)
        self.store.move(f"{self.root}/.{name}", f"{self.root}/{name}")
        self.done.append((name, len(data), self.n))
        self.n, self.buffer, self.zip = 0, None, None


def write_archives(docs: DataFrame, folder: str) -> int:
    """Stores each row's payload as a member ``row number/doc_id/text bytes.png``; returns how many were stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, row = _Archives(folder), 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part), strict=True):
                    archives.add(f"{row}/{'' if doc_id is None else doc_id}/{len(text)}.png", encode_png(payload(text)))
                    row += 1
        archives.close()
        names, sizes, members = zip(*archives.done, strict=True) if archives.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.int64())], ["name", "bytes", "members"])

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    rows = bounded(docs.select("doc_id", "text")).mapInArrow(run, "name string, bytes bigint, members bigint")
    rows.write.parquet(f"{folder}/{MANIFEST}")
    return docs.sparkSession.read.parquet(f"{folder}/{MANIFEST}").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


def named_archives(folder: str) -> pa.Table:
    """The manifest: name and bytes of each archive, by name."""
    store, root = open_store(folder)
    return ds.dataset(f"{root}/{MANIFEST}", filesystem=store, format="parquet").to_table(columns=["name", "bytes"]).sort_by("name")


def remove_orphans(folder: str) -> int:
    """Deletes archives that the manifest does not name, once no writer is at work; returns how many there were."""
    store, root = open_store(folder)
    known = set(named_archives(folder).column("name").to_pylist())
    found = [f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(".zip") and f.base_name not in known]
    for f in found:
        store.delete_file(f.path)
    return len(found)


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def planned(names: list[str], sizes: list[int], range_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Byte ranges (name, start, end) of archives: large archives are cut, small ones share a partition."""
    out: list[list[tuple[str, int, int]]] = []
    left = 0
    for name, size in zip(names, sizes, strict=True):
        at = 0
        while at < size:
            if left <= 0:
                out.append([])
                left = range_bytes
            end = min(size, at + left)
            out[-1].append((name, at, end))
            left -= end - at
            at = end
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[_Ranges]:
        known = named_archives(self.folder)
        return [_Ranges(r) for r in planned(known.column("name").to_pylist(), known.column("bytes").to_pylist(), self.range_bytes)]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "ranges", None):
            return
        rows, size = [], 0
        for name, start, end in partition.ranges:
            with self._handle(name) as file:
                with zipfile.ZipFile(file) as directory:
                    members = [m for m in directory.infolist() if start <= m.header_offset < end]
                for m in members:
                    data, error = self._member(file, name, m)
                    rows.append((m.filename, name, m.header_offset, data, error))
                    size += len(data or b"")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _handle(self, name: str) -> pa.NativeFile:
        store, root = open_store(self.folder)
        return store.open_input_file(f"{root}/{name}")

    def _member(self, file: pa.NativeFile, name: str, m: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """One member by its offset: through the open handle, and if that fails through fresh ones."""
        error = None
        for attempt in range(TRIES):
            try:
                if not attempt:
                    return self._fetched(file, m), None
                with self._handle(name) as fresh:
                    return self._fetched(fresh, m), None
            except (OSError, ValueError, struct.error) as e:
                error = str(e)[:200]
        return None, error

    @staticmethod
    def _fetched(file: pa.NativeFile, m: zipfile.ZipInfo) -> bytes:
        head = file.read_at(30, m.header_offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member at this offset")
        skip = sum(struct.unpack("<HH", head[26:30]))
        data = file.read_at(m.compress_size, m.header_offset + 30 + skip)
        if len(data) != m.compress_size or zlib.crc32(data) != m.CRC:
            raise ValueError("checksum of the member differs")
        return data

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        member, archive, offset, data, error = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(member), pa.array(archive), pa.array(offset, pa.int64()), pa.array(data, pa.binary()), pa.array(error, pa.string())], ["member", "archive", "offset", "media", "error"])


class ArchiveSource(DataSource):
    """``spark.read.format("cairn_archive").load(folder)``: member, archive, offset, media, error."""

    @classmethod
    def name(cls) -> str:
        return "cairn_archive"

    def schema(self) -> str:
        return "member string, archive string, offset bigint, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("cairn_archive").option("range_bytes", str(range_bytes)).load(folder)


def described(media: DataFrame) -> DataFrame:
    """Digests and features of each stored payload; a member that could not be read is an error of the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for member, image, error in zip(part.column("member").to_pylist(), part.column("media").to_pylist(), part.column("error").to_pylist(), strict=True):
                    if error is not None:
                        raise OSError(f"{member}: {error}")
                    samples = decode_png(image)
                    data = samples.tobytes()
                    _, doc_id, rest = member.split("/")
                    rows.append((int(doc_id) if doc_id else None, int(rest[:-4]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
                yield pa.RecordBatch.from_pylist([dict(zip(_DESCRIBED.names, r, strict=True)) for r in rows], schema=_DESCRIBED)

    return bounded(media.select("member", "media", "error")).mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "documents", spread=True), folder)
    return described(read_archives(spark, folder))


QUERIES = {"op8_media_columns": op8_media_columns}
ORACLES: dict[str, str] = {}
