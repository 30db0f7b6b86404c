"""Round trip through archives, byte ranges, and members that fail."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairn.llm import media


@given(st.binary(max_size=3000))
def test_image_round_trip(data):
    samples = media.payload(data)
    assert len(samples) % media.BLOCK == 0 and samples[: len(data)] == data and set(samples[len(data) :]) <= {255}
    assert media.decode_png(media.encode_png(samples)).tobytes() == samples


def test_broken_image_is_told():
    image = bytearray(media.encode_png(media.payload(b"x")))
    image[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(image))


TEXTS = ["", None, "a" * 576, "b" * 577, "é" * 5000, "same", "same", "long " * 100_000]


def stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 4 << 10)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS * 5)] + [(None, "no id", None, None), (3, "again", None, None)]
    folder = f"file://{tmp_path}/archives"
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, media string, member int")
    assert media.write_archives(frame, folder) == len(rows)
    return rows, folder


def test_round_trip(spark, tmp_path, monkeypatch):
    rows, folder = stored(spark, tmp_path, monkeypatch)
    got = sorted(media.described(media.read_archives(spark, folder, range_bytes=1500)).collect(), key=str)
    want = []
    for d, t, *_ in rows:
        data = (t or "").encode()
        p = data + b"\xff" * (-len(data) % 576) or b"\xff" * 576
        want.append((d, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    same = {(r.media_sha256, r.feature, r.media_bytes) for r in got if r.n_bytes == 4}
    assert len(same) == 1


def test_lost_attempts_and_broken_members(spark, tmp_path, monkeypatch):
    rows, folder = stored(spark, tmp_path, monkeypatch)
    root = Path(tmp_path / "archives")
    (root / "left-over.zip").write_bytes(b"an attempt that was lost")
    first = root / media.named_archives(folder).column("name")[0].as_py()
    data = bytearray(first.read_bytes())
    data[data.index(b"IDAT") + 6] ^= 255
    first.write_bytes(bytes(data))
    frame = media.read_archives(spark, folder).collect()
    assert len(frame) == len(rows)
    assert [r.error for r in frame if r.error] == ["checksum of the member differs"]
    before = media.read_archives(spark, folder).count()
    assert media.remove_orphans(folder) == 1 and not (root / "left-over.zip").exists()
    assert media.read_archives(spark, folder).count() == before


def test_ranges_cover_every_archive_once():
    names, sizes = [f"a{i}" for i in range(7)], [5, 1, 40, 0, 3, 100, 2]
    for n in (1, 7, 64, 1000):
        parts = media.planned(names, sizes, n)
        assert all(0 < sum(b - a for _, a, b in p) <= n for p in parts)
        for name, size in zip(names, sizes, strict=True):
            mine = sorted((a, b) for p in parts for k, a, b in p if k == name)
            assert [a for a, _ in mine] + [size] == [0, *(b for _, b in mine)] or not size and not mine


class Flaky:
    """A handle whose reads fail once."""

    def __init__(self, file):
        self.file, self.failed = file, False

    def read_at(self, n, at):
        if not self.failed:
            self.failed = True
            raise OSError("lost")
        return self.file.read_at(n, at)


def test_members_are_tried_again_with_a_fresh_handle(spark, tmp_path, monkeypatch):
    rows, folder = stored(spark, tmp_path, monkeypatch)
    reader = media.ArchiveReader(folder, 1 << 20)
    name = media.named_archives(folder).column("name")[0].as_py()
    with reader._handle(name) as file, media.zipfile.ZipFile(file) as directory:
        member = directory.infolist()[0]
        data, error = reader._member(Flaky(file), name, member)
    assert error is None and media.zlib.crc32(data) == member.CRC


def plain_png(image):
    """The samples of a greyscale PNG, read chunk by chunk by the letter of the format."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        chunks.append((image[at + 4 : at + 8], image[at + 8 : at + 8 + n], int.from_bytes(image[at + 8 + n : at + 12 + n], "big")))
        at += 12 + n
    assert [k for k, *_ in chunks] == [b"IHDR", b"IDAT", b"IEND"] and all(zlib.crc32(k + d) == c for k, d, c in chunks)
    head = chunks[0][1]
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    assert tuple(head[8:]) == (8, 0, 0, 0, 0)
    raw = zlib.decompress(chunks[1][1])
    assert len(raw) == height * (width + 1) and all(raw[y * (width + 1)] == 0 for y in range(height))
    return width, [raw[y * (width + 1) + 1 : (y + 1) * (width + 1)] for y in range(height)]


@pytest.mark.parametrize("text", [b"", b"a", b"ab" * 576, "é日".encode() * 700])
def test_image_and_feature_by_a_plain_reader(text):
    data = media.payload(text)
    width, lines = plain_png(media.encode_png(data))
    assert width == media.WIDTH and b"".join(lines) == data
    n = len(data)
    mean = sum(data) / n
    change = sum(abs(a - b) for line in lines for a, b in zip(line, line[1:], strict=False))
    steps = [sum(x >> 4 == k for x in data) * 255 // n for k in range(16)]
    variance = int(round(sum(x * x for x in data) * n - sum(data) ** 2)) * 1000 // (n * n)
    assert media.feature(media.decode_png(media.encode_png(data))) == f"{int(mean * 1000 + 1e-9)}:{variance}:{change * 1000 // n}:{bytes(steps).hex()}"


def test_stored_digests_are_those_of_the_image(spark, tmp_path, monkeypatch):
    rows, folder = stored(spark, tmp_path, monkeypatch)
    got = {r.doc_id: r for r in media.described(media.read_archives(spark, folder)).collect()}
    for d, t, *_ in rows:
        image = media.encode_png(media.payload((t or "").encode()))
        if d not in (3, None):
            assert (got[d].media_sha256, got[d].media_bytes) == (hashlib.sha256(image).hexdigest(), len(image))


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert media.write_archives(spark.createDataFrame([], "doc_id bigint, text string"), folder) == 0
    assert media.described(media.read_archives(spark, folder)).count() == 0


def test_feature_depends_on_samples_only():
    x = np.arange(576, dtype=np.uint8).reshape(-1, 24)
    assert media.feature(x) == media.feature(x.copy()) != media.feature(x[::-1] // 2)
