"""Raster photos: decoding, measures and hashes beside plain versions, and odd files."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from cairn.functions import media as M
from cairn.functions import raster as R
from cairn.operators import packets as P
from cairn.plans import photos
from cairn.session import table

PNG = b"\x89PNG\r\n\x1a\n"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, depth, colour, lines, extra=b""):
    """A PNG of filtered lines, each a filter number and bytes."""
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(b"".join(bytes([f]) + line for f, line in lines))) + chunk(b"IEND", b"")


def filtered(rows, step):
    """The rows by each filter in turn, as the format defines them."""
    out, above = [], bytes(len(rows[0]))
    for y, row in enumerate(rows):
        kind, line = y % 5, bytearray()
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out.append((kind, bytes(line)))
        above = row
    return out


@pytest.mark.parametrize("colour,samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_of_every_filter(colour, samples):
    rng = np.random.default_rng(colour)
    pixels = rng.integers(0, 256, (11, 7, samples), np.uint8)
    got, mode, kind = R.decoded(png(7, 11, 8, colour, filtered([r.tobytes() for r in pixels], samples)))
    want = pixels[:, :, :3] if samples > 2 else np.repeat(pixels[:, :, :1], 3, axis=2)
    assert np.array_equal(got, want) and kind == "PNG" and mode == {1: "L", 3: "RGB", 2: "LA", 4: "RGBA"}[samples]


def test_png_of_other_depths_and_palettes():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 9, 8, 7])
    got, mode, _ = R.decoded(png(4, 1, 2, 3, [(0, bytes([0b00011011]))], chunk(b"PLTE", palette)))
    assert got.tolist() == [[[0, 0, 0], [255, 0, 0], [0, 255, 0], [9, 8, 7]]] and mode == "P"
    assert R.decoded(png(3, 1, 1, 0, [(0, bytes([0b10100000]))]))[0][0, :, 0].tolist() == [255, 0, 255]
    assert R.decoded(png(2, 1, 16, 0, [(0, bytes([1, 200, 254, 3]))]))[0][0, :, 0].tolist() == [1, 254]


def test_pnm_and_turned_photos():
    got, mode, kind = R.decoded(b"P6 # by hand\n2 1\n255\n" + bytes(range(6)))
    assert got.tolist() == [[[0, 1, 2], [3, 4, 5]]] and (mode, kind) == ("RGB", "PPM")
    exif = lambda turn: chunk(b"eXIf", b"MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 274, 3, 1, turn, 0))
    seen = {t: R.decoded(png(2, 1, 8, 0, [(0, bytes([1, 2]))], exif(t)))[0][:, :, 0].tolist() for t in range(1, 9)}
    assert seen == {1: [[1, 2]], 2: [[2, 1]], 3: [[2, 1]], 4: [[1, 2]], 5: [[1], [2]], 6: [[1], [2]], 7: [[2], [1]], 8: [[2], [1]]}


GOOD = R.encoded_png(np.arange(64, dtype=np.uint8).reshape(8, 8))


@pytest.mark.parametrize("data", [None, b"", b"no image", GOOD[:-20], GOOD[:30], GOOD[:50] + b"x" + GOOD[51:], PNG, png(1 << 20, 1 << 20, 8, 0, [(0, b"")]), png(2, 1, 8, 0, [(7, b"ab")]), png(2, 2, 8, 0, [(0, b"ab")]), png(0, 1, 8, 0, [(0, b"")]), b"P5\n", b"P5\nx 1\n255\n1"])
def test_damaged_files_are_errors(data):
    found = R.measured(data)
    assert found["decode_ok"] is False and found["error_type"] == "DecodeError" and "perceptual_hash" not in found


def plain_metrics(grey):
    """Mean, deviation, variance of the Laplacian and mean change, pixel by pixel."""
    h, w = len(grey), len(grey[0])
    flat = [v for row in grey for v in row]
    mean = sum(flat) / len(flat)
    lap = [grey[y - 1][x] + grey[y + 1][x] + grey[y][x - 1] + grey[y][x + 1] - 4 * grey[y][x] for y in range(1, h - 1) for x in range(1, w - 1)] if h > 2 and w > 2 else []
    at = sum(lap) / len(lap) if lap else 0
    across = [abs(r[x + 1] - r[x]) for r in grey for x in range(w - 1)]
    down = [abs(grey[y + 1][x] - grey[y][x]) for y in range(h - 1) for x in range(w)]
    average = lambda v: sum(v) / len(v) if v else 0.0
    return mean, math.sqrt(average([(v - mean) ** 2 for v in flat])), average([(v - at) ** 2 for v in lap]), (average(across) + average(down)) / 2


def plain_hash(grey):
    """Shrinks rows and then columns by a Lanczos filter of three lobes, in whole numbers of 22 bits."""

    def shrink(line):
        scale = len(line) / 8
        wide, out = max(scale, 1.0), []
        for k in range(8):
            centre = (k + 0.5) * scale
            a, b = max(0, int(centre - 3 * wide + 0.5)), min(len(line), int(centre + 3 * wide + 0.5))
            sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
            t = [(x - centre + 0.5) / wide for x in range(a, b)]
            weights = [sinc(v) * sinc(v / 3) if -3 < v < 3 else 0.0 for v in t]
            whole = [int(v / sum(weights) * (1 << 22) + (0.5 if v >= 0 else -0.5)) for v in weights]
            out.append(min(255, max(0, (sum(c * v for c, v in zip(whole, line[a:b], strict=True)) + (1 << 21)) >> 22)))
        return out

    rows = [shrink(r) for r in grey]
    small = [v for column in zip(*[shrink(list(c)) for c in zip(*rows, strict=True)], strict=True) for v in column]
    mean = sum(small) / 64
    return f"{int(''.join('1' if v >= mean else '0' for v in small), 2):016x}"


@pytest.mark.parametrize("width,height", [(1, 1), (1, 9), (9, 1), (2, 2), (3, 3), (8, 8), (7, 20), (64, 33), (200, 5)])
def test_measures_are_those_of_a_plain_version(width, height):
    rng = np.random.default_rng(width * 100 + height)
    grey = rng.integers(0, 256, (height, width), np.uint8)
    found = R.measured(R.encoded_png(grey))
    assert (found["image_width"], found["image_height"], found["decode_ok"]) == (width, height, True)
    want = plain_metrics(grey.tolist())
    assert [found[k] for k in ("brightness_mean", "brightness_std", "blur_score", "sharpness")] == pytest.approx(want)
    assert found["perceptual_hash"] == plain_hash(grey.tolist())


def test_luminance_of_colours():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [12, 34, 56]]], np.uint8)
    assert R.luminance(rgb).tolist() == [[76, 150, 29, 255, 30]]


def test_metrics_in_a_frame_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, bytearray(GOOD), "x"), (2, None, "y"), (3, bytearray(GOOD), "z")], "id int, content binary, brightness_mean string")
    got = {r.id: r for r in M.photo_quality(R.photo_metrics(rows)).collect()}
    assert got[1].perceptual_hash == got[3].perceptual_hash and got[1].brightness_mean == 31.5 and got[2].issue_flags == ["decode_error"] and got[2].quality_score == 0.0
    assert got[1].issue_flags == ["too_dark", "low_contrast", "blurry", "low_resolution"] and got[1].needs_review
    assert R.photo_metrics(rows.limit(0)).collect() == []


def test_copies_are_those_of_a_plain_version(spark):
    """The registered query over whole tables beside loops over its documents."""
    sf = "/root/testdata/sf0.001"
    want, first = [], {}
    for r in sorted(table(spark, sf, "documents").collect(), key=lambda r: r.doc_id):
        if r.doc_id % photos.DAMAGED == 0:
            continue
        data = (r.text or "").encode()
        height = max(1, -(-len(data) // photos.WIDTH))
        data = data.ljust(height * photos.WIDTH, b"\xff")
        key = r.source, plain_hash([list(data[y * photos.WIDTH : (y + 1) * photos.WIDTH]) for y in range(height)])
        if key in first:
            want.append((r.source, str(r.doc_id), str(first[key]), key[1]))
        first.setdefault(key, r.doc_id)
    assert sorted(map(tuple, photos.photo_copies(spark, sf).collect())) == sorted(want) and want


def test_first_photo_of_a_group_is_no_copy(spark):
    rows = [("c", 2, "b", True, "h"), ("c", 1, "z", True, "h"), ("c", 1, "z", True, "h"), ("d", 1, "a", True, "h"), ("c", 3, "x", False, "h"), ("c", 4, "y", True, None)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "claim_id string, ordinal int, file_id string, decode_ok boolean, perceptual_hash string")
    assert [(r.file_id, r.first_file_id) for r in P.copied_photos(frame).collect()] == [("b", "z")]


def test_batches_of_photos_are_bounded(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "10000")
        spark.conf.set(names[1], "64m")
        photos.photo_pixels(spark, "/root/testdata/sf0.001")
        assert [spark.conf.get(n) for n in names] == ["1000", str(16 << 20)]
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
