"""Pixels of raster photos: decoding, brightness, contrast, blur and an average hash, in Arrow batches.

PNG (all colour types and depths, not interlaced) and binary PNM are decoded by numpy; other formats where Pillow can be
imported on the workers, and are decode errors elsewhere. What is judged of the numbers is native:
``media.photo_quality`` and ``media.photo_quality_means`` take the columns that ``photo_metrics`` gives.

Defined cases: null, damaged, truncated, empty and oversized (MOST_PIXELS) files have ``decode_ok`` false, the error's
name and text, and null metrics; images of fewer than 3 rows or columns have a blur score of 0, one row or column changes
by 0 along its short side; transparency is ignored; turned photos (Exif) are turned back.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of an image, at most: beyond that a file is refused before its pixels are unpacked.
MOST_PIXELS = 1 << 27
#: Side of the picture that an average hash is taken of.
HASH_SIDE = 8

#: What ``photo_metrics`` adds, and its types.
METRICS = {
    "decode_ok": "boolean", "decode_error": "string", "error_type": "string", "image_format": "string", "image_mode": "string", "image_width": "int", "image_height": "int", "aspect_ratio": "double",
    "megapixels": "double", "brightness_mean": "double", "brightness_std": "double", "blur_score": "double", "sharpness": "double", "perceptual_hash": "string",
}
_ARROW = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}


class DecodeError(ValueError):
    """A file is not an image that can be decoded."""


# --- decoding ----------------------------------------------------------------------------------------------------

_PNG = b"\x89PNG\r\n\x1a\n"
#: Colour type: samples a pixel, name of the mode; fixed values of the format.
_COLOUR = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}


def _chunks(data: bytes) -> dict[bytes, bytes]:
    found: dict[bytes, bytes] = {}
    at = len(_PNG)
    while at < len(data):
        if at + 12 > len(data):
            raise DecodeError("the file ends within a chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise DecodeError(f"chunk {kind.decode('latin-1')} is damaged")
        found[kind] = found.get(kind, b"") + body
        if kind == b"IEND":
            return found
        at += 12 + size
    raise DecodeError("the file has no end")


def _paeth(a: int, b: int, c: int) -> int:
    """The neighbour (left, above, above left) that is nearest to a + b - c."""
    p = a + b - c
    return min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]


def _unfiltered(raw: bytes, height: int, row_bytes: int, step: int) -> np.ndarray:
    """Rows of a PNG without their filters; ``step``: bytes from a sample to the same one of the pixel before."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, row_bytes + 1)
    out = np.zeros((height, row_bytes), np.uint8)
    above = np.zeros(row_bytes, np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:  # sums along the row, each sample on its own
            padded = np.concatenate((line, np.zeros(-len(line) % step, np.uint8))).reshape(-1, step)
            out[y] = np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[:row_bytes]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):  # each byte needs the one before it
            done, up = bytearray(row_bytes), above.tobytes()
            for x, v in enumerate(line.tobytes()):
                left, corner = (done[x - step], up[x - step]) if x >= step else (0, 0)
                done[x] = (v + ((left + up[x]) >> 1 if kind == 3 else _paeth(left, up[x], corner))) & 255
            out[y] = np.frombuffer(bytes(done), np.uint8)
        else:
            raise DecodeError(f"filter {kind} is unknown")
        above = out[y]
    return out


def _orientation(exif: bytes) -> int:
    """The Exif tag 274 of a TIFF header's first directory; 1 where there is none."""
    if len(exif) < 8 or exif[:2] not in (b"II", b"MM"):
        return 1
    order = "<" if exif[:2] == b"II" else ">"
    at = struct.unpack(order + "I", exif[4:8])[0]
    if at + 2 > len(exif):
        return 1
    for k in range(struct.unpack(order + "H", exif[at : at + 2])[0]):
        entry = exif[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 274:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def _turned(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it is to be seen."""
    if orientation in (2, 4, 5, 7):
        pixels = pixels[:, ::-1]
    quarter = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)
    return np.rot90(pixels, quarter)


def _png(data: bytes) -> tuple[np.ndarray, str]:
    chunks = _chunks(data)
    if len(chunks.get(b"IHDR", b"")) != 13:
        raise DecodeError("the header is missing")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if colour not in _COLOUR or depth not in (1, 2, 4, 8, 16) or interlaced:
        raise DecodeError(f"colour type {colour} of {depth} bits{', interlaced,' if interlaced else ''} is not decoded")
    if not width or not height or width * height > MOST_PIXELS:
        raise DecodeError(f"{width} x {height} pixels")
    samples, mode = _COLOUR[colour]
    row_bytes, step = (width * samples * depth + 7) // 8, max(1, samples * depth // 8)
    unpack = zlib.decompressobj()
    raw = unpack.decompress(chunks.get(b"IDAT", b""), height * (row_bytes + 1))
    if len(raw) != height * (row_bytes + 1):
        raise DecodeError("pixels are missing")
    rows = _unfiltered(raw, height, row_bytes, step)
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * samples * depth].reshape(height, -1, depth)
        rows = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
        rows = rows if colour == 3 else (rows.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    rows = rows.reshape(height, width, samples)
    if colour == 3:
        palette = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if rows.size and int(rows.max()) >= len(palette):
            raise DecodeError("a colour is not in the palette")
        rows = palette[rows[:, :, 0]]
    rgb = rows[:, :, :3] if rows.shape[2] >= 3 else np.repeat(rows[:, :, :1], 3, axis=2)
    return _turned(rgb, _orientation(chunks.get(b"eXIf", b""))), mode


def _pnm(data: bytes) -> tuple[np.ndarray, str]:
    fields, at = [], 2
    while len(fields) < 3:
        end = at + 1
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        token = data[at:end].strip()
        if token.startswith(b"#"):
            at = data.find(b"\n", at + 1)
            if at < 0:
                raise DecodeError("the header does not end")
            continue
        if not token.isdigit():
            raise DecodeError("the header is not of three numbers")
        fields.append(int(token))
        at = end
    width, height, most = fields
    samples = 3 if data[:2] == b"P6" else 1
    if not width or not height or width * height > MOST_PIXELS or most != 255:
        raise DecodeError(f"{width} x {height} pixels up to {most}")
    body = data[at + 1 : at + 1 + width * height * samples]
    if len(body) != width * height * samples:
        raise DecodeError("pixels are missing")
    pixels = np.frombuffer(body, np.uint8).reshape(height, width, samples)
    return np.repeat(pixels, 3 // samples, axis=2), "RGB" if samples == 3 else "L"


def decoded(data: bytes) -> tuple[np.ndarray, str, str]:
    """Pixels (rows x columns x RGB), format and mode of a file."""
    try:
        if data.startswith(_PNG):
            return *_png(data), "PNG"
        if data[:2] in (b"P5", b"P6"):
            return *_pnm(data), "PPM"
    except (zlib.error, struct.error, ValueError) as e:
        raise e if isinstance(e, DecodeError) else DecodeError(str(e)) from e
    try:
        from PIL import Image, ImageOps
    except ImportError:
        raise DecodeError("the format is unknown") from None
    try:
        with Image.open(io.BytesIO(data)) as opened:
            if opened.width * opened.height > MOST_PIXELS:
                raise DecodeError(f"{opened.width} x {opened.height} pixels")
            return np.asarray(ImageOps.exif_transpose(opened).convert("RGB")), opened.mode, opened.format
    except (OSError, ValueError, SyntaxError) as e:
        raise DecodeError(str(e)) from e


def encoded_png(pixels: np.ndarray) -> bytes:
    """A lossless PNG of rows x columns (grey) or rows x columns x 3 samples of eight bits."""
    height, width = pixels.shape[:2]
    lines = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1)
    header = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


# --- measures ----------------------------------------------------------------------------------------------------


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Grey of ITU-R 601, in 16-bit fixed point, rounded."""
    return ((rgb.astype(np.uint32) @ np.array([19595, 38470, 7471], np.uint32) + 0x8000) >> 16).astype(np.uint8)


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the four neighbours' sum less four times the pixel, over inner pixels; low where a photo is blurred."""
    if min(grey.shape) < 3:
        return 0.0
    g = grey.astype(np.int32)
    inner = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(inner.var())


def mean_change(grey: np.ndarray) -> float:
    """The mean of the mean absolute changes along rows and along columns."""
    g = grey.astype(np.int32)
    sides = [np.abs(np.diff(g, axis=axis)) for axis in (0, 1)]
    return sum(float(d.mean()) if d.size else 0.0 for d in sides) / 2


def _lanczos(size: int, to: int) -> np.ndarray:
    """to x size weights of a Lanczos filter with three lobes, in 22-bit fixed point, widened where it makes smaller."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    first = np.maximum((centre - 3 * wide + 0.5).astype(int), 0)
    last = np.minimum((centre + 3 * wide + 0.5).astype(int), size)
    x = np.arange(size)
    t = (x - centre[:, None] + 0.5) / wide
    weights = np.where((np.abs(t) < 3) & (x >= first[:, None]) & (x < last[:, None]), np.sinc(t) * np.sinc(t / 3), 0.0)
    return np.trunc(weights / weights.sum(axis=1, keepdims=True) * (1 << 22) + np.where(weights < 0, -0.5, 0.5) * (weights != 0)).astype(np.int64)


def shrunk(grey: np.ndarray, side: int = HASH_SIDE) -> np.ndarray:
    """The picture as side x side pixels, rows first, each pass rounded to eight bits."""
    at = grey.astype(np.int64)
    for _ in range(2):
        at = np.clip((at @ _lanczos(at.shape[1], side).T + (1 << 21)) >> 22, 0, 255).T
    return at.astype(np.uint8)


def average_hash(grey: np.ndarray) -> str:
    """A bit a pixel of the shrunk picture, set where it is no darker than the mean, as hex digits."""
    small = shrunk(grey)
    return np.packbits(small >= small.mean()).tobytes().hex()


def measured(data: bytes | None) -> dict:
    """The METRICS of one file."""
    try:
        pixels, mode, kind = decoded(data or b"")
    except DecodeError as e:
        return {"decode_ok": False, "decode_error": f"DecodeError: {e}", "error_type": "DecodeError", "image_width": 0, "image_height": 0}
    grey = luminance(pixels)
    height, width = grey.shape
    return {
        "decode_ok": True, "image_format": kind, "image_mode": mode, "image_width": width, "image_height": height, "aspect_ratio": width / height, "megapixels": width * height / 1e6,
        "brightness_mean": float(grey.mean()), "brightness_std": float(grey.std()), "blur_score": laplacian_variance(grey), "sharpness": mean_change(grey), "perceptual_hash": average_hash(grey),
    }


def metrics(content: Column) -> Column:
    """A struct of METRICS for each file's bytes."""

    def run(files: pa.Array) -> pa.Array:
        return pa.array([measured(x) for x in files.to_pylist()], pa.struct({n: _ARROW[t] for n, t in METRICS.items()}))

    return F.arrow_udf(run, f"struct<{', '.join(f'{n}:{t}' for n, t in METRICS.items())}>")(content)


def photo_metrics(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with the METRICS in place of the bytes; other columns of those names give way."""
    at = files.withColumn("__photo", metrics(F.col(content))).drop(content, *METRICS)
    return at.select(*(F.col(f"`{c}`") for c in at.columns if c != "__photo"), *(F.col("__photo")[n].alias(n) for n in METRICS))


def rendered(payload: Column, width: int) -> Column:
    """Bytes as the pixels of a grey PNG of ``width`` columns, the last row filled up with 255; one row at least."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for data in texts.to_pylist():
            data = data or b""
            rows = max(1, -(-len(data) // width))
            out.append(encoded_png(np.frombuffer(data.ljust(rows * width, b"\xff"), np.uint8).reshape(rows, width)))
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(payload)
