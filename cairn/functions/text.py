"""Text kernels: normalization, tokens, shingles, MinHash signatures and band keys."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signature length, bands, words of a shingle, and the modulus of the affine permutations; fixed values.
PERMUTATIONS, BANDS, SHINGLE, PRIME = 64, 8, 5, 2**31 - 1

try:  # the interpreter's own MD5 starts faster than OpenSSL's, which counts for digests of a few words
    from _md5 import md5 as _md5
except ImportError:
    _md5 = hashlib.md5

#: Columns of the permuted values that are computed at once: they stay in a core's cache.
_WIDTH = 512
_WORD = re.compile(r"[^\W_]+")


def normalize(text: str) -> str:
    """Lower case without accents; whatever is neither letter nor digit becomes one space."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        for mark in filter(unicodedata.combining, set(text)):  # a text has few kinds of marks
            text = text.replace(mark, "")
    return " ".join(_WORD.findall(text.lower()))


def shingles(tokens: list[str], size: int = SHINGLE) -> list[str]:
    """Distinct runs of ``size`` tokens in first-seen order; a shorter text is one shingle, an empty one none."""
    if not tokens:
        return []
    return list(dict.fromkeys(" ".join(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))))


@functools.cache
def permutations(n: int = PERMUTATIONS) -> tuple[tuple[int, int], ...]:
    """Multipliers and offsets of the affine permutations, drawn from digests of their numbers."""
    draw = lambda kind, i: int(hashlib.md5(f"{kind}{i}".encode()).hexdigest()[:7], 16)
    return tuple((draw("a", i) + 1, draw("b", i)) for i in range(n))


def shingle_codes(parts: list[str]) -> np.ndarray:
    """The first 60 bits of each shingle's digest."""
    digests = b"".join([_md5(p.encode()).digest() for p in parts])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)


@functools.cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(x, np.uint64)[:, None] for x in zip(*permutations(), strict=True))


def affine_signature(parts: list[str], codes: np.ndarray | None = None) -> list[int]:
    """Minima of affine permutations of the first 28 bits of each shingle's digest; all zero without shingles."""
    if not parts:
        return [0] * PERMUTATIONS
    h = ((shingle_codes(parts) if codes is None else codes) >> 32).astype(np.uint64)
    a, b = _factors()
    least = np.full(PERMUTATIONS, PRIME, np.uint32)
    wide, high = np.empty((2, PERMUTATIONS, min(_WIDTH, len(h))), np.uint64)
    for at in range(0, len(h), _WIDTH):
        some = h[at : at + _WIDTH]
        x, y = wide[:, : len(some)], high[:, : len(some)]
        # Values stay below 2 to the power 57 and PRIME is 31 ones: the halves are added instead of divided.
        np.add(np.multiply(a, some, out=x), b, out=x)
        np.right_shift(x, 31, out=y)
        np.add(np.bitwise_and(x, PRIME, out=x), y, out=x)
        low = x.astype(np.uint32)  # below twice PRIME; where it is less than PRIME, the difference wraps to more
        np.minimum(least, np.minimum(low, low - np.uint32(PRIME)).min(axis=1), out=least)
    return least.tolist()


def blake2b_signature(parts: list[str], codes: np.ndarray | None = None, seed: int = 42) -> list[int]:
    """Minima of 64-bit keyed digests, as signed 64-bit patterns; all zero without shingles."""
    if not parts:
        return [0] * PERMUTATIONS
    of = lambda s: min(int.from_bytes(hashlib.blake2b(f"{s}:{p}".encode(), digest_size=8).digest(), "little") for p in parts)
    return np.array([of(seed + i) for i in range(PERMUTATIONS)], np.uint64).view(np.int64).tolist()


SIGNATURES = {"affine": affine_signature, "blake2b": blake2b_signature}


def band_keys(signature: list[int], bands: int = BANDS) -> list[str]:
    """One digest a band of the signature's values."""
    rows = len(signature) // bands
    return [hashlib.md5(",".join(map(str, signature[i * rows : (i + 1) * rows])).encode()).hexdigest() for i in range(bands)]


def numbered_band_keys(signature: list[int], bands: int = BANDS) -> list[str]:
    """One key a band: its number in three digits and the 64-bit BLAKE2b digest of number and values,
    the values as unsigned."""
    rows, unsigned = len(signature) // bands, [v % (1 << 64) for v in signature]
    payload = lambda i: f"{i}:{','.join(map(str, unsigned[i * rows : (i + 1) * rows]))}".encode()
    return [f"{i:03d}:{hashlib.blake2b(payload(i), digest_size=8).hexdigest()}" for i in range(bands)]


BAND_KEYS = {"affine": band_keys, "blake2b": numbered_band_keys}


def fingerprints(docs: DataFrame, hash: str = "affine", text: str = "text") -> DataFrame:
    """``docs`` without the text, and normalized_sha256, token_count, unique_tokens, shingles, signature, bands, shingles_sha256.

    ``shingles`` are 60-bit hashes of the distinct shingles; ``bands`` is empty for texts without tokens, which
    therefore never become candidates. ``shingles_sha256`` is of the sorted shingles: equal sets have equal ones.
    """
    keep = [f for f in docs.schema.fields if f.name != text]
    added = "normalized_sha256 string, token_count bigint, unique_tokens bigint, shingles array<bigint>, signature array<bigint>, bands array<string>, shingles_sha256 string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), added])
    sign, keys = SIGNATURES[hash], BAND_KEYS[hash]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for value in part.column(text).to_pylist():
                    plain = normalize(value or "")
                    tokens = plain.split()
                    parts = shingles(tokens)
                    codes = shingle_codes(parts)
                    signature = sign(parts, codes)
                    rows.append((hashlib.sha256(plain.encode()).hexdigest(), len(tokens), len(set(tokens)), codes, signature, keys(signature) if parts else [], hashlib.sha256(np.sort(codes).tobytes()).hexdigest()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string())
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, "normalized_sha256", "token_count", "unique_tokens", "shingles", "signature", "bands", "shingles_sha256"])

    return docs.mapInArrow(run, schema)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def candidate_probability(similarity: float, bands: int = BANDS, rows: int = PERMUTATIONS // BANDS) -> float:
    """The chance that two texts of this similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands
