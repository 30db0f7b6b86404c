"""Byte-level BPE: encoding by a monoid tree reduction, and decoding.

A text is halved recursively. Halves of at most LEAF code points are encoded by the rank file's own encoder; two
neighbours are joined by encoding anew a window around the cut, which grows until the tokens outside it provably
stay as they are. What makes them stay: no match of the splitting pattern crosses from a character that is not white
space to white space, and the pattern never looks back, so the matches, and with them the tokens, on either side of
such a place do not depend on the other side. A text without any such place is encoded whole. Joining is therefore
associative, and any tree gives the tokens of the whole text. Decoding concatenates bytes up the same kind of tree.

Defined cases: null and empty texts have no tokens; rows are kept as they are, repeated ids too; columns other than
doc_id and text are ignored by the query and kept by ``encoded`` and ``encoded_with_digests``, but for columns named as
those that these add, which they replace.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cairn.llm.common import SPACE, bounded, slices
from cairn.session import table

#: Code points of a leaf of the tree, and of the first window at a cut.
LEAF, WINDOW = 4096, 64


@functools.cache
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file, loaded once a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


@functools.cache
def token_sizes(path: str) -> np.ndarray:
    """Bytes of each token by its id."""
    known = encoding(path)
    out = np.zeros(known.n_vocab, np.int64)
    for token in known.token_byte_values():
        out[known.encode_single_token(token)] = len(token)
    return out


class Coder:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        self.encoding, self.leaf, self.window = encoding(path), leaf, window
        self.sizes = token_sizes(path)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        return self._tree(text, 0, len(text), [m.start() for m in _SAFE.finditer(text)])

    def _tree(self, text: str, a: int, b: int, safe: list[int]) -> list[int]:
        """The tokens of text[a:b]; ``safe`` are the places of the whole text that no match crosses.

        A part without such a place would be encoded whole at its join, so it is not halved.
        """
        inside = bisect.bisect_right(safe, a)
        if b - a <= self.leaf or inside == len(safe) or safe[inside] >= b:
            return self.encoding.encode_ordinary(text[a:b])
        cut = (a + b) // 2
        return self.join(text, a, cut, b, self._tree(text, a, cut, safe), self._tree(text, cut, b, safe), safe)

    def join(self, text: str, a: int, cut: int, b: int, left: list[int], right: list[int], safe: list[int]) -> list[int]:
        """The tokens of text[a:b] from those of text[a:cut] and text[cut:b]: a window around the cut is encoded anew,
        twice as wide each time, until it reaches places on both sides that no match crosses."""
        if a == cut or cut == b:
            return left or right
        after = bisect.bisect_left(safe, cut)
        if after < len(safe) and safe[after] == cut:
            return left + right
        before, reach = safe[after - 1] if after and safe[after - 1] > a else a, self.window
        after = safe[after] if after < len(safe) and safe[after] < b else b
        while max(a, cut - reach) > before or min(b, cut + reach) < after:
            reach *= 2
        middle = self.encoding.encode_ordinary(text[before:after])
        keep = len(left) - self._count(left[::-1], len(text[before:cut].encode()))
        skip = self._count(right, len(text[cut:after].encode()))
        return left[:keep] + middle + right[skip:]

    def _count(self, tokens: list[int], n_bytes: int) -> int:
        """How many tokens take the first ``n_bytes``; sizes are added up in runs that double."""
        done, run = 0, 64
        while n_bytes > 0:
            sums = np.cumsum(self.sizes[tokens[done : done + run]])
            if sums[-1] >= n_bytes:
                return done + int(np.searchsorted(sums, n_bytes)) + 1
            n_bytes -= int(sums[-1])
            done, run = done + run, run * 2
        return done

    def decode(self, tokens: list[int], leaf: int = 1 << 14) -> bytes:
        """The bytes of the tokens, concatenated up the tree."""
        if len(tokens) <= leaf:
            return self.encoding.decode_bytes(tokens)
        cut = len(tokens) // 2
        return self.decode(tokens[:cut], leaf) + self.decode(tokens[cut:], leaf)


def as_bytes(tokens: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(tokens, "<u4").tobytes()


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", leaf: int = LEAF) -> DataFrame:
    """``docs`` and an array<int> of token ids; the vocabulary is read by each worker from ``path``."""
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, leaf)
        for batch in batches:
            for part in slices(batch, text):
                column = pa.array([coder.encode(x or "") for x in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, ids])

    return bounded(docs).mapInArrow(run, schema)


def encoded_with_digests(docs: DataFrame, path: str, ids: str | None = "token_ids", leaf: int = LEAF) -> DataFrame:
    """``docs`` and n_tokens, the ids (unless ``ids`` is None), ids_sha256 and decoded_sha256 of each row."""
    added = [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()), ("decoded_sha256", pa.string(), T.StringType())]
    if ids:
        added.insert(1, (ids, pa.list_(pa.int32()), T.ArrayType(T.IntegerType(), False)))
    docs = docs.drop(*(name for name, *_ in added))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind, False) for name, _, kind in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, leaf)
        for batch in batches:
            for part in slices(batch):
                made: dict[str, list] = {name: [] for name, *_ in added}
                for x in part.column("text").to_pylist():
                    tokens = coder.encode(x or "")
                    made["n_tokens"].append(len(tokens))
                    if ids:
                        made[ids].append(tokens)
                    made["ids_sha256"].append(hashlib.sha256(as_bytes(tokens)).hexdigest())
                    made["decoded_sha256"].append(hashlib.sha256(coder.decode(tokens)).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(made[name], kind) for name, kind, _ in added)], [*part.schema.names, *made])

    return bounded(docs).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return encoded_with_digests(docs.select("doc_id", "text"), path, None, leaf).drop("text")


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op5_byte_level_bpe": op5_byte_level_bpe}
ORACLES: dict[str, str] = {}
