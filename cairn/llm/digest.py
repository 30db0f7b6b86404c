"""Document fingerprints: improbable-feature digests.

Every window of 64 bytes, and in short texts also every one of 16 or 8, has a collision entropy: how often two of its bytes are equal. Windows are ranked by how
rare their entropy is, as the distance from the typical value of text in units of its spread; windows of hardly any
entropy (runs of one byte) are never selected unless nothing else is there. A window that is the rarest, leftmost
among equals, of enough of the neighbourhoods it lies in is a feature. Features are hashed into a chain of
Bloom filters of FILTER_BITS bits, FILTER_FEATURES a filter. Two digests compare filter by filter: the overlap of
their bits, less what chance gives, as a share of the largest possible; each filter of the shorter digest counts
with its best partner, weighted by its features.

All this is local: equal texts have equal digests, and a digest does not depend on the corpus.

Defined cases: null is an empty text; an empty text has an empty digest, which is like another empty one (1) and
unlike any other (0); a text no longer than a window is one feature; very long texts are ranked in pieces; the next
document of the query is the next lower doc_id, or of equal ids the next in the order of the texts' hashes, and after
the last comes the first; rows without a doc_id come last; of rows equal in both, each but the last is followed by its
equal; an empty table gives an empty result; other columns are ignored by the query and kept by ``digests``, but for one
named as the digest, which it replaces.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import bounded, slices, utf8
from cairn.session import table
from cairn.storage import broadcast_if_small, store

#: For long windows and for short ones: bytes, windows of a neighbourhood, of how many of these a feature must be the
#: rarest, pairs of equal bytes that are typical of text, their spread, and from how many on a window is too plain.
LONG, SHORT, TINY = (64, 48, 12, 161, 30, 1000), (16, 16, 5, 10, 4, 60), (8, 4, 2, 2, 1, 20)
#: Texts of fewer bytes get short windows besides the long ones, and texts of fewer still tiny ones.
SHORT_BYTES, TINY_BYTES = 1024, 128
#: Bits and features of a filter, and bits a feature sets.
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Bytes that are ranked at once.
CHUNK = 1 << 16


def equal_pairs(data: np.ndarray, width: int) -> np.ndarray:
    """For each window, how many pairs of its bytes are equal: the collision entropy, up to a monotone map."""
    n = len(data)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the width-1 before, and after
    for lag in range(1, width):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        back[lag:] += same
        ahead[:-lag] += same
    first = int(back[:width].sum())
    return np.concatenate(([first], first + np.cumsum(back[width:].astype(np.int32) - ahead[: n - width])))


def rarity(data: np.ndarray, kind: tuple = LONG) -> np.ndarray:
    """Rank of each window by its entropy's distance from the typical, from 1; 0 where it holds hardly anything."""
    width, _, _, typical, spread, plain = kind
    out = []
    for at in range(0, len(data) - width + 1, CHUNK):
        pairs = equal_pairs(data[at : at + CHUNK + width - 1], width)
        out.append(np.where(pairs > plain, 0, np.minimum(4095, 1 + np.abs(pairs - typical) * 16 // spread)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def features(texts: list[bytes], kind: tuple = LONG) -> list[list[bytes]]:
    """The improbable windows of each text, in order; ranked together, since windows across two texts are left out."""
    width, neighbours, popular, *_ = kind
    out: list[list[bytes]] = [[t] if 0 < len(t) <= width else [] for t in texts]
    who = [i for i, t in enumerate(texts) if len(t) > width]
    if not who:
        return out
    data = b"".join([texts[i] for i in who])
    rank = rarity(np.frombuffer(data, np.uint8), kind)
    sizes = np.array([len(texts[i]) for i in who])
    start = np.cumsum(sizes) - sizes
    windows = sizes - width + 1
    key = ((4095 - rank).astype(np.int64) << 40) | np.arange(len(rank))
    votes = np.zeros(len(rank), np.int64)
    many = windows > neighbours
    if many.any():
        inside = np.zeros(len(rank) + 1, np.int64)
        np.add.at(inside, start[many], 1)
        np.add.at(inside, (start + windows - neighbours + 1)[many], -1)
        least = _sliding_min(key, neighbours)
        votes += np.bincount(least[np.cumsum(inside[: len(least)]) > 0] & ((1 << 40) - 1), minlength=len(rank))
    for a, n in zip(start[~many].tolist(), windows[~many].tolist(), strict=True):
        votes[a + int(np.argmin(key[a : a + n]))] = neighbours
    chosen = np.flatnonzero(votes >= popular)
    for i, a, n in zip(who, start.tolist(), windows.tolist(), strict=True):
        own = chosen[np.searchsorted(chosen, a) : np.searchsorted(chosen, a + n)]
        if not len(own):
            own = a + np.flatnonzero(votes[a : a + n])
        out[i] = [data[b : b + width] for b in own.tolist()]
    return out


def _chain(found: list[bytes]) -> bytes:
    """Filters of distinct features, each after their number as two bytes."""
    distinct, out = list(dict.fromkeys(found)), []
    for at in range(0, len(distinct), FILTER_FEATURES):
        part = distinct[at : at + FILTER_FEATURES]
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in part]), "<u2").reshape(-1, 8)[:, :HASHES] % FILTER_BITS
        bits = np.zeros(FILTER_BITS, np.uint8)
        bits[h.ravel()] = 1
        out.append(len(part).to_bytes(2, "little") + np.packbits(bits).tobytes())
    return b"".join(out)


def digest_all(texts: list[bytes]) -> list[bytes]:
    """The digest of each text."""
    long = features(texts)
    short = features([t if len(t) < SHORT_BYTES else b"" for t in texts], SHORT)
    tiny = features([t if len(t) < TINY_BYTES else b"" for t in texts], TINY)
    return [_chain(a + b + c) for a, b, c in zip(long, short, tiny, strict=True)]


def digest(text: bytes) -> bytes:
    return digest_all([text])[0]


def _filters(digest_: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(digest_, np.uint8).reshape(-1, FILTER_BITS // 8 + 2)
    return rows[:, 0].astype(np.int64) + (rows[:, 1].astype(np.int64) << 8), np.ascontiguousarray(rows[:, 2:]).view(np.uint64)


def likeness(a: bytes, b: bytes) -> float:
    """Normalised overlap of two digests, 0 to 1."""
    if not a or not b:
        return float(not a and not b)
    (na, fa), (nb, fb) = _filters(a), _filters(b)
    if (len(fa), int(na.sum())) > (len(fb), int(nb.sum())):
        na, fa, nb, fb = nb, fb, na, fa
    sa, sb = (np.bitwise_count(f).sum(axis=1, dtype=np.int64) for f in (fa, fb))
    overlap = np.stack([np.bitwise_count(row & fb).sum(axis=1, dtype=np.int64) for row in fa])
    most = np.minimum(sa[:, None], sb[None, :])
    chance = sa[:, None] * sb[None, :] / FILTER_BITS
    cut = chance + 0.15 * (most - chance)
    score = np.clip((overlap - cut) / np.maximum(most - cut, 1e-9), 0, 1)
    return float((score.max(axis=1) * na).sum() / na.sum())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def printable(digest_: bytes) -> str:
    return base64.b64encode(digest_).decode()


def digests(docs: DataFrame, text: str = "text", name: str = "digest") -> DataFrame:
    """``docs`` and a binary digest of each row's text."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = pa.array(digest_all(utf8(part, text)), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return bounded(docs).mapInArrow(run, schema)


# --- each document beside the next one ---------------------------------------------------------------------------

#: Documents that a range should hold; ranges at most, 16 sampled documents each.
RANGE_ROWS, MAX_RANGES = 1000, 1 << 17
#: Equal rows that are given out at once.
REPEATS = 4096


def _place(doc_id: int | None, tie: int) -> tuple[bool, int, int]:
    """Where a document stands in the order: descending ids, those without one last, then ascending hashes."""
    return doc_id is None, 0 if doc_id is None else -doc_id, tie


def _cuts(keys: DataFrame, rows: int) -> list[tuple[bool, int, int]]:
    """Places at which ranges of about RANGE_ROWS documents begin, in order, from a bounded sample by hash."""
    want = min(MAX_RANGES, rows // RANGE_ROWS)
    if want < 2:
        return []
    share = int(min(1.0, 16 * want / rows) * (1 << 30))
    few = keys.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1 << 30)) < share).select("doc_id", "tie").toArrow()
    places = sorted(map(_place, few.column("doc_id").to_pylist(), few.column("tie").to_pylist()))
    return sorted({places[i] for i in np.linspace(0, len(places), want, endpoint=False).astype(int)[1:]}) if places else []


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range after another, in order, each range ended by the document that follows it (``head``).

    ``n`` equal rows come as one: all but the last are followed by themselves.
    """
    held = None
    for batch in batches:
        for part in slices(batch, max_bytes=1 << 20):
            pairs = []
            columns = (part.column(c).to_pylist() for c in ("head", "doc_id", "n", "text"))
            for head, doc_id, n, text, own in zip(*columns, digest_all(utf8(part)), strict=True):
                now = (doc_id, text or "", own)
                if held is not None:
                    pairs.append((held, now, 1))
                if n > 1 and not head:
                    pairs.append((now, now, n - 1))
                held = None if head else now
            changed = [edited(a[1], b[1]).encode() for a, b, _ in pairs]
            rows = []
            for (a, b, n), c, d in zip(pairs, changed, digest_all(changed), strict=True):
                row = (a[0], len(a[1]), hashlib.sha256(c).hexdigest(), printable(a[2]), printable(d), likeness(a[2], d), likeness(a[2], b[2]))
                for at in range(0, n, REPEATS):
                    rows += [row] * min(REPEATS, n - at)
                    if len(rows) >= REPEATS:
                        yield _table(rows)
                        rows = []
            if rows:
                yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COMPARED, strict=True)], schema=_COMPARED)


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Documents are dealt into ranges of the order by doc_id and text, so that texts are shuffled once and neither one
    doc_id nor rows without one fill a range. The first document of each range is also sent to the range before it,
    whose last document it follows; the first of all is sent to the last range. Ranges are sorted within their tasks,
    by Spark's sort, which spills. Equal rows are found by their keys alone and only they are folded.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    keys = store(base.groupBy("doc_id", "tie").agg(F.count("*").alias("n")), "keys")
    rows = keys.df.count()
    cuts = _cuts(keys.df, rows)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        named = [None if missing else int(i) for i, missing in zip(ids, ids.isna(), strict=True)]
        return pd.Series([bisect.bisect_right(cuts, _place(i, int(t))) for i, t in zip(named, ties, strict=True)], dtype="int32")

    exact = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  # pandas would make doubles of ids beside nulls
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.bitwise_not("doc_id").alias("b"), F.col("tie").alias("c"))
    first = keys.df.withColumn("range", range_of(exact("doc_id"), "tie")).groupBy("range").agg(F.min(F.struct(order.alias("o"), "doc_id", "tie")).alias("x"))
    first = [(r["range"], r.x.doc_id, r.x.tie) for r in first.orderBy("range").collect()]  # a row a range, MAX_RANGES at most
    if not first:
        return spark.createDataFrame([], _RESULT)
    before = [first[-1][0], *(r for r, *_ in first[:-1])]
    heads = spark.createDataFrame([(i, t, goes) for (_, i, t), goes in zip(first, before, strict=True)], "h_id bigint, h_tie bigint, goes int")
    again = keys.df.where("n > 1")
    repeats = again.count()
    if repeats:
        again = broadcast_if_small(again.select(F.col("doc_id").alias("r_id"), F.col("tie").alias("r_tie"), "n"), 24 * repeats)
        same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tie") == F.col("r_tie"))
        folded = base.join(again, same).groupBy("doc_id", "tie").agg(F.min("text").alias("text"), F.first("n").alias("n"))
        base = base.join(again, same, "left_anti").withColumn("n", F.lit(1).cast("bigint")).unionByName(folded)
    else:
        base = base.withColumn("n", F.lit(1).cast("bigint"))
    at_head = base["doc_id"].eqNullSafe(heads["h_id"]) & base["tie"].eqNullSafe(heads["h_tie"])
    rows = base.join(F.broadcast(heads), at_head, "left").withColumn("range", range_of(exact("doc_id"), "tie"))  # 20 bytes a range
    own, ghost = F.struct(F.col("range"), F.lit(False).alias("head")), F.struct(F.col("goes").alias("range"), F.lit(True).alias("head"))
    places = F.explode(F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, ghost)))
    rows = rows.select(places.alias("at"), "doc_id", "tie", "text", "n").select("at.range", "at.head", "doc_id", "tie", "text", "n")
    rows = rows.repartition("range").sortWithinPartitions("range", "head", F.col("doc_id").desc_nulls_last(), "tie")
    return bounded(rows.select("range", "head", "doc_id", "text", "n")).mapInArrow(_compared, _RESULT)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(table(spark, sf_dir, "documents", spread=True))


QUERIES = {"op4_document_fingerprints": op4_document_fingerprints}
ORACLES: dict[str, str] = {}
