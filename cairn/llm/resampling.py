"""Importance resampling towards a target distribution over hashed n-grams.

A feature is a run of one or two words; its bucket is the CRC-32 of its bytes modulo BUCKETS. CRC-32 is affine over
bits: the CRC of a string is the exclusive or of one contribution for each of its bytes, which depends on the byte and
on its distance from the end alone, and of a constant for the string's length. The contributions of BLOCK distances are
tabulated once; all features of a batch are then looked up together and folded span by span with
``bitwise_xor.reduceat``. A span longer than BLOCK is folded block by block: the value of what lies before is moved on by
BLOCK bytes, which is linear too, and the next block's contributions are added.

A bucket's gain is the floored thousandfold logarithm of its smoothed share of the target's features over its share of
the corpus'. A document's weight is the floored mean of its features' gains, its score the weight plus Gumbel noise of its
doc_id, so that the highest scores are a sample without replacement, in proportion to the exponentials of the weights.

Both counts are BUCKETS numbers, whatever the size of the tables: partial counts of each task are added up by Spark, and
the gains (80 kB) go to every task. Ranks are those of a range partitioning, whose last key is a row number: neither
repeated rows nor equal scores meet in one task.

Defined cases: null and empty texts, and those without words, have no features, weight 0 and are not drawn; a null
doc_id is written as an empty string in the noise and comes last among equal scores; rows stay as they are and are
ranked each on its own (equal rows in any order, which cannot be told apart); with an empty target or corpus its counts
are nought and the smoothing alone remains; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import bounded, slices, utf8
from cairn.session import table
from cairn.storage import store

#: Buckets of features; words that a document must have to be drawn; share that is drawn, in hundredths; seed.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Distances from a span's end that are tabulated.
BLOCK = 64
#: Rows that one task ranks, about.
RANKED_ROWS = 1 << 20

_POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed
_SPACE = 0x20


def _byte_steps() -> np.ndarray:
    """What shifting eight bits out of the register adds, by the bits shifted out."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(_POLYNOMIAL), steps >> 1).astype(np.uint32)
    return steps


_STEPS = _byte_steps()


def _past(register: np.ndarray, n: int = 1) -> np.ndarray:
    """Registers after ``n`` bytes of nought."""
    for _ in range(n):
        register = (register >> np.uint32(8)) ^ _STEPS[register & np.uint32(255)]
    return register


def _contributions() -> np.ndarray:
    """BLOCK x 256: what a byte adds to the register, by its distance from the end."""
    rows = [_STEPS]
    for _ in range(BLOCK - 1):
        rows.append(_past(rows[-1]))
    return np.stack(rows)


_BY_DISTANCE = _contributions()
#: What each byte of a register becomes BLOCK bytes of nought later: four tables.
_BLOCK_ON = [_past(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), BLOCK) for k in range(4)]


def _block_on(register: int) -> int:
    """A register after BLOCK bytes of nought."""
    out = 0
    for k in range(4):
        out ^= int(_BLOCK_ON[k][register >> 8 * k & 255])
    return out


@functools.lru_cache(maxsize=4096)
def _length_constant(n: int) -> int:
    """The CRC of ``n`` bytes of nought, which each length adds: the register starts and ends inverted."""
    register = 0xFFFFFFFF
    for _ in range(n // BLOCK):
        register = _block_on(register)
    return int(_past(np.array([register], np.uint32), n % BLOCK)[0]) ^ 0xFFFFFFFF


_SHORT_CONSTANTS = np.array([_length_constant(n) for n in range(BLOCK + 1)], np.uint32)


def _long_crc(span: np.ndarray) -> int:
    """The CRC of a span of more than BLOCK bytes: a first part, then whole blocks."""
    first = len(span) % BLOCK
    register = int(np.bitwise_xor.reduce(_BY_DISTANCE[np.arange(first)[::-1], span[:first]])) if first else 0
    blocks = span[first:].reshape(-1, BLOCK)
    at = np.arange(BLOCK)[::-1]
    for some in np.array_split(blocks, max(1, len(blocks) // 4096)):
        for added in np.bitwise_xor.reduce(_BY_DISTANCE[at, some], axis=1).tolist():
            register = _block_on(register) ^ added
    return register ^ _length_constant(len(span))


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans ``data[start:end]``, which may overlap; none is empty."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    short = np.flatnonzero(size <= BLOCK)
    if len(short):
        n = size[short]
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        parts = _BY_DISTANCE[np.repeat(n, n) - 1 - within, data[np.repeat(start[short], n) + within]]
        out[short] = np.bitwise_xor.reduceat(parts, first) ^ _SHORT_CONSTANTS[n]
    for i in np.flatnonzero(size > BLOCK):
        out[i] = _long_crc(data[start[i] : end[i]])
    return out


#: Bytes that make up words, after A-Z are lower-cased: digits, a-z and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features' buckets and the numbers of the texts that they are of."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    word = _WORD[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_end, start, side="right")
    # The words again, one space after each, so that a run of two is a span of bytes.
    size = end - start
    new_start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    packed = np.full(int((size + 1).sum()), _SPACE, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    packed[np.repeat(new_start, size) + within] = data[word]
    new_end = new_start + size
    two = np.flatnonzero(owner[1:] == owner[:-1])
    found = crcs(packed, np.concatenate((new_start, new_start[two])), np.concatenate((new_end, new_end[two + 1])))
    return found.astype(np.int64) % BUCKETS, np.concatenate((owner, owner[two]))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(features(utf8(part))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    partial = bounded(texts.select("text")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    up, down = (target + 1).astype(np.float64), (corpus + 1).astype(np.float64)
    ratio = (up * float(corpus.sum() + BUCKETS)) / (down * float(target.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bucket, owner = features(utf8(part))
                n = np.bincount(owner, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, owner, gains[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_features", "weight"])

    return bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint")


def noisy(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """The weight plus Gumbel noise, in thousandths, drawn from the seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, n_rows: int, *order: Column) -> DataFrame:
    """``rows`` with their place (1, 2, 3 ...) in ``order`` as ``rank``; no task holds more than a range of them.

    Ranges are written with the number of their partition; places are those within a range plus the rows of the ranges
    before it, of which there is one for each RANKED_ROWS.
    """
    n = max(1, min(n_rows // RANKED_ROWS + 1, 1 << 16))
    apart = rows.withColumn("_row", F.monotonically_increasing_id())
    # Chosen by the order first and by row number last, ranges split even where all rows are equal.
    ranges = store(apart.repartitionByRange(n, *order, F.col("_row").asc()).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.df.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # n rows
    placed = ranges.df.withColumn("rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_row")))
    return placed.join(F.broadcast(before), "_range").withColumn("rank", F.col("rank") + F.col("_before")).drop("_row", "_range", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is null where a row is not drawn."""
    gains = bucket_gains(bucket_counts(target), bucket_counts(docs))
    rows = store(weighed(docs, gains).withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)), "weights")
    enough = 2 * least_words - 1  # features of a document of so many words
    able = rows.df.where(F.col("n_features") >= enough)
    n = able.count()
    places = ranked(able, n, F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank")).cast("bigint")
    rest = rows.df.where(F.col("n_features") < enough).withColumn("rank", F.lit(None).cast("bigint"))
    return places.withColumn("rank", drawn).unionByName(rest)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


#: CRC-32 of each distinct feature by the usual table, byte by byte; the rest as the definition reads.
_SQL = r"""
with recursive bits(b, k, v) as (
  select range, 0, range::bigint from range(256)
  union all
  select b, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
steps as (select list(v order by b) t from bits where k = 8),
texts as (
  select 0 kind, row_number() over () id, doc_id, coalesce(text, '') x from documents
  union all select 1, row_number() over (), null, coalesce(text, '') from benchmark),
words as (
  select kind, id, doc_id, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from texts),
feats as (
  select kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from words),
per as (select kind, id, f, count(*) n from feats group by all),
names as (select f, hex(encode(f)) hx from (select distinct f from per)),
crcs as (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(hx) + 1, 2), lambda i: ('0x' || substr(hx, i, 2))::bigint)),
    lambda a, c: xor(t[(xor(a, c) & 255) + 1], a >> 8)), 4294967295) % 10000 b
  from names, steps),
counts as (
  select b, sum(n) filter (where kind = 0) s, sum(n) filter (where kind = 1) t from per join crcs using (f) group by b),
totals as (select coalesce(sum(s), 0) ss, coalesce(sum(t), 0) tt from counts),
gains as (
  select b, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (ss + 10000)::double) / ((coalesce(s, 0) + 1)::double * (tt + 10000)::double)))::bigint g
  from counts, totals),
sums as (
  select id, sum(n) n, sum(n * g) g from per join crcs using (f) join gains using (b) where kind = 0 group by id),
scored as (
  select doc_id, coalesce(n, 0)::bigint n_features,
    case when coalesce(n, 0) = 0 then 0 else floor(g::double / n)::bigint end weight,
    (('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296 u
  from words left join sums using (id) where kind = 0),
final as (select doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln(u::double))))::bigint score from scored),
able as (
  select doc_id, row_number() over (order by score desc, doc_id) r, count(*) over () n from final where n_features >= 39)
select doc_id, n_features, weight, score, r rank
from final left join (select doc_id, r from able where r <= 25 * n // 100) using (doc_id)
"""

QUERIES = {"op13_resampling": op13_resampling}
ORACLES = {"op13_resampling": _SQL}
