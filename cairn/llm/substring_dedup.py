"""Substring dedup: windows of SPAN words that an earlier document also has are removed.

1. Anchors. Every window is stood for by the smallest of the hashes of its shorter grams (GRAM words), which equal
   windows share wherever they are. A document's distinct anchors are some 1/14 of its windows.
2. Count-min prefilter. Each partition adds its documents' anchors into a sketch, kept sparse and cut into shards by
   hash; the shards' counts are merged by addition. A shard has DEPTH rows of counters, four an anchor or more in
   each. An anchor's estimate is never below the number of its documents, and every document with a window has the
   window's anchor, so it is never below the number of documents of any window it stands for: the sketch
   overestimates window counts, and a window in two documents is always estimated at two or more (the tests hold
   estimates against exact window counts; README has the cost of a sketch of single windows). The shards keep one bit a counter: whether it reached two. They are broadcast if they are small, else
   shuffled to the anchors; either way an anchor meets the shard of its hash.
3. Exact grouping. Only windows whose anchor is estimated as repeated are grouped, by 128-bit hashes of their words:
   first whole runs of windows with one anchor, then, window by window, what differs between such runs. The smallest
   doc_id of each group is found by partial aggregation and joined to the occurrences in other documents. These
   joins are plain exchanges on both sides, which adaptive execution splits where a passage stands in a large part of
   the corpus.
4. The covered words of each document are removed.

Defined cases: null and empty texts have no words; fewer than SPAN words make no window; of rows that share a doc_id
none is earlier than another, and each row is judged by its own words (a row's key is its doc_id and the hash of its text); rows without a doc_id are earlier than
nothing and keep all words; repeats within one document stay. Other columns pass through ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded, fresh, slices, utf8
from cairn.session import table
from cairn.storage import Stored, broadcast_if_small, store

#: Words of a window, and of the grams whose smallest hash stands for it.
SPAN, GRAM = 50, 25
#: Rows of counters of the sketch, and the anchors that a shard is planned for, with four counters an anchor and row.
DEPTH, SHARD_ANCHORS = 5, 1 << 14
#: Anchors that one partial sketch adds up.
PARTIAL_ANCHORS = 1 << 19
_COUNTERS = 4 * SHARD_ANCHORS

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    of = xxhash.xxh3_64_intdigest
    return np.fromiter(map(of, words), np.uint64, len(words))


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive values, by doubling: runs of 2k are made of two runs of k."""
    out, size, done = None, 1, 0
    run = h
    while n:
        if n & 1:
            out = run[: len(run)] if out is None else _mix(out[: len(h) - done - size + 1] * _ODD + run[done : len(h) - size + 1])
            done += size
        n >>= 1
        if n:
            if len(run) <= size:
                return np.zeros(0, np.uint64)
            run = _mix(run[:-size] * _ODD + run[size:])
            size *= 2
    return out if out is not None else np.zeros(0, np.uint64)


def window_anchors(h: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window of ``span`` words, from the words' hashes."""
    if len(h) < span:
        return np.zeros(0, np.uint64)
    least, width, want = _rolling(h, gram), 1, span - gram + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = want - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def anchors(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, anchors array<bigint>): the distinct anchors of each document with a doc_id and a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = [np.unique(window_anchors(word_hashes(x.split()), span, gram)).view(np.int64) for x in utf8(part)]
                found = pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(own, pa.int64())], ["doc_id", "anchors"])
                yield found.filter(pa.array([len(x) > 0 for x in own]))

    return bounded(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")).mapInArrow(run, "doc_id bigint, anchors array<bigint>")


# --- the sketch --------------------------------------------------------------------------------------------------


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    step = np.uint64((row + 1) * int(_ODD) & (1 << 64) - 1)
    return (_mix(h + step) % np.uint64(_COUNTERS)).astype(np.int64)


def _shard_of(h: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(shards))


def partial_sketches(found: DataFrame, shards: int) -> DataFrame:
    """(shard, cells binary): the counters that a partition's anchors touch, as (row, counter) codes, twice if twice or more."""

    def touched(parts: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(parts)
        shard = ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        h, shard = h[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        names, cells = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            codes, n = np.unique(np.concatenate([_cells(h[a:b], r) + r * _COUNTERS for r in range(DEPTH)]), return_counts=True)
            names.append(int(shard[a]))
            cells.append(np.sort(np.concatenate((codes, codes[n > 1]))).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(cells, pa.binary())], ["shard", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("anchors").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= PARTIAL_ANCHORS:
                yield touched(held)
                held, n = [], 0
        if n:
            yield touched(held)

    return found.select("anchors").mapInArrow(run, "shard bigint, cells binary")


def _merge(data: pa.Table) -> pa.Table:
    """One shard's counters summed, kept as bits: which reached two."""
    counts = np.zeros(DEPTH * _COUNTERS, np.int32)
    for cells in data.column("cells"):
        counts += np.bincount(np.frombuffer(cells.as_buffer(), np.uint32), minlength=len(counts)).astype(np.int32)
    bits = np.packbits(counts >= 2, bitorder="little").tobytes()
    return pa.table({"shard": data.column("shard")[:1], "bits": pa.array([bits], pa.binary())})


def repeated_anchors(found: Stored, n_anchors: int) -> DataFrame:
    """(doc_id, hot array<bigint>): each document's anchors that the merged sketch estimates in two documents or more."""
    shards = 1
    while shards * SHARD_ANCHORS < n_anchors:
        shards *= 2
    partial = store(partial_sketches(found.df, shards), "sketch-parts")
    merged = store(partial.df.groupBy("shard").applyInArrow(_merge, "shard bigint, bits binary"), "sketch")
    partial.remove()
    return _estimated(found.df, merged, shards)


def _estimated(found: DataFrame, merged: Stored, shards: int) -> DataFrame:
    size = shards * DEPTH * _COUNTERS // 8
    parts = found.select("doc_id", F.explode("anchors").alias("h")).withColumn("shard", _shard_of(F.col("h"), shards))
    if shards > 1 and size > SKETCH_BROADCAST:
        counts = parts.groupBy("shard").agg((F.count("*") / SALT_ROWS + 1).cast("int").alias("salts"))
        parts = parts.join(broadcast_if_small(counts, 16 * shards), "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
        parts = parts.groupBy("shard", "salt").agg(F.collect_list(F.struct("doc_id", "h")).alias("own"))
        joined = parts.join(merged.df, "shard").select("own", "bits")
        hits = joined.mapInArrow(_test_lists, "doc_id bigint, h bigint")
        return hits.groupBy("doc_id").agg(F.collect_list("h").alias("hot"))
    width = DEPTH * _COUNTERS // 8
    whole = bytearray(shards * width)
    for r in merged.df.toLocalIterator():
        whole[r.shard * width : (r.shard + 1) * width] = r.bits
    shared = found.sparkSession.sparkContext.broadcast(bytes(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            lists = batch.column("anchors")
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            shard = ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            hot = _test(bits, h, shard * width)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())[hot]
            n = np.bincount(owner, minlength=batch.num_rows)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(h[hot].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "hot"]).filter(pa.array(n > 0))

    return found.mapInArrow(run, "doc_id bigint, hot array<bigint>")


#: The merged sketch is broadcast up to this size; beyond it, it is joined to the anchors by shard, about SALT_ROWS of
#: them at a time, so that an anchor which a third of all documents hold is met in as many tasks as its rows need.
SKETCH_BROADCAST, SALT_ROWS = 48 << 20, 1 << 16


def _test(bits: np.ndarray, h: np.ndarray, at: np.ndarray | int = 0) -> np.ndarray:
    """Whether all counters of each anchor reached two; ``at`` is where its shard begins."""
    out = np.ones(len(h), bool)
    for r in range(DEPTH):
        cell = _cells(h, r) + r * _COUNTERS
        out &= (bits[at + (cell >> 3)] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _test_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, bits in zip(batch.column("own"), batch.column("bits"), strict=True):
            rows = own.values
            h = rows.field("h").to_numpy().view(np.uint64)
            hot = pa.array(_test(np.frombuffer(bits.as_buffer(), np.uint8), h))
            yield pa.RecordBatch.from_arrays([rows.field("doc_id").filter(hot), rows.field("h").filter(hot)], ["doc_id", "h"])


# --- exact grouping ----------------------------------------------------------------------------------------------


def _edges(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by spaces, and where each begins; one place more for the end and its space."""
    return b" ".join(words), np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))


def _digests(joined: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    of = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([of(joined[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _blocks(span: int, gram: int):
    """Runs of windows that share an anchor estimated as repeated: (anchor, h1, h2, doc_id, key, start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc_id, key, text, hot in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), utf8(part), part.column("hot"), strict=True):
                    words = text.split()
                    anchor = window_anchors(word_hashes(words), span, gram)
                    if not len(anchor):
                        continue
                    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                    n = np.diff(np.concatenate((first, [len(anchor)])))
                    keep = np.isin(anchor[first], hot.values.to_numpy().view(np.uint64))
                    first, n = first[keep], n[keep]
                    if len(first):
                        joined, edges = _edges(words)
                        h = _digests(joined, edges[first], edges[first + n - 1 + span] - 1)
                        out.append((anchor[first].view(np.int64), h[:, 0], h[:, 1], np.full(len(first), doc_id, np.int64), np.full(len(first), key, np.int64), first.astype(np.int32), n.astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["anchor", "h1", "h2", "doc_id", "key", "start", "n"])

    return run


def _windows(span: int):
    """The windows of the given runs: (w1, w2, doc_id, key, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 18):
                out = []
                for doc_id, key, text, runs in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), utf8(part), part.column("runs"), strict=True):
                    rows = runs.values
                    first, n = rows.field("start").to_numpy(), rows.field("n").to_numpy()
                    starts = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    joined, edges = _edges(text.split())
                    w = _digests(joined, edges[starts], edges[starts + span] - 1)
                    out.append((w[:, 0], w[:, 1], np.full(len(starts), doc_id, np.int64), np.full(len(starts), key, np.int64), starts.astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["w1", "w2", "doc_id", "key", "start"])

    return run


def _per_document(rows: DataFrame, name: str) -> Stored:
    return store(rows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs")), name)


def _size(runs: Stored) -> int:
    return runs.df.agg(F.sum(32 + 8 * F.size("runs"))).first()[0] or 0


def _beside(docs: DataFrame, runs: Stored, how: str) -> tuple[DataFrame, str]:
    """``docs`` joined to the runs of each row, as the last column, and that column's name, which no other has."""
    of, key, name = fresh(docs, "__of", "__key", "__runs")
    named = broadcast_if_small(runs.df.select(F.col("doc_id").alias(of), F.col("key").alias(key), F.col("runs").alias(name)), _size(runs))
    joined = docs.join(named, (docs["doc_id"] == named[of]) & (F.xxhash64(docs["text"]) == named[key]), how)
    return joined.drop(named[of], named[key]), name


def repeated_runs(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> Stored:
    """(doc_id, key, runs array<struct<start, n>>): runs of windows that a document with a smaller doc_id also has.

    Runs of windows that share an anchor are grouped first, by the hash of all their words: where an earlier document
    has the same run, all its windows are repeated. What is left to compare window by window are the first
    occurrences of different runs with the same anchor, such as the ends of a shared passage.
    """
    found = store(anchors(docs, span, gram), "anchors")
    total = found.df.agg(F.sum(F.size("anchors"))).first()[0] or 0
    hot = store(repeated_anchors(found, total), "repeated")
    found.remove()
    size = hot.df.agg(F.sum(16 + 8 * F.size("hot"))).first()[0] or 0
    few = hot.df.groupBy("doc_id").agg(F.flatten(F.collect_list("hot")).alias("hot"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    blocks = store(texts.join(broadcast_if_small(few, size), "doc_id").mapInArrow(_blocks(span, gram), "anchor bigint, h1 bigint, h2 bigint, doc_id bigint, key bigint, start int, n int"), "blocks")
    same = store(blocks.df.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "same")
    mixed = store(same.df.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("mixed")), "mixed")
    kinds = store(same.df.join(mixed.df, "anchor", "left").where("mixed or first < last").select("anchor", "h1", "h2", "first", F.coalesce("mixed", F.lit(False)).alias("mixed")), "kinds")
    judged = store(blocks.df.join(kinds.df, ["anchor", "h1", "h2"]).where("doc_id > first or mixed").select("doc_id", "key", "start", "n", F.expr("doc_id > first").alias("gone")), "judged")
    for old in (hot, blocks, same, mixed, kinds):
        old.remove()
    open_ = _per_document(judged.df.where("not gone"), "open")
    rest, name = _beside(texts, open_, "inner")
    rest = rest.select("doc_id", "key", "text", F.col(name).alias("runs"))
    windows = store(rest.mapInArrow(_windows(span), "w1 bigint, w2 bigint, doc_id bigint, key bigint, start int"), "windows")
    least = windows.df.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    least = store(least.select("w1", "w2", "first"), "firsts")
    later = windows.df.join(least.df, ["w1", "w2"]).where("doc_id > first").select("doc_id", "key", "start", F.lit(1).alias("n"))
    runs = _per_document(judged.df.where("gone").select("doc_id", "key", "start", "n").unionByName(later), "runs")
    for old in (judged, open_, windows, least):
        old.remove()
    return runs


def covered(n_words: int, first: np.ndarray, n: np.ndarray, span: int) -> np.ndarray:
    """Which of ``n_words`` words are in one of the ``n`` windows from ``first`` on."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n - 1 + span, -1)
    return np.cumsum(edge[:n_words]) > 0


def _kept(words: list[bytes], runs: pa.Scalar, span: int) -> tuple[list[bytes], int]:
    if not runs.is_valid:
        return words, 0
    rows = runs.values
    gone = covered(len(words), rows.field("start").to_numpy(), rows.field("n").to_numpy(), span)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def digests(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, removed, kept = [], [], []
                for text, runs in zip(utf8(part), part.column(name), strict=True):
                    own = text.split()
                    rest, n = _kept(own, runs, span)
                    words.append(len(own)), removed.append(n), kept.append(hashlib.sha256(b" ".join(rest)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select("doc_id", "text")
    joined, name = _beside(rows, repeated_runs(rows, span, gram), "left")
    return bounded(joined).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``: the words kept, joined by one space, where any went."""
    joined, name = _beside(docs, repeated_runs(docs, span, gram), "left")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = []
                for text, runs in zip(part.column("text"), part.column(name), strict=True):
                    if runs.is_valid:
                        rest, n = _kept((text.as_py() or "").encode().split(), runs, span)
                        texts.append(b" ".join(rest).decode() if n else text.as_py())
                    else:
                        texts.append(text.as_py())
                columns = part.columns[:-1]
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return bounded(joined).mapInArrow(run, docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", spread=True))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
