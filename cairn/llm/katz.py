"""Katz backoff language model: counts of n-grams, Good-Turing discounts, normalised backoff weights, scores of texts.

A word follows a context h with probability d(c) c(h w) / c(h) where the n-gram was seen in training, and else with
a(h) P(w | h without its first word), down to single words, below which one class stands for every unknown word. Counts up
to LARGEST are discounted by Good and Turing's estimate; a(h) is what the discounts leave, over what the shorter context
gives to words not seen after h, so the probabilities of every context add up to one. A context whose counts are all larger
leaves nothing; one is then added to its total.

Texts are taken apart once, into chunks of CHUNK_BYTES: a stored row with the hashes of its distinct words, 64 bits of xxHash
(of 10 billion words, 2.7 pairs are expected to clash), and its tokens as places among them. Then one round an order k: each
chunk sends its distinct n-grams of k words, as the numbers of their first and last k-1 words, with their occurrences in
training, to buckets; a bucket adds up what the chunks sent, numbers its n-grams and answers each chunk with their counts.
So an n-gram is one entry a chunk however frequent it is. All n-grams of a context go to one bucket, which therefore knows what
the context leaves; contexts of more occurrences than ``Level.hot_above``, of which HOT_CONTEXTS are possible at most, are dealt out
by n-gram instead, and their sums are added up by Spark. In the last round texts are scored beside the answers to their
chunk. The driver sees counts of counts, LARGEST + 4 numbers an order, and the sums of frequent contexts.

Where counts of counts give no estimate between 0 and 1 for a count r, as in small corpora, its discount is 1 - D / r with
D = n1 / (n1 + 2 n2), or none without words that occur once.

Defined cases: null and empty texts are the end alone; without training tokens all that is unknown has probability one,
so scores are 0; a null doc_id is in training; rows stay as they are, repeated rows count each; columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded, slices, utf8
from cairn.session import table
from cairn.storage import store

#: Words of the longest n-gram; the largest count that is discounted; the remainder of crc32(doc_id), modulo FOLDS, of the
#: documents that are not learnt from.
ORDER, LARGEST, FOLDS, APART = 2, 5, 5, 1
#: Bytes of text of a chunk; entries that a bucket is to hold at most.
CHUNK_BYTES, BUCKET_ENTRIES = 16 << 20, 2 << 20
#: Contexts that may be dealt out by n-gram; fewer occurrences are never called frequent.
HOT_CONTEXTS, HOT_FLOOR = 1 << 14, 1 << 16
#: Names and places in a chunk of what stands before a text and behind it.
BEGIN, END = 1, 2

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    h = _turn((seed + _P5 + np.uint64(8)) ^ (_turn(x * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def pair_name(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(first, second)`` of two columns of longs."""
    with np.errstate(over="ignore"):
        return _hash_long(second, _hash_long(first, np.full(len(first), 42, np.uint64)))


class Places(dict):
    """The place of each word among the distinct words of a chunk."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


_WIDTHS = {b"B": np.uint8, b"H": np.uint16, b"I": np.uint32, b"Q": np.uint64, b"d": np.float64}


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, as narrow as their values allow and compressed: whole numbers byte by byte, doubles whole."""
    codes, parts = b"", []
    for x in columns:
        if x.dtype.kind == "f":
            code, raw = b"d", x.tobytes()
        else:
            most = int(x.max()) if len(x) else 0
            code = b"B" if most < 1 << 8 else b"H" if most < 1 << 16 else b"I" if most < 1 << 32 else b"Q"
            narrow = x.astype(_WIDTHS[code])
            raw = narrow.view(np.uint8).reshape(len(x), narrow.itemsize).T.tobytes()
        codes, parts = codes + code, [*parts, raw]
    rows = len(columns[0]).to_bytes(8, "little")
    return rows + bytes([len(codes)]) + codes + pa.Codec("zstd", 1).compress(b"".join(parts), asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    """The columns of ``pack``; whole numbers as uint64."""
    n, k = int.from_bytes(packed[:8], "little"), packed[8]
    types = [np.dtype(_WIDTHS[packed[i : i + 1]]) for i in range(9, 9 + k)]
    raw = pa.Codec("zstd").decompress(packed[9 + k :], n * sum(t.itemsize for t in types), asbytes=True)
    out, at = [], 0
    for t in types:
        part = raw[at : at + n * t.itemsize]
        at += len(part)
        whole = np.frombuffer(part, np.uint8).reshape(t.itemsize, n).T
        out.append(np.frombuffer(part, t) if t.kind == "f" else np.ascontiguousarray(whole).view(t).reshape(n).astype(np.uint64))
    return out


def apart(doc_id: str = "doc_id") -> Column:
    """True for documents that are not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == APART, F.lit(False))


CHUNKS = "chunk bigint, n_words bigint, n_tokens bigint, words binary, tokens binary, sizes binary, apart binary, doc_id array<bigint>"


def chunks(docs: DataFrame) -> DataFrame:
    """Texts in chunks: names of the distinct words, places of the tokens among them, tokens of each text, and who they are."""

    def chunk(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        places, tokens, sizes = Places({None: 0, b"": 1}), [], []  # neither is a word: before and behind a text
        for part in parts:
            for text in utf8(part):
                words = text.lower().split()
                tokens += [np.fromiter(map(places.__getitem__, words), np.uint32, len(words)), np.ones(1, np.uint32)]
                sizes.append(len(words) + 1)
        all_, rows = np.concatenate(tokens), pa.Table.from_batches(parts).combine_chunks()
        names = np.fromiter((xxhash.xxh64_intdigest(w) if w else BEGIN if w is None else END for w in places), np.uint64, len(places))
        columns = [pa.array([x]) for x in (number, len(names), len(all_))]
        columns += [pa.array([pack(x)], pa.binary()) for x in (names, all_, np.array(sizes), rows.column("apart").to_numpy())]
        columns.append(pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, max_bytes=CHUNK_BYTES >> 3):
                n = part.column("text").nbytes
                if held and size + n > CHUNK_BYTES:
                    yield chunk(held, number)
                    number, held, size = number + 1, [], 0
                held, size = [*held, part], size + n
        if held:
            yield chunk(held, number)

    rows = docs.select(apart().alias("apart"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return bounded(rows).mapInArrow(run, CHUNKS)


def discounts(of_count: dict[int, int]) -> list[float]:
    """Good-Turing discounts of the counts 1 to LARGEST; ``of_count``: how many n-grams have each count."""
    n = [0] + [of_count.get(r, 0) for r in range(1, LARGEST + 2)]
    d = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    beyond = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, LARGEST + 1):
        estimate = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond) if n[r] and beyond < 1 else 0.0
        out.append(estimate if 0 < estimate < 1 else 1 - d / r)
    return [max(x, 1e-3) for x in out]  # n1 alone, without n2, would leave single counts nothing


@dataclass
class Level:
    """What is known of all n-grams of one order; ``hot``: (ctx, n-grams of each count up to LARGEST, low) of frequent contexts."""

    buckets: int
    hot_above: int
    discounts: np.ndarray
    tokens: int
    words: int
    of_count: dict[int, int]
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]

    def discounted(self, c: np.ndarray) -> np.ndarray:
        """d(c) c of counts."""
        return c * np.append(self.discounts, 1.0)[np.clip(c, 1, LARGEST + 1).astype(np.int64) - 1]

    def left(self, n: np.ndarray) -> np.ndarray:
        """What the discounts leave of contexts, from their numbers of n-grams of each count."""
        return n @ ((1 - self.discounts) * np.arange(1, LARGEST + 1))


class Texts:
    """One chunk, taken apart to n-grams order by order beside the answers to it."""

    def __init__(self, row: dict, order: int):
        (self.names,), (tokens,), (sizes,), (apart_,) = (unpack(row[c]) for c in ("words", "tokens", "sizes", "apart"))
        self.apart, self.owner = apart_.astype(bool), np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))
        self.at = np.arange(len(tokens)) + (order - 1) * (self.owner + 1)
        #: The n-gram of the present order that ends at each place, how many there are, and that of what stands before a text.
        self.gram = np.zeros(len(tokens) + (order - 1) * len(sizes), np.int64)
        self.gram[self.at] = tokens.astype(np.int64)
        self.n, self.before, self.level = len(self.names), 0, 1
        self.first, self.last = np.zeros(self.n, np.int64), np.arange(self.n)

    def longer(self) -> None:
        """Goes on to the next order."""
        keys = np.append(self.before * self.n + self.before, self.gram[self.at - 1] * self.n + self.gram[self.at])
        distinct, which = np.unique(keys, return_inverse=True)
        self.first, self.last = np.divmod(distinct, self.n)
        self.n, self.before, self.level = len(distinct), int(which[0]), self.level + 1
        self.gram[:] = self.before
        self.gram[self.at] = which[1:]

    def learnt(self) -> np.ndarray:
        """Training occurrences of the n-grams; of what stands before a text, training texts."""
        c = np.bincount(self.gram[self.at], ~self.apart[self.owner], self.n).astype(np.int64)
        c[self.before] = np.count_nonzero(~self.apart)
        return c

    def named(self, id_: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The first and last parts of the n-grams, by the numbers of the order below; of words, nought and their names."""
        return (np.zeros(self.n, np.uint64), self.names) if id_ is None else (id_[self.first], id_[self.last])

    def dealt(self, ctx: np.ndarray, suf: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets and the n-grams that go to each; those of frequent contexts go to the second half."""
        of_word = self.level == 1
        key = np.where(hot, pair_name(ctx, suf), suf if of_word else pair_name(ctx, ctx)) % np.uint64(buckets)
        bucket = key.astype(np.int64) + buckets * hot
        order = np.argsort(bucket, kind="stable")
        found, start = np.unique(bucket[order], return_index=True)
        return zip(found.tolist(), np.split(order, start[1:]), strict=True)


def _answered(texts: Texts, answers: dict, level: Level, below: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, counts and log10 probabilities of the n-grams of a chunk, from the answers of the buckets."""
    id_below, c_below, lp_below = below or (None, np.zeros(1, np.int64), None)
    ctx, suf = texts.named(id_below)
    total = c_below[texts.first]
    hot = total > level.hot_above
    id_, c, mask = (np.zeros(texts.n, np.int64) for _ in range(3))
    n, low = np.zeros((texts.n, LARGEST), np.int64), np.zeros(texts.n)
    for bucket, at in texts.dealt(ctx, suf, hot, level.buckets):
        found, contexts = answers[bucket]
        id_[at], c[at], mask[at] = unpack(found)
        if contexts is not None:
            zero = at[c[at] == 0]
            *counts, sums = unpack(contexts)
            _, which = np.unique(ctx[zero], return_inverse=True)
            n[zero], low[zero] = np.stack(counts, axis=1)[which].astype(np.int64), sums[which]
    if below is None:
        left = level.left(np.array([level.of_count.get(r, 0) for r in range(1, LARGEST + 1)]))
        left, total = (left, level.tokens) if left > 0 else (1.0, level.tokens + 1)
        return id_.astype(np.uint64), c, np.log10(np.where(c > 0, level.discounted(c), left) / total)
    if hot.any():
        at = np.searchsorted(level.hot[0], ctx[hot])
        n[hot], low[hot] = level.hot[1][at], level.hot[2][at]
        mask[hot] = (n[hot] > 0) @ (1 << np.arange(LARGEST))
    none = mask & int((level.discounts < 1) @ (1 << np.arange(LARGEST))) == 0
    total_ = np.maximum(total + none, 1)
    # The unknown class has a share in every context, so "low" is below one but for rounding.
    back = np.log10(np.where(none, 1.0, np.maximum(level.left(n), 1e-300)) / total_ / np.maximum(1 - low, 1e-12))
    seen = np.log10(np.maximum(level.discounted(c), 1e-300) / total_)
    return id_.astype(np.uint64), c, np.where(c > 0, seen, np.where(total > 0, back, 0.0) + lp_below[texts.last])


def _known(row: pa.Table, answers: pa.Table, levels: list[Level], order: int) -> tuple[Texts, tuple | None, np.ndarray]:
    """A chunk after the given levels: its texts, what the last of them says, and the counts of its words."""
    texts, known, words = Texts(row.to_pylist()[0], order), None, None
    by_level: dict[int, dict] = {}
    for a in answers.to_pylist():
        by_level.setdefault(a["level"], {})[a["bucket"]] = (a["found"], a["contexts"])
    for k, level in enumerate(levels, 1):
        if k > 1:
            texts.longer()
        known = _answered(texts, by_level[k], level, known)
        words = known[1] if words is None else words
    return texts, known, words


ENTRIES = "chunk bigint, bucket int, entries binary"
ANSWERS = "chunk bigint, level int, bucket int, found binary, contexts binary, of_count array<bigint>, hot array<struct<ctx: bigint, n: array<bigint>, low: double>>"
_HOT = pa.list_(pa.struct([("ctx", pa.int64()), ("n", pa.list_(pa.int64())), ("low", pa.float64())]))


def _entries(texts: Texts, number: int, known: tuple | None, buckets: int, hot_above: int) -> pa.Table:
    """A chunk's n-grams of the present order for each bucket: (ctx, suf, training occurrences, probability of suf below)."""
    ctx, suf = texts.named(known and known[0])
    hot = known[1][texts.first] > hot_above if known else np.zeros(texts.n, bool)
    p = 10 ** known[2][texts.last] if known else np.zeros(texts.n)
    p[texts.before] = -1.0  # no n-gram of a text, but a context of the next order
    c = texts.learnt()
    rows = [(b, pack(ctx[at], suf[at], c[at], p[at])) for b, at in texts.dealt(ctx, suf, hot, buckets)]
    columns = [pa.array([number] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.binary())]
    return pa.Table.from_arrays(columns, ["chunk", "bucket", "entries"])


def _counted(sent: pa.Table, k: int, buckets: int, top: bool) -> pa.Table:
    """One bucket: the sums of the n-grams that chunks sent, and the answer to each chunk."""
    bucket = sent.column("bucket")[0].as_py()
    parts = [unpack(e) for e in sent.column("entries").to_pylist()]
    cuts = np.cumsum([len(x[0]) for x in parts])[:-1]
    ctx, suf, n, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    if k == 1:
        key = suf
    elif max(ctx.max(), suf.max()) < 1 << 32:
        key = (ctx << np.uint64(32)) | suf
    else:
        (_, i), (kinds, j) = np.unique(ctx, return_inverse=True), np.unique(suf, return_inverse=True)
        key = i * len(kinds) + j
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    c = np.bincount(which, n.astype(np.int64)).astype(np.int64)
    real = p[first] >= 0
    of_count = np.append(np.bincount(np.minimum(c[real], LARGEST + 2), minlength=LARGEST + 3), c[real].sum())
    contexts, of = np.unique(ctx[first], return_inverse=True)
    seen = real & (c > 0)
    counts = np.stack([np.bincount(of[real & (c == r)], minlength=len(contexts)) for r in range(1, LARGEST + 1)], axis=1)
    low = np.bincount(of[seen], p[first][seen], len(contexts))
    mask = (counts > 0) @ (1 << np.arange(LARGEST))
    id_ = np.zeros(len(first), np.int64) if top else np.arange(len(first)) * (2 * buckets) + bucket
    hot, found, back = bucket >= buckets, [], []
    for at in np.split(which, cuts):
        found.append(pack(id_[at], c[at], mask[of[at]]))
        asked = np.unique(of[at[c[at] == 0]])
        back.append(None if hot or k == 1 else pack(*counts[asked].T, low[asked]))
    sums = [{"ctx": h, "n": m, "low": w} for h, m, w in zip(contexts.astype(np.int64).tolist(), counts.tolist(), low.tolist(), strict=True)] if hot else []
    more = len(found) - 1
    columns = [
        sent.column("chunk"), pa.array([k] * len(found), pa.int32()), pa.array([bucket] * len(found), pa.int32()), pa.array(found, pa.binary()), pa.array(back, pa.binary()),
        pa.array([of_count.tolist()] + [None] * more, pa.list_(pa.int64())), pa.array([sums] + [None] * more, _HOT),
    ]
    return pa.Table.from_arrays(columns, ["chunk", "level", "bucket", "found", "contexts", "of_count", "hot"])


class Model:
    """The chunks of a corpus, the answers to them by order, and the numbers that its probabilities need."""

    def __init__(self, docs: DataFrame, order: int = ORDER):
        self.order, self.levels = order, []
        self.chunks, self.answers = store(chunks(docs), "chunks"), []
        size = self.chunks.df.agg(F.sum("n_words"), F.sum("n_tokens"), F.count("*")).first()
        for k in range(1, order + 1):
            entries = (size[0] if k == 1 else size[1] + size[2]) if size[2] else 0
            self._count(k, max(1, -(-entries // BUCKET_ENTRIES)))
        self.tokens, self.words = self.levels[0].tokens, self.levels[0].words

    def told(self) -> DataFrame:
        """The answers of all levels so far."""
        out = self.answers[0].df
        for a in self.answers[1:]:
            out = out.unionByName(a.df)
        return out.select("chunk", "level", "bucket", "found", "contexts")

    def _count(self, k: int, buckets: int) -> None:
        levels, order = list(self.levels), self.order
        hot_above = max(HOT_FLOOR, levels[0].tokens // HOT_CONTEXTS) if levels else 0

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    yield from _entries(Texts(row.to_pylist()[0], order), row.column("chunk")[0].as_py(), None, buckets, 0).to_batches()

        def grams(row: pa.Table, answers: pa.Table) -> pa.Table:
            texts, known, _ = _known(row, answers, levels, order)
            texts.longer()
            return _entries(texts, row.column("chunk")[0].as_py(), known, buckets, hot_above)

        def counted(sent: pa.Table) -> pa.Table:
            return _counted(sent, k, buckets, k == order)

        rows = self.chunks.df
        sent = rows.mapInArrow(words, ENTRIES) if k == 1 else rows.groupBy("chunk").cogroup(self.told().groupBy("chunk")).applyInArrow(grams, ENTRIES)
        answers = store(sent.groupBy("bucket").applyInArrow(counted, ANSWERS), f"level{k}")
        self.answers.append(answers)
        seen = answers.df.select(F.posexplode("of_count").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()  # LARGEST + 4 rows
        n = {r.r: r.n for r in seen}
        tokens, of_count = n.pop(LARGEST + 3, 0), {r: x for r, x in n.items() if r and x}
        sums = answers.df.select(F.explode("hot").alias("h")).groupBy("h.ctx").agg(*(F.sum(F.col("h.n")[i]).alias(f"n{i}") for i in range(LARGEST)), F.sum("h.low").alias("low"))
        hot = sorted(tuple(r) for r in sums.collect())  # HOT_CONTEXTS rows at most
        table_ = (np.array([r[0] for r in hot], np.uint64), np.array([r[1:-1] for r in hot], np.int64).reshape(len(hot), LARGEST), np.array([r[-1] for r in hot]))
        self.levels.append(Level(buckets, hot_above, np.array(discounts(of_count)), tokens, sum(of_count.values()), of_count, table_))

    def remove(self) -> None:
        for stored in [self.chunks, *self.answers]:
            stored.remove()


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of SCORES for each row of ``docs``, which are the model's: they are read from its chunks."""
    levels, order = model.levels, model.order

    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        texts, (_, _, lp), words = _known(row, answers, levels, order)
        tokens, (place,) = levels[0].tokens, unpack(row.column("tokens")[0].as_py())
        c = words[place.astype(np.int64)]
        add = lambda x: np.bincount(texts.owner, x, len(texts.apart))
        base = np.log10((words + 0.5) / (tokens + 0.5 * (levels[0].words + 1)))
        columns = [
            pa.array(row.column("doc_id")[0].as_py(), pa.int64()), pa.array(texts.apart), pa.array(add(None)), pa.array(add(c > 0).astype(np.int64)),
            pa.array(np.full(len(texts.apart), tokens)), pa.array(add(base[place.astype(np.int64)])), pa.array(add(lp[texts.gram[texts.at]])),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")])

    return model.chunks.df.groupBy("chunk").cogroup(model.told().groupBy("chunk")).applyInArrow(run, SCORES)


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return scored(docs, Model(docs))


QUERIES = {"op12_katz": op12_katz}
ORACLES: dict[str, str] = {}
