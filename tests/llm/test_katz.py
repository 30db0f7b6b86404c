"""Katz model: names, discounts, sums of probabilities and whole rows beside a plain version over strings."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import katz
from cairn.session import table


class Plain:
    """The same model over dictionaries of word tuples."""

    def __init__(self, texts, order):
        self.order, self.count = order, [Counter() for _ in range(order)]
        for text in texts:
            words = self.tokens(text)
            for i in range(order - 1, len(words)):
                for k in range(order):
                    self.count[k][tuple(words[i - k : i + 1])] += 1
        self.d = [katz.discounts(Counter(c.values())) for c in self.count]
        self.after = [defaultdict(list) for _ in range(order)]
        for k in range(order):
            for gram in self.count[k]:
                self.after[k][gram[:-1]].append(gram[-1])
        self.back, self.masses = {}, {}

    def tokens(self, text):
        return ["<s>"] * (self.order - 1) + (text or "").encode().lower().split() + ["</s>"]

    def mass(self, k, h):
        if (k, h) not in self.masses:
            self.masses[k, h] = self.summed(k, h)
        return self.masses[k, h]

    def summed(self, k, h):
        total = sum(self.count[k][(*h, w)] for w in self.after[k][h])
        kept = sum(self.kept(k, (*h, w)) for w in self.after[k][h])
        return (total, total - kept) if total - kept > 1e-9 else (total + 1, 1.0)

    def kept(self, k, gram):
        c = self.count[k][gram]
        return c * (self.d[k][c - 1] if c <= katz.LARGEST else 1.0)

    def p(self, h, w):
        """P(w | h); any word not in training stands for the unknown class."""
        k = len(h)
        total, left = self.mass(k, h)
        if self.count[k].get((*h, w)):
            return self.kept(k, (*h, w)) / total
        if k == 0:
            return left / total
        if h not in self.after[k]:
            return self.p(h[1:], w)
        if (k, h) not in self.back:
            self.back[k, h] = left / total / (1 - sum(self.p(h[1:], x) for x in self.after[k][h]))
        return self.back[k, h] * self.p(h[1:], w)

    def score(self, text):
        words = self.tokens(text)
        return sum(math.log10(self.p(tuple(words[i - self.order + 1 : i]), words[i])) for i in range(self.order - 1, len(words)))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_rows(docs, order):
    train = [t for i, t in docs if not held(i)]
    model = Plain(train, order)
    one = model.count[0]
    n, v = sum(one.values()), len(one)
    rows = []
    for doc_id, text in docs:
        words = model.tokens(text)[order - 1 :]
        base = sum(math.log10((one[(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        rows.append((doc_id, held(doc_id), len(words), sum((w,) in one for w in words), n, base, model.score(text)))
    return rows


def same(got, want):
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[6], 4)))
    for g, w in zip(order(got), order(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9), (g, w)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.7)) % 400}" for _ in range(200)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(n)]


def test_names_are_those_of_spark(spark):
    a, b = np.array([0, 1, 2**63, 2**64 - 1, 12345678901234567890], np.uint64), np.array([5, 0, 1, 2**64 - 1, 7], np.uint64)
    frame = spark.createDataFrame(list(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)), "a bigint, b bigint")
    assert [r[0] for r in frame.select(F.xxhash64("a", "b")).collect()] == katz.pair_name(a, b).view(np.int64).tolist()


def test_discounts_of_a_zipfian_corpus_are_good_and_turings():
    n = {1: 1000, 2: 400, 3: 210, 4: 130, 5: 90, 6: 65}
    beyond = 6 * 65 / 1000
    assert katz.discounts(n) == pytest.approx([((r + 1) * n[r + 1] / n[r] / r - beyond) / (1 - beyond) for r in range(1, 6)])


def test_discounts_of_odd_corpora_lie_between_nought_and_one():
    for n in ({}, {1: 5}, {2: 3}, {1: 1, 6: 9}, {1: 4, 2: 4, 3: 4, 4: 4, 5: 4, 6: 4}, {3: 1}):
        assert all(0 < d <= 1 for d in katz.discounts(n))


@pytest.mark.parametrize("order", [2, 3])
def test_plain_probabilities_of_every_context_add_up_to_one(order):
    model = Plain([t for _, t in corpus(80)], order)
    words = [w for (w,) in model.count[0]] + ["never seen"]
    for h in [*model.after[order - 1], ("other",) * (order - 1)]:
        assert sum(model.p(h, w) for w in words) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_same_as_plain_rows_on_odd_tables(spark, order):
    docs = corpus(120) + [(None, "null id w1 W2"), (None, "null id w1 W2"), (3, "w1 w2"), (3, "w2 w1"), (500, None), (501, ""), (502, " \t "), (503, "w1 " * 30_000), (504, "x" * 100_000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("row", F.lit("clash")).withColumn("c", F.lit(1)).withColumn("score", F.lit(2))
    got = katz.scored(frame, katz.Model(frame, order))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), plain_rows(docs, order))


def test_packed_columns_come_back():
    columns = [np.arange(5), np.array([0, 2**64 - 1, 3, 4, 5], np.uint64), np.array([1, 300, 70_000, 2, 2**31]), np.array([True, False, True, True, False]), np.linspace(-1, 1, 5)]
    for n in (5, 1, 0):
        cut = [c[:n] for c in columns]
        assert all(a.tolist() == b.tolist() for a, b in zip(cut, katz.unpack(katz.pack(*cut)), strict=True))


@pytest.mark.parametrize("order", [2, 3])
def test_many_chunks_buckets_and_frequent_contexts_change_nothing(spark, monkeypatch, order):
    docs = corpus(150) + [(None, "null id"), (900, "w1 " * 300), (901, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for name, value in {"CHUNK_BYTES": 900, "BUCKET_ENTRIES": 400, "HOT_FLOOR": 25, "HOT_CONTEXTS": 1 << 14}.items():
        monkeypatch.setattr(katz, name, value)
    model = katz.Model(frame, order)
    assert model.chunks.df.count() > 5 and model.levels[1].buckets > 1 and len(model.levels[1].hot[0]) > 3
    same(katz.scored(frame, model).collect(), plain_rows(docs, order))


def test_shuffles_do_not_hold_a_row_for_each_ngram_of_each_text(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    docs = spark.range(4).select(F.col("id").alias("copy")).coalesce(1).crossJoin(F.broadcast(texts)).drop("copy")
    written = lambda: sum(e.totalShuffleWrite() for e in _seq(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = written()
    for limit in limits:
        spark.conf.set(limit, "-1")  # as on tables whose n-grams are too many to broadcast
    try:
        assert len(katz.scored(docs, katz.Model(docs)).collect()) == 4000
    finally:
        for limit in limits:
            spark.conf.unset(limit)
    assert written() - before < 0.75 * n  # 3.7 times the text before, 0.55 now


def _seq(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_tables_without_training_texts(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert katz.scored(none, katz.Model(none)).collect() == []
    only = [i for i in range(50) if held(i)][:2]
    frame = spark.createDataFrame([(i, "a b") for i in only], "doc_id bigint, text string")
    for r in katz.scored(frame, katz.Model(frame)).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_registered_query_beats_its_base_on_texts_not_learnt_from(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = katz.op12_katz(spark, sf).collect()
    same(got, plain_rows(docs, katz.ORDER))
    held_rows = [r for r in got if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)
