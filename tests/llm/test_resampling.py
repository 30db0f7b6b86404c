"""Importance resampling: CRCs, features, ranks and whole rows beside plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from cairn.llm import resampling


@pytest.mark.parametrize("n", [1, 2, 31, 63, 64, 65, 127, 128, 129, 200, 4096, 4097, 300_001])
def test_crc_of_any_length(n):
    data = np.frombuffer(random.Random(n).randbytes(n), np.uint8)
    assert int(resampling.crcs(data, np.array([0]), np.array([n]))[0]) == zlib.crc32(data.tobytes())


def test_crcs_of_overlapping_spans():
    data = np.frombuffer(random.Random(5).randbytes(5000), np.uint8)
    rng = random.Random(6)
    spans = [(a, a + rng.choice([1, 3, 10, 64, 65, 300])) for a in (rng.randrange(4700) for _ in range(400))]
    found = resampling.crcs(data, *(np.array(x) for x in zip(*spans, strict=True)))
    assert found.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


TEXTS = ["", None, " \n", "one", "One two,two  TWO", "Größe 12 — 日本語 x", "x" * 700, "a" * 65 + " " + "b" * 64, "İ Ÿ é", " ".join(f"w{i % 9}" for i in range(30))]


def test_features_are_those_of_the_pattern():
    bucket, owner = resampling.features([(t or "").encode() for t in TEXTS])
    for i, text in enumerate(TEXTS):
        want = sorted(zlib.crc32(f.encode()) % 10_000 for f in plain_features(text)[1])
        assert sorted(bucket[owner == i].tolist()) == want


def plain_rows(docs, target):
    def counts(texts):
        out = np.zeros(10_000, np.int64)
        for t in texts:
            for f in plain_features(t)[1]:
                out[zlib.crc32(f.encode()) % 10_000] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + 10_000) / ((int(s[b]) + 1) * (int(t.sum()) + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        words, feats = plain_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in rows]


def order(rows):
    return sorted(rows, key=repr)


def test_same_as_plain_rows_on_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANKED_ROWS", 7)  # several ranges
    rng = random.Random(3)
    docs = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(["Alpha", "beta", "γ", "42", "x-y"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(None, "null id " * 15), (None, "null id " * 15), (100, docs[10][1]), (300, "word " * 100_000)]
    target = ["alpha beta beta", None, "γ γ 42"]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("weight", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("_row", F.lit(2))
    got = resampling.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(map(tuple, got.collect())) == order(plain_rows(docs, target))


def test_equal_rows_are_ranked_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANKED_ROWS", 10)
    rows = spark.range(100).select(F.lit(1).alias("score"))
    assert sorted(r.rank for r in resampling.ranked(rows, 100, F.desc("score")).collect()) == list(range(1, 101))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert resampling.resampled(none, some).collect() == []
    assert order(map(tuple, resampling.resampled(some, none).collect())) == order(plain_rows([(1, "a b " * 20)], []))


def test_same_as_sql(spark):
    assert same_rows(spark, resampling.op13_resampling, resampling.ORACLES["op13_resampling"], "/root/testdata/sf0.001") == 200
