"""Kernels of near-duplicate text, and the golden counts of a corpus of six triples and six singles."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import dedup as D


def test_normalize_and_shingles():
    assert T.normalize("  Café—RÉSUMÉ_数据  ") == "cafe resume 数据"
    assert T.shingles("a b c d e f a b c d e".split()) == ["a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"]
    assert T.shingles(["x", "y"]) == ["x y"] and T.shingles([]) == []
    assert T.affine_signature([]) == T.blake2b_signature([]) == [0] * 64
    assert abs(T.candidate_probability(0.7) - 0.378122) < 1e-6


def corpus(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows = []
    for topic in range(6):
        words = [word() for _ in range(120)]
        rows += [(f"t{topic}-a", " ".join(words)), (f"t{topic}-b", " ".join(words).upper()), (f"t{topic}-c", " ".join([*words[:-1], word()]))]
    rows += [(f"s{i}", " ".join(word() for _ in range(80))) for i in range(6)]
    return spark.createDataFrame([(i, f"d{i % 4}", t) for i, (_, t) in enumerate(rows)], "doc_id bigint, domain string, text string")


@pytest.mark.parametrize("hash", ["affine", "blake2b"])
def test_golden_corpus(spark, hash):
    prints = T.fingerprints(corpus(spark), hash).cache()
    assert D.exploded_bands(prints).count() == 24 * 8
    pairs = D.candidate_pairs(prints)
    scored = D.scored_pairs(pairs, prints).where("is_duplicate").collect()
    assert len(scored) == 18 and sum(r.shingle_jaccard == 1 for r in scored) == 6
    clusters = D.clusters(prints)
    assert sorted(r["count"] for r in clusters.groupBy("cluster_id").count().collect()) == [1] * 6 + [3] * 6
    chosen = D.representatives(clusters, F.col("doc_id"))
    assert chosen.count() == 12
    summary = D.candidate_summary(prints, pairs).first()
    assert summary.possible_pair_rows == 276
    prints.unpersist()


def test_budget_and_empty_texts(spark):
    same = spark.createDataFrame([(i, "one two three four five six") for i in range(4)] + [(9, ""), (10, None)], "doc_id bigint, text string")
    prints = T.fingerprints(same)
    buckets = D.collision_buckets(D.exploded_bands(prints))
    assert D.guard_budget(buckets) == 48
    with pytest.raises(D.PairBudgetExceeded):
        D.candidate_pairs(prints, budget=10)
    got = {r.doc_id: r.cluster_size for r in D.clusters(prints).collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 4, 9: 1, 10: 1}


def test_scores_tell_reasons(spark):
    prints = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [1] * 64), (2, [1, 2, 3, 4, 5, 6, 7, 8, 9], [1] * 64), (3, [99], [1] * 64)], "doc_id bigint, shingles array<bigint>, signature array<bigint>")
    pairs = spark.createDataFrame([(1, 2, 8), (1, 3, 8)], "left_id bigint, right_id bigint, shared_bands bigint")
    assert {r.right_id: r.reason for r in D.scored_pairs(pairs, prints).collect()} == {2: "jaccard_match", 3: "minhash_only_rejected"}


def test_blake2b_signatures_and_keys_by_a_plain_version(spark):
    import hashlib

    from cairn.functions import text as T

    texts = ["One two, three! four five six seven", "a b", "", None, "Ünïcode wörds ÀND more of them here"]
    rows = T.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "blake2b").collect()
    for r in rows:
        words = T.normalize(texts[r.doc_id] or "").split()
        grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        number = lambda seed, g: int.from_bytes(hashlib.blake2b(f"{seed}:{g}".encode(), digest_size=8).digest(), "little")
        want = [min(number(42 + i, g) for g in grams) for i in range(64)] if grams else [0] * 64
        assert [v % 2**64 for v in r.signature] == want
        keys = [f"{b:03d}:" + hashlib.blake2b((f"{b}:" + ",".join(map(str, want[8 * b : 8 * b + 8]))).encode(), digest_size=8).hexdigest() for b in range(8)]
        assert r.bands == (keys if grams else [])


def test_signatures_and_marks_as_plain_arithmetic(spark):
    from cairn.functions import text as T

    for n in (1, 511, 512, 513, 1100):
        parts = [f"a{i} b c d e" for i in range(n)]
        h = [int(c) >> 32 for c in T.shingle_codes(parts)]
        assert T.affine_signature(parts) == [min((a * x + b) % T.PRIME for x in h) for a, b in T.permutations()]
    assert T.normalize("Été  ậx_İI 1²") == "ete ax ii 1²"
