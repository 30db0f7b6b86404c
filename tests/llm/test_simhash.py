"""Fingerprints, links and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash

SCHEMA = "doc_id bigint, text string, component_id string, fp double"


def brute_fingerprint(text, shingle=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def texts():
    rng = random.Random(3)
    words = ["Alpha", "beta", "gämma", "delta\tx", "ÉPSILON", "zeta", "eta", "theta\n"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 80]))) for _ in range(60)]
    near = [t + " tail" for t in base[:30]]
    return [*base, *near, *base[:10], "", "  \t", None, "a", "A", "x " * 30000]


def test_fingerprint_matches_brute_force():
    for t in texts():
        assert simhash.fingerprint((t or "").encode()) % 2**64 == brute_fingerprint(t)


@pytest.mark.parametrize("shard,task", [(2048, 16384), (4, 3)])
def test_components_match_brute_force(spark, shard, task):
    rows = [(i * 7 % 1009, t, "x", 0.0) for i, t in enumerate(texts())]
    got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), shard=shard, task=task).collect()}
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = set(zip([r[0] for r in rows], prints, brute_components([r[0] for r in rows], prints), strict=True))
    assert got == want


@pytest.mark.parametrize("shard,task", [(64, 16384), (64, 40)])
def test_links_find_all_pairs_of_a_dense_ball(spark, shard, task):
    """A family of near copies within a small ball, among random points: no tree can part it."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    ball = {centre ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for _ in range(400)}
    points = list(ball | {int(x) for x in rng.integers(0, 2**63, 300)})
    frame = spark.createDataFrame([(p,) for p in points], "fp bigint")
    edges = [(r.a, r.b) for r in simhash.links(spark, frame, len(points), 2, shard, task).collect()]
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in edges:
        parent[find(a)] = find(b)
    want = brute_components(points, points)
    assert len({(find(p), w) for p, w in zip(points, want, strict=True)}) == len({find(p) for p in points}) == len(set(want))


def test_keep_first_and_empty_table(spark):
    frame = spark.createDataFrame([(5, "one two three four", "x", 0.0), (3, "one two three four", "y", 1.0), (None, None, None, None), (9, "quite another text here", "z", 2.0)], SCHEMA)
    assert sorted((r.doc_id or -1) for r in simhash.keep_first(frame).collect()) == [-1, 3, 9]
    clash = frame.withColumnsRenamed({"component_id": "gone", "fp": "key"}).unionByName(spark.createDataFrame([(3, "one two three four", "y", 1.0)], "doc_id bigint, text string, gone string, key double"))
    assert sorted(((r.doc_id or -1), r.gone) for r in simhash.keep_first(clash).collect() if r.doc_id) == [(3, "y"), (9, "z")]
    twice = frame.unionByName(spark.createDataFrame([(5, "a text of its own that nothing else is like", "x", 0.0)], SCHEMA))
    assert sorted((r.doc_id or -1) for r in simhash.keep_first(twice).collect()) == [-1, 3, 5, 9]
    assert simhash.near_duplicates(spark, frame.limit(0)).count() == 0
    assert simhash.keep_first(frame.limit(0)).columns == frame.columns
