"""The pipeline's near-copy stage against brute-force similarity, with planted near copies."""

import random

import numpy as np
import pytest

from test_simhash import brute_fingerprint

from cairn.llm import near_copies
from cairn.llm import pipeline as P

SCHEMA = "doc_id bigint, text string, lang string"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest doc_id of each row's component of links of 0.8 or more, or of fingerprints within two bits."""
    sets, prints = [grams(r[1]) for r in rows], [brute_fingerprint(r[1], 5) for r in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 2:
                part = [part[i] if p == part[j] else p for p in part]
    return {r[0]: min(s[0] for s, q in zip(rows, part, strict=True) if q == p) for r, p in zip(rows, part, strict=True)}


def planted():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=30)
    out = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 30, 100, 100, 300])) + passage
        out.append(base)
        for edits in (1, 2, 3, 4, 8):
            near = list(base)
            for at in rng.sample(range(len(near)), min(edits, len(near))):
                near[at] = "changed"
            out.append(near)
    texts = [" ".join(x) for x in out] + ["", " \t", "one two", "One  two", "one three", *(" ".join(out[0]).upper(),)]
    ids = rng.sample(range(1000), len(texts))
    return [(i, t, "en") for i, t in zip(ids, texts, strict=True)]


def test_stage_drops_a_copy_with_one_changed_word(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words), "en"), (2, " ".join([*words[:50], "other", *words[51:]]), "en"), (3, " ".join(reversed(words)), "en")]
    assert sorted(r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == [1, 3]


@pytest.mark.parametrize("rows,shingles", [(1 << 14, 1 << 22), (3, 1 << 22), (1 << 14, 700)])
def test_components_match_brute_force(spark, rows, shingles):
    data = planted()
    want = brute(data)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(data, SCHEMA), rows=rows, shingles=shingles).collect()}
    assert got == want and 25 < len(set(want.values())) < len(data) - 25


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, copies without a doc_id, and columns named as the operator's own."""
    text = "one two three four five six"
    rows = [(4, text, "a", 1), (4, text, "a", 1), (4, text, "b", 2), (None, text, "c", 3), (9, text.upper(), "d", 4), (None, "alone", "e", 5), (None, "alone", "e", 5), (9, "other words altogether in here", "f", 6)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, key string, `group` int")
    got = sorted(((r.doc_id or -1), r.text, r.key) for r in near_copies.keep_first(frame).collect())
    assert [g[:2] for g in got] == [(-1, "alone"), (4, text), (9, "other words altogether in here")]
    assert near_copies.keep_first(frame).columns == frame.columns


def test_empty_table_and_null_ids(spark):
    frame = spark.createDataFrame([(5, "one two three four", "x"), (3, "one two three four", "y"), (None, None, None), (9, "quite another text here", "z")], SCHEMA)
    assert sorted((r.doc_id or -1) for r in near_copies.keep_first(frame).collect()) == [-1, 3, 9]
    assert near_copies.keep_first(frame.limit(0)).count() == 0


def test_group_grown_by_shared_passages_is_parted_anew(spark):
    """A chain of texts, each sharing a passage with the next: one rough group, in which two texts alone are near."""
    words = lambda name, n: [f"{name}-{i}" for i in range(n)]
    texts = [[*words(f"p{i}", 60), *words(f"own{i}", 200), *words(f"p{i + 1}", 60)] for i in range(40)]
    texts.append([*texts[7][:300], "changed", *texts[7][301:]])
    sets = [near_copies.shingle_set(" ".join(t).encode()) for t in texts]
    rows = spark.createDataFrame([(1, k, x.view(np.int64).tolist()) for k, x in enumerate(sets)], "component bigint, code bigint, found array<bigint>")
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prints = spark.createDataFrame([(k, len(x), near_copies.prefix(x, *none).view(np.int64).tolist()) for k, x in enumerate(sets)], "code bigint, n bigint, prefix array<bigint>")
    assert {(r.node, r.component) for r in near_copies._rough(prints, 80).collect()} == {(k, 0) for k in range(41)}
    again = near_copies.parted(rows, spark.createDataFrame([(1,)], "component bigint"), none).df.collect()
    assert {(r.component, r.code) for r in again} == {(7, 7), (7, 40)}


def test_later_prefix_meets_whatever_is_near():
    rng = np.random.default_rng(5)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for n in (1, 2, 5, 6, 30, 200):
        a = np.unique(rng.integers(0, 1 << 62, n, np.uint64))
        b = np.unique(np.concatenate((a[n // 10 :], rng.integers(0, 1 << 62, n // 10, np.uint64))))
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.8:
            continue
        first = [near_copies.later_prefix(x, int(np.sum(np.setdiff1d(x, y) % np.uint64(2) == 0)), *none) for x, y in ((a, b), (b, a))]
        assert len(np.intersect1d(*first))
