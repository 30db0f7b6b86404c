"""Kernels against plain definitions, the pairing of documents against brute force, and likeness."""

import hashlib
import random
import statistics

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import digest as D


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=20, max_size=400), st.sampled_from([8, 16, 64]))
def test_equal_pairs(data, width):
    if len(data) < width:
        return
    want = []
    for i in range(len(data) - width + 1):
        counts = np.bincount(np.frombuffer(data[i : i + width], np.uint8))
        want.append(int((counts * (counts - 1) // 2).sum()))
    assert D.equal_pairs(np.frombuffer(data, np.uint8), width).tolist() == want


def test_digests_do_not_depend_on_their_company():
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abcdefgh ijk", k=n)) for n in (0, 1, 8, 9, 16, 17, 63, 64, 65, 120, 300, 1023, 1024, 1025, 5000, 70_000)] + [b"a" * 500, b"ab" * 3000]
    assert D.digest_all(texts) == [D.digest(t) for t in texts] == D.digest_all(texts[::-1])[::-1]
    for t in texts:
        assert D.likeness(D.digest(t), D.digest(t)) == 1.0
    assert D.likeness(b"", D.digest(b"x")) == 0.0 and D.likeness(b"", b"") == 1.0


def words(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(8)
    texts = [words(rng, rng.choice([40, 100, 400, 2000])) for _ in range(120)]
    near = [D.likeness(D.digest(a.encode()), D.digest(D.edited(a, b).encode())) for a, b in zip(texts, texts[1:])]
    far = [D.likeness(D.digest(a.encode()), D.digest(b.encode())) for a, b in zip(texts, texts[1:])]
    assert min(near) > max(far) and statistics.median(near) > 0.45 and statistics.median(far) < 0.05


@pytest.mark.parametrize("range_rows", [1000, 7])
def test_beside_next(spark, monkeypatch, range_rows):
    monkeypatch.setattr(D, "RANGE_ROWS", range_rows)
    rng = random.Random(6)
    rows = [(i * 13 % 997, words(rng, rng.randint(0, 60)) + rng.choice(["é", "日本", ""]), "x") for i in range(90)] + [(5000, None, "y"), (5001, "", "y"), (None, "no id", "z")]
    got = {r.doc_id: r for r in D.beside_next(spark.createDataFrame(rows, "doc_id bigint, text string, tie string").repartition(5)).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [rows[-1]]
    assert len(got) == len(rows)
    for (d, text, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        changed = text[: len(text) - k] + after[:k]
        own, new, other = (D.digest(x.encode()) for x in (text, changed, after))
        assert tuple(got[d]) == (d, len(text), hashlib.sha256(changed.encode()).hexdigest(), D.printable(own), D.printable(new), D.likeness(own, new), D.likeness(own, other))


def test_ties_single_and_empty(spark):
    schema = "doc_id bigint, text string"
    frame = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, "b" * 90)], schema)
    assert sorted(r.doc_id for r in D.beside_next(frame).collect()) == [1, 1, 2]
    assert D.beside_next(frame.limit(0)).count() == 0
    (only,) = D.beside_next(spark.createDataFrame([(7, "abcdef")], schema)).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and only.near_next == 1.0
    assert D.digests(frame).columns == ["doc_id", "text", "digest"]
    assert dict(D.digests(frame.selectExpr("*", "1 as digest")).dtypes)["digest"] == "binary"


@pytest.mark.parametrize("range_rows", [1000, 3])
def test_rows_without_ids_and_equal_rows(spark, monkeypatch, range_rows):
    """Many rows of no id, of one id, and many equal rows: each has the next of the whole order."""
    monkeypatch.setattr(D, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(D, "REPEATS", 4)
    rows = [(None, f"text number {i} of none") for i in range(20)] + [(7, f"text number {i} of seven") for i in range(20)] + [(5, "equal")] * 11 + [(None, None)] * 3 + [(9, None), (-(2**63), "least"), (2**63 - 1, "most")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    ties = {(r.doc_id, r.text): r.t for r in frame.selectExpr("doc_id", "text", "xxhash64(text) as t").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r]))
    want = []
    for (d, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        k = len(a) // 3
        want.append((str(d), len(a), hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest(), D.likeness(D.digest(a.encode()), D.digest(b.encode()))))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.near_next) for r in D.beside_next(frame).collect()]
    assert sorted(got) == sorted(want)


def plain_features(text, kind):
    """The windows that are the rarest, leftmost among equals, of enough of the neighbourhoods they lie in."""
    width, neighbours, popular, typical, spread, plain = kind
    if len(text) <= width:
        return [text] if text else []
    rank = []
    for i in range(len(text) - width + 1):
        window = text[i : i + width]
        pairs = sum(window[a] == window[b] for a in range(width) for b in range(a))
        rank.append(0 if pairs > plain else min(4095, 1 + abs(pairs - typical) * 16 // spread))
    n = len(rank)
    votes = [0] * n
    if n <= neighbours:
        votes[max(range(n), key=lambda i: (rank[i], -i))] = neighbours
    else:
        for a in range(n - neighbours + 1):
            votes[max(range(a, a + neighbours), key=lambda i: (rank[i], -i))] += 1
    chosen = [i for i in range(n) if votes[i] >= popular] or [i for i in range(n) if votes[i]]
    return [text[i : i + width] for i in chosen]


def plain_filters(text):
    """Sets of bit numbers, and numbers of features, filter by filter."""
    found = plain_features(text, D.LONG)
    if len(text) < D.SHORT_BYTES:
        found = found + plain_features(text, D.SHORT)
    if len(text) < D.TINY_BYTES:
        found = found + plain_features(text, D.TINY)
    distinct = list(dict.fromkeys(found))
    parts = [distinct[i : i + D.FILTER_FEATURES] for i in range(0, len(distinct), D.FILTER_FEATURES)]
    bits = lambda x: {int.from_bytes(xxhash.xxh3_128_digest(x)[2 * k : 2 * k + 2], "little") % D.FILTER_BITS for k in range(D.HASHES)}
    return [(set().union(*map(bits, p)), len(p)) for p in parts]


def plain_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    if (len(a), sum(n for _, n in a)) > (len(b), sum(n for _, n in b)):
        a, b = b, a

    def pair(x, y):
        most, chance = min(len(x), len(y)), len(x) * len(y) / D.FILTER_BITS
        cut = chance + 0.15 * (most - chance)
        return min(1.0, max(0.0, (len(x & y) - cut) / max(most - cut, 1e-9)))

    return sum(max(pair(x, y) for y, _ in b) * n for x, n in a) / sum(n for _, n in a)


def test_votes_filters_and_likeness_by_a_plain_version():
    rng = random.Random(12)
    texts = [b"", b"a", b"abcdefgh", b"b" * 200, *(words(rng, n).encode() for n in (3, 12, 30, 90, 160, 400, 3000))]
    texts += [D.edited(a.decode(), b.decode()).encode() for a, b in zip(texts, texts[1:], strict=False)]
    filters = [plain_filters(t) for t in texts]
    for text, want in zip(texts, filters, strict=True):
        made = D.digest(text)
        size = D.FILTER_BITS // 8 + 2
        got = [made[i : i + size] for i in range(0, len(made), size)]
        assert len(got) == len(want)
        for g, (bits, n) in zip(got, want, strict=True):
            assert int.from_bytes(g[:2], "little") == n and set(np.flatnonzero(np.unpackbits(np.frombuffer(g[2:], np.uint8))).tolist()) == bits
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(D.likeness(D.digest(a), D.digest(b)) - plain_likeness(filters[i], filters[j])) < 1e-9
