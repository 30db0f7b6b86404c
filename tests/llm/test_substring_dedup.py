"""Removed words against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from cairn.llm import substring_dedup as S


def brute(rows, span):
    """Of (doc_id, text) rows: doc_id, words, removed, hash of the rest."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - span + 1):
            if d is not None:
                key = tuple(w[i : i + span])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - span + 1):
            if d is not None and first[tuple(w[i : i + span])] < d:
                gone.update(range(i, i + span))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def corpus(seed, span):
    rng = random.Random(seed)
    make = lambda n: [rng.choice("abcdefghé") * rng.randint(1, 3) for _ in range(n)]
    shared = [make(span + k) for k in (0, 1, span, -1)]
    rows = []
    for i in range(60):
        text = make(rng.randint(0, 2 * span))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(shared)
        rows.append((i * 37 % 101, rng.choice([" ", "\n", "\t  "]).join(text)))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(7000, None), (7001, ""), (None, rows[3][1]), (37, rows[5][1]), (9, " ".join(make(30) * 40))]
    return rows


@pytest.mark.parametrize("span,gram,limit", [(50, 25, 1 << 30), (6, 3, 1 << 30), (6, 3, -1), (5, 5, 1 << 30)])
def test_matches_brute_force(spark, monkeypatch, span, gram, limit):
    monkeypatch.setattr(S, "SKETCH_BROADCAST", limit)
    if limit < 0:
        monkeypatch.setattr(S, "SHARD_ANCHORS", 64)
    rows = corpus(span, span)
    got = S.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), span, gram).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, span), key=str)


def test_sketch_never_underestimates(spark):
    """Many anchors in few counters: estimates may be too high, and none is lost."""
    rng = np.random.default_rng(2)
    common = rng.integers(-(2**63), 2**63, 500)
    lists = [(i, [int(x) for x in np.unique(np.concatenate((rng.integers(-(2**63), 2**63, 800), rng.choice(common, 20))))]) for i in range(100)]
    found = S.store(spark.createDataFrame(lists, "doc_id bigint, anchors array<bigint>"), "t")
    hot = {(r.doc_id, h) for r in S.repeated_anchors(found, 82_000).collect() for h in r.hot}
    seen = {}
    for d, own in lists:
        for h in own:
            seen.setdefault(h, []).append(d)
    true = {(d, h) for h, ds in seen.items() if len(ds) > 1 for d in ds}
    assert true <= hot and len(hot - true) < 0.05 * 82_000


def test_anchors_are_local():
    h = S.word_hashes([bytes([65 + i % 26, 65 + i // 26 % 26]) for i in range(300)])
    whole = S.window_anchors(h)
    assert len(whole) == 300 - S.SPAN + 1
    for i in (0, 17, 250):
        assert S.window_anchors(h[i : i + S.SPAN])[0] == whole[i]
    assert len(S.window_anchors(h[: S.SPAN - 1])) == 0


def test_without_repeats_keeps_columns(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(2, "start " + passage + " end", "en", 1), (1, passage, "fr", 2), (3, None, None, 3)], "doc_id bigint, text string, starts string, hot int")
    got = {r.doc_id: (r.text, r.starts, r.hot) for r in S.without_repeats(frame).collect()}
    assert got == {2: ("start end", "en", 1), 1: (passage, "fr", 2), 3: (None, None, 3)}
    assert S.without_repeats(frame.limit(0)).columns == frame.columns and S.digests(frame.limit(0)).count() == 0


def test_sketch_of_anchors_never_underestimates_windows(spark):
    """Exact numbers of documents of every window beside the merged sketch: what is repeated is always told."""
    span, gram = 12, 6
    rows = [(d, t) for d, t in corpus(4, span) if d is not None]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    told = {(r.doc_id, h) for r in S.repeated_anchors(S.store(S.anchors(frame, span, gram), "anchors"), 1).collect() for h in r.hot}
    docs = {}
    for d, t in rows:
        words = (t or "").encode().split()
        for i, a in enumerate(S.window_anchors(S.word_hashes(words), span, gram).view(np.int64).tolist()):
            docs.setdefault((tuple(words[i : i + span]), a), set()).add(d)
    assert len({w for w, _ in docs}) == len(docs)  # a window has one anchor wherever it is
    repeated = {k: v for k, v in docs.items() if len(v) > 1}
    assert len(repeated) > 100 and all((d, a) in told for (_, a), v in repeated.items() for d in v)


def test_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i % 9973}v{i % 17}" for i in range(200_000))
    rows = [(1, long, 1, "a"), (2, "before " + " ".join(long.split()[5000:5200]) + " after", 2, "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, __of int, __runs string")
    got = {r.doc_id: r for r in S.without_repeats(frame).collect()}
    assert got[1].text == long and got[2].text == "before after" and got[2]["__runs"] == "b" and S.without_repeats(frame).columns == frame.columns
