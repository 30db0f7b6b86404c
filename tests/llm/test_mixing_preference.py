"""The two native operators against their SQL, and their defined cases."""

import hashlib
import os
import random
import re

import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from cairn.llm import mixing, preference

DIRS = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)]


@pytest.mark.parametrize("sf", DIRS)
@pytest.mark.parametrize("module", [mixing, preference])
def test_same_as_sql(spark, sf, module):
    for name, query in module.QUERIES.items():
        assert same_rows(spark, query, module.ORACLES[name], sf) > 0


def fill(total, nodes):
    """Reference water filling: nodes are {name: (weight, capacity)}."""
    left, open_, out = total, dict(nodes), {}
    while open_:
        w = sum(x[0] for x in open_.values())
        full = {k: c for k, (wk, c) in open_.items() if c * w <= left * wk}
        if not full:
            out.update({k: left * wk // w for k, (wk, _) in open_.items()})
            break
        k = min(full, key=lambda k: (full[k] / open_[k][0], k))
        out[k] = full[k]
        left -= full[k]
        del open_[k]
    return out


def test_budgets_fill_siblings_before_ancestors(spark):
    rng = random.Random(1)
    leaves = [(d, l, s, rng.choice([0, 5, 40, 900, 5000])) for d in "wxyz" for l in ("en", "de", "fr") for s in ("s1", "s2", "s3")]
    weights = {"domain": {"w": 5, "x": 3, "z": 0}, "lang": {"en": 4}, "source": {"s1": 7}}
    cap = spark.createDataFrame(leaves, "domain string, lang string, source string, cap bigint")
    for total in (0, 100, 7000, 10**6):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(cap, total, weights).collect()}
        want = {}
        level = lambda name, key: weights.get(name, {}).get(key, 1)
        of = lambda *p: sum(c for *k, c in leaves if tuple(k[: len(p)]) == p)
        for d, bd in fill(total, {d: (level("domain", d), of(d)) for d in "wxy"}).items():
            for l, bl in fill(bd, {l: (level("lang", l), of(d, l)) for l in ("en", "de", "fr")}).items():
                for s, bs in fill(bl, {s: (level("source", s), of(d, l, s)) for s in ("s1", "s2", "s3")}).items():
                    want[d, l, s] = bs
        assert got == want


def plain_mix(rows, budgets, epochs, seed):
    """Documents taken leaf by leaf and epoch by epoch in the order of their hashes, one row at a time."""
    taken, spent = [], {}
    for epoch in range(epochs):
        order = []
        for doc_id, text, lang, source, *_ in rows:
            number = int((re.search(r"([0-9]{1,9})$", source or "") or [0, 0])[1])
            leaf = (("web", "books", "code", "forum")[number % 4], lang or "(none)", source or "(none)")
            tie = hashlib.md5((text or "").encode()).hexdigest()
            rank = hashlib.md5("|".join([str(seed), str(epoch), "" if doc_id is None else str(doc_id), tie]).encode()).hexdigest()
            order.append((rank, doc_id is not None, doc_id or 0, tie, leaf, len((text or "").split()), doc_id))
        for *_, tie, leaf, tokens, doc_id in sorted(order):
            at = spent.get(leaf, 0)
            if at + tokens <= budgets.get(leaf, -1):
                taken.append((doc_id, *leaf, tokens, tie, epoch))
            spent[leaf] = at + tokens
    return sorted(taken, key=repr)


@pytest.mark.parametrize("rows_a_range", [4096, 1])
def test_prefix_of_epochs(spark, monkeypatch, rows_a_range):
    """Ties, rows without an id, equal rows, a very long text and a hot source, against one row at a time."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(mixing, "COPIES", 3)
    rows = [(i, "w " * (i % 7), "en", f"src{i % 3}", 0) for i in range(200)] + [(5, "tie tie", "en", "src2", 1), (None, None, None, None, 2), (None, "a b", None, "odd", 3), (900, "long " * 5000, "en", "src1", 4)]
    rows += [(7, "equal rows here", "en", "src1", k) for k in range(10)] + [(None, "no id", "de", "src4", k) for k in range(40)] + [(None, f"no id {k}", "de", "src4", k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n int")
    for percent, epochs in ((50, 1), (80, 2), (250, 3), (0, 1)):
        got = mixing.mix(docs, percent=percent, epochs=epochs).collect()
        tree = {}
        for r in mixing.with_tree(docs).collect():
            tree[r.domain, r.lang, r.source] = tree.get((r.domain, r.lang, r.source), 0) + r.tokens * r.n * epochs
        cap = spark.createDataFrame([(*k, v) for k, v in tree.items()], "domain string, lang string, source string, cap bigint")
        budgets = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(cap, sum(tree.values()) // epochs * percent // 100, mixing.WEIGHTS).collect()}
        assert sorted(((r.doc_id, r.domain, r.lang, r.source, r.tokens, r.tie, r.epoch) for r in got), key=repr) == plain_mix(rows, budgets, epochs, mixing.SEED)
    assert mixing.mix(docs, percent=300, epochs=3).count() == 3 * len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    kept = mixing.kept_once(docs, percent=60)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_preference_cases(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "é1"), (0, 2, "user", "more"), (0, 3, "assistant", "good"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "é1"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"),
        (2, 0, "user", "x"), (3, 0, "user", "x"), (3, 1, "assistant", None), (4, 0, None, "lone"), (None, 0, "user", "none"), (6, 0, "assistant", "a"), (6, 0, "assistant", "a"), (7, 0, "assistant", "b"),
    ]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, prompt string")
    got = {r.pair_id: r for r in preference.formatted(frame, F.expr("conv_id div 2"), F.expr("conv_id % 2 = 0")).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[0].prompt_turns, got[0].chosen, got[0].rejected, got[0].chosen_mask) == (3, "<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n", "14-26")
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected, got[1].rejected_mask) == (1, "", "<|assistant|>\n<|end|>\n", "14-22")
    assert (got[2].chosen_id, got[2].rejected_id, got[2].prompt, got[2].chosen, got[2].rejected) == (4, None, "", "<||>\nlone<|end|>\n", "")
    assert got[3].chosen_mask == "14-23,37-46"
    assert preference.formatted(frame.limit(0), F.expr("conv_id div 2"), F.expr("conv_id % 2 = 0")).count() == 0


def test_preference_of_very_long_turns(spark):
    long = "wörd " * 200_000
    frame = spark.createDataFrame([(0, 0, "user", long), (1, 0, "user", long), (0, 1, "assistant", long), (1, 1, "assistant", long + "!")], "conv_id bigint, turn bigint, role string, text string")
    (row,) = preference.formatted(frame, F.expr("conv_id div 2"), F.expr("conv_id % 2 = 0")).collect()
    assert row.prompt_turns == 1 and long in row.prompt and long in row.chosen and row.rejected.endswith("!<|end|>\n")


def test_budgets_of_very_large_counts(spark):
    """One child of 5e18 tokens among 10,000: tokens times weights are far beyond a bigint."""
    large, small, n, total = 5 * 10**18, 10**14, 10_000, 3 * 10**18
    rows = spark.range(n).select(F.lit("d").alias("domain"), F.lit("l").alias("lang"), F.col("id").cast("string").alias("source"), F.when(F.col("id") == 7, large).otherwise(small).alias("cap"))
    got = {r.source: r.budget for r in mixing.budgets(rows, total, {}).collect()}
    assert got.pop("7") == total - small * (n - 1) and set(got.values()) == {small} and len(got) == n - 1
