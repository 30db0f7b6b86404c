"""Held-out accuracy of the two classifiers, and their defined cases."""

import os
import zlib

import numpy as np
import pytest

from cairn.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def measured(spark, scored, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in scored.collect() if r.doc_id in labels and r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    right = np.array([r.predicted == labels[r.doc_id] for r in rows])
    y = np.array([labels[r.doc_id] for r in rows])
    return right.mean(), right[y == 1].mean(), right[y == 0].mean()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
@pytest.mark.parametrize("module,label,least", [(quality, "quality", (0.97, 0.97, 0.9))])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = measured(spark, module.scored(docs, module.fit(docs, labels)), label)
    print(label, got)
    assert all(g >= x for g, x in zip(got, least, strict=True)), got


@pytest.mark.parametrize("module", [toxicity, quality])
def test_defined_cases(spark, module):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(["", None, "a b c " * 50_000, "same", "same"])] + [(None, "no id", None, None)], "doc_id bigint, text string, score string, held_out double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1)], none.schema)
    twice = some.unionByName(some).unionByName(spark.createDataFrame([(2, 0, 1)], some.schema))  # repeated and contradicting
    for labels in (none, some, twice):
        rows = module.scored(docs, module.fit(docs, labels)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        same = [r.score for r in rows if r.doc_id in (3, 4)]
        assert same[0] == same[1]
    assert module.scored(docs.limit(0), module.fit(docs.limit(0), some)).count() == 0


def test_keep_ordinary_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "fr")], "doc_id bigint, text string, lang string")
    model = toxicity.Model(b"", b"", None, 0.0)
    assert toxicity.keep_ordinary(docs, model).columns == docs.columns and toxicity.keep_ordinary(docs, model).count() == 2


def test_weights_are_at_the_minimum_of_the_pairs_loss():
    """Bradley-Terry by a plain loss: no step in any direction lowers it, and its slope is nought."""
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.4, 1, (300, 4)), rng.normal(0, 1, (300, 4))
    w = quality.bradley_terry(good, bad)

    def loss(v):
        far = (good - bad) @ v
        return sum(np.log1p(np.exp(-f)) for f in far) + 0.5 * 1e-3 * len(far) * (v @ v)

    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        assert loss(w) <= loss(w + step) and loss(w) <= loss(w - step)
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-3


def test_threshold_is_the_quantile_with_the_fewest_errors(spark):
    """The fitted scores beside every other threshold on the labelled rows."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1, 400):
        good = int(rng.random() < 0.6)
        marks = rng.integers(0, 12 if good else 30)
        rows.append((i, "plain words here. " * 8 + "### $$ " * int(marks), good))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    learnt = [(t.encode(), g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 5]
    scores, y = model.scores([t for t, _ in learnt]), np.array([g for _, g in learnt])
    errors = lambda cut: int(((scores >= cut) != y).sum())
    assert errors(quality.ACCEPT) == min(errors(c) for c in [0, *scores, 2])


def test_parting_is_best_beside_every_other_place():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = int(rng.integers(4, 40))
        y = np.array([0, 1] + [int(rng.random() < 0.7) for _ in range(n)])
        strength, weight = np.round(rng.normal(size=len(y)) + y, 1), np.where(y == 1, 1.0, 2.5)
        low, high = quality.parting(strength, y, weight)
        wrong = lambda cut: weight[(strength >= cut) != y].sum()
        assert low <= high and wrong((low + high) / 2 if low < high else high) <= min(wrong(c) for c in [*strength, 9]) + 1e-9


def test_few_bad_rows_do_not_let_new_ones_pass(spark):
    """sf0.01 has 47 bad rows to learn from and 11 apart; strengths by weights learnt on the same rows let 3 of these pass."""
    small = SF.replace("0.1", "0.01")
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.scored(docs, quality.fit(docs, labels)).collect() if r.doc_id in y and r.held_out]
    assert sum(r.predicted for r in rows if y[r.doc_id] == 0) == 0 and all(r.predicted for r in rows if y[r.doc_id] == 1)


def test_weights_are_those_of_every_pair(spark):
    """Beside all pairs listed; then beside a class that no sample of 4,000 rows holds whole."""
    rng = np.random.default_rng(7)
    good, bad = rng.normal(0.3, 1, (60, quality.FEATURES)), rng.normal(0, 1, (40, quality.FEATURES))
    good[0, 3], bad[1, 3] = 90.0, -70.0  # rows far from the others
    x, y = np.concatenate((good, bad)), np.repeat([1, 0], [60, 40])
    rows = spark.createDataFrame([(int(k), i % 5, v.tolist()) for i, (k, v) in enumerate(zip(y, x, strict=True))], "y int, fold int, x array<double>").repartition(3)
    fold = np.arange(100) % 5
    sizes = {-1: (40, 60), 2: tuple(int(((y == k) & (fold != 2)).sum()) for k in (0, 1))}
    middle, scale = x.mean(axis=0), x.std(axis=0)
    got = quality.all_pairs_weights(rows, sizes, middle, scale)
    for m in sizes:
        g, b = (x[(y == k) & (fold != m)] / scale for k in (1, 0))
        want = quality.bradley_terry(np.repeat(g, len(b), axis=0), np.tile(b, (len(g), 1)))
        assert np.abs(got[m] - want).max() < 2e-6


def test_every_labelled_row_is_learnt_from(spark):
    """Beyond the former 4,000 rows a class: the weights are those of all rows, whatever rows a sample would hold."""
    texts = {1: "plain words here. they go on.", 0: "### $$ ### odd $$"}
    rows = [(i, texts[i % 2] + " more" * (i % 7) + (" Xx" * (i % 11) if i % 2 else "")) for i in range(11_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    told = quality.usable(labels, "quality", [0, 1])
    learnt = quality.learnt_rows(quality.featured(docs), told, {0: 4400, 1: 4400})
    counts = {(r.y, r.fold): r["count"] for r in learnt.groupBy("y", "fold").count().collect()}
    want = {k: sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(k, 11_000, 2)) for k in (0, 1)}
    assert all(sum(n for (y, _), n in counts.items() if y == k) == want[k] > 4000 for k in want)
    assert all(abs(n - want[y] / 5) <= 4400 // quality.DEALT + 1 for (y, _), n in counts.items())


@pytest.mark.parametrize("ties", [1, 60])
def test_parting_by_ranges_is_that_of_the_arrays(spark, ties):
    rng = np.random.default_rng(ties)
    for shift in (0.0, 1.0, 9.0, -9.0):
        y = (rng.random(400) < 0.6).astype(int)
        s = np.round((rng.normal(size=400) + shift * y) * 60 / ties) / 60 * ties
        told = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
        assert quality._parted(told, 400, 100) == quality.parting(s, y, np.ones(400))
