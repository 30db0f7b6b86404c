"""Compression distances one window at a time, how toxic windows are found, and held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pytest
import zstandard

from cairn.llm import toxicity as T


def plain_features(texts, model):
    """The features by a loop over windows, each compressed on its own."""
    packers = []
    for d in (model.ordinary, model.toxic):
        made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers.append(zstandard.ZstdCompressor(level=T.LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
    out = []
    for text in texts:
        words = text.lower().split()
        parts = [b" " + b" ".join(words[i : i + T.WINDOW]) + b" " for i in range(0, len(words), T.WINDOW)]
        far = [len(packers[0].compress(p)) - len(packers[1].compress(p)) for p in parts]
        out.append([max([0, *far]), *(np.log1p(sum(max(0, f - b) for f in far)) for b in T.BEYOND), np.log1p(len(far))])
    return np.array(out)


def made_up(seed, n, share=0.3):
    """Pseudo-words in documents; a toxic document has some abusive words among ordinary ones."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "on", "sha", "ve", "du", "rin", "po", "es", "ta"]
    abuse = ["wretchling", "dungbrain", "slimewit", "foulface"]
    texts, y = [], []
    for _ in range(n):
        toxic = rng.random() < share
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(40, 200))]
        if toxic:
            for at in rng.sample(range(len(words)), 6):
                words[at] = rng.choice(abuse)
        texts.append(" ".join(words).encode())
        y.append(int(toxic))
    return texts, np.array(y)


def test_features_equal_windows_one_by_one():
    texts, y = made_up(1, 160)
    model = T.learn(texts, y, 0.3)
    probe = [*texts[:20], b"", b" \t\n", b"One", "É ÀB wretchling".encode() * 40, b"x" * 5000, b"Dungbrain " * 3000]
    assert np.allclose(T.Scorer(model).features(probe), plain_features(probe, model))


def test_dictionaries_are_trained_on_windows_of_their_own_class():
    texts, y = made_up(2, 400)
    model = T.learn(texts, y, 0.3)
    base = min(len(model.ordinary), len(model.toxic)) - T.CLASS_BYTES
    assert model.ordinary[-base:] == model.toxic[-base:]
    own = model.toxic[:-base]
    assert own.count(b"dungbrain") and own.count(b"slimewit") and b"dungbrain" not in model.ordinary
    fresh, truth = made_up(3, 300)
    got = T.Scorer(model).scores(fresh) >= 0.5
    assert (got == truth).mean() > 0.95


@pytest.mark.parametrize("toxic,ordinary", [(1, 1), (1, 40), (3, 3), (40, 1)])
def test_few_rows_still_train(toxic, ordinary):
    texts, y = made_up(4, 200, 0.5)
    some = [*np.flatnonzero(y == 1)[:toxic], *np.flatnonzero(y == 0)[:ordinary]]
    model = T.learn([texts[i] for i in some], y[some], 0.5)
    scores = T.Scorer(model).scores([texts[0], b"", b"a"])
    assert model.weights and np.isfinite(scores).all() and ((0 <= scores) & (scores <= 1)).all()


@pytest.mark.parametrize("sf,least,most", [("sf0.1", 0.46, 0.02), ("check_s", 0.88, 0.015)])
def test_held_out_recall_and_false_alarms(spark, sf, least, most):
    """Floors a little below what was reached; both tables were used in choosing the settings, see README. On sf0.1 58 % of
    the toxic documents hold one of the insults that were looked for, in English alone."""
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("needs the synthetic tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.scored(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), T.fit(docs, labels)).where("held_out").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    caught = np.mean([r.predicted for r in rows if truth[r.doc_id] == 1])
    alarms = np.mean([r.predicted for r in rows if truth[r.doc_id] == 0])
    print(sf, caught, alarms)
    assert caught >= least and alarms <= most


def test_sample_takes_contradictions_repeats_and_bytes_as_stated(spark):
    from cairn.llm.labelled import sample

    docs = spark.createDataFrame([(i, "b" * 100, 0) for i in range(1, 40)] + [(7, "a" * 50, 1), (8, None, 1), (None, "c", 1)], "doc_id bigint, text string, label int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(9, 0), (None, 1), (10, None), (11, 5)], "doc_id bigint, toxic int")
    usable = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5 and i != 9]
    texts, y, counts = sample(docs, labels, "toxic", {1: 100, 0: 100})
    assert counts == {k: sum(i % 2 == k for i in usable) for k in (0, 1)} and len(texts) == len(usable) == len(y)
    assert dict(zip(usable, texts, strict=True)).get(7, b"a" * 50) == b"a" * 50
    texts, y, _ = sample(docs, labels, "toxic", {1: 100, 0: 100}, max_bytes=350)
    assert all(sum(len(t) for t, k in zip(texts, y, strict=True) if k == c) <= 350 for c in (0, 1)) and len(texts) >= 6
    assert sorted(sample(docs.repartition(7), labels, "toxic", {1: 5, 0: 5})[0]) == sorted(sample(docs, labels.repartition(3), "toxic", {1: 5, 0: 5})[0])


def test_separation_is_the_rank_sum_beyond_chance():
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1], 200)
    assert abs(T.separation(rng.normal(size=400), y)) < 3 < T.separation(rng.normal(size=400) + y, y)
    assert T.separation(np.zeros(400), y) == T.separation(np.arange(5), np.zeros(5)) == 0.0
    assert T.separation(np.arange(7), np.array([0, 0, 0, 1, 1, 1, 1])) < T.SEPARATES  # however well so few are told apart


def test_a_handful_of_labels_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i} of words " * 9) for i in range(13)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(9)], "doc_id bigint, toxic int")
    model = T.fit(docs, labels)
    assert not model.separates and T.keep_ordinary(docs, model).count() == 13
    assert all(0 <= r.score <= 1 for r in T.scored(docs, model).collect())


def test_a_fit_that_separates_rejects():
    texts, y = made_up(4, 400)[:2]
    model = T.learn(texts, np.array(y), 0.3)
    assert model.separates
