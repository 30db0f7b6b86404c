"""Spelling variants: near pairs and whole rows beside plain versions."""

import random
import re
import zlib
from collections import Counter

from oracle import same_rows
from pyspark.sql import functions as F

from cairn.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_rows(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, rows = {}, []
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        rows.append([w, form[w], None, n, len(close), words.get(form[w])])
    for r in rows:
        root = r[0]
        while form[root] is not None:
            root = form[root]
        r[2] = root
    return sorted((tuple(r) for r in rows), key=repr)


def rows_of(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, frame.collect()), key=repr)


def test_near_pairs_of_random_words(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(500)}
    words |= {"".join(rng.choice("xyzÿ") for _ in range(rng.randrange(9, 30))) for _ in range(200)}
    for w in list(words):
        at = rng.randrange(len(w) + 1)
        words |= {w[:at] + rng.choice("abxé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abxé") + w[at + 1 :]}
    words = sorted(w for w in words if len(w) >= 5)
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    pairs = [(r.short, r.long) for r in spelling.near_pairs(frame).collect()]
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)}
    assert len(pairs) == len(want) and {frozenset(p) for p in pairs} == want


def test_same_as_plain_rows_on_odd_tables(spark):
    rng = random.Random(4)
    base = ["colour", "color", "colours", "grünée", "GRÖSSE", "×÷×÷×", "straße", "house", "houses", "hause", "aaaaa", "aaaaaa", "aaaaaaa"]
    docs = [(i, " ".join(rng.choice(base) for _ in range(rng.randrange(80)))) for i in range(60)]
    docs += [(None, "colour " * 40), (None, "colour " * 40), (7, docs[7][1]), (8, None), (9, ""), (10, "12 — 日本"), (11, "y" * 200_000), (12, "house;" * 100_000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2))
    assert rows_of(spelling.variants(frame)) == plain_rows(docs)


def test_chains_of_forms_end_at_their_root(spark):
    # Counts double from word to word; each is near the next alone.
    words = ["abcdefgh" + "xyzuvwrst"[:k] for k in range(9)]
    docs = [(k, (w + " ") * 3 * 2**k) for k, w in enumerate(words)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows_of(spelling.variants(frame)) == plain_rows(docs)
    roots = {r.word: r.root for r in spelling.variants(frame).collect()}
    assert roots[words[0]] == words[-1]


def test_words_sent_in_parts_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    docs = [(i, "colour house colour") for i in range(50)]
    assert rows_of(spelling.variants(spark.createDataFrame(docs, "doc_id bigint, text string"))) == plain_rows(docs)


def test_empty_table(spark):
    assert rows_of(spelling.variants(spark.createDataFrame([], "doc_id bigint, text string"))) == []


def test_same_as_sql(spark):
    assert same_rows(spark, spelling.op11_spelling_variants, spelling.ORACLES["op11_spelling_variants"], "/root/testdata/sf0.001") > 1000


def test_no_join_of_words_is_a_broadcast(spark, capsys):
    """The vocabulary's size says little of what its chunks and grams take on the driver."""
    words = spark.createDataFrame([("colour", 9), ("color", 4)], "word string, n bigint")
    spelling.forms(words, spelling.near_pairs(words)).explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
