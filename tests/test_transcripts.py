"""Transcript gates against a plain version of the rule."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.operators import evaluation as V

SF = "/root/testdata/sf0.01"


def brute(text, words=None, duration=None):
    if not (text or "").strip():
        return "empty"
    if re.search(r"(.{2,20})\1{3,}", re.sub(r"\s+", "", text)):
        return "repetition"
    if any(w[0] is None or w[1] is None or not 0 <= w[0] <= w[1] <= duration for w in words or []):
        return "outside_recording"
    starts = [w[0] for w in words or []]
    return "out_of_order" if starts != sorted(starts) else None


def test_repeats_with_white_space_between(spark):
    texts = ["haha haha haha haha", "one\ntwo\none\ntwo\none\ntwo\none  two", "la la la la\x1fla", "haha haha haha", "plain words", "aaaaaaaa", "aaaaaaa", " 　\t\x85", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", V.transcript_problem(F.col("text")).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: brute(t) for i, t in enumerate(texts)}
    assert [r.p for r in sorted(got)][:5] == ["repetition", "repetition", "repetition", "repetition", None]


def test_segment_times(spark):
    cases = [[(0, 5), (5, 10)], [(5, 6), (0, 1)], [(0, 11)], [(-1, 2)], [(3, 2)], [(0, None)], [(4, 5), (4, 10)], []]
    frame = spark.createDataFrame([(i, "plain words", c, 10) for i, c in enumerate(cases)], "i int, text string, s array<struct<start_ms:bigint,end_ms:bigint>>, d bigint")
    got = {r.i: r.p for r in frame.select("i", V.transcript_problem(F.col("text"), F.col("s"), F.col("d")).alias("p")).collect()}
    assert got == {i: brute("plain words", c, 10) for i, c in enumerate(cases)}
    assert got[1] == "out_of_order" and {got[i] for i in (2, 3, 4, 5)} == {"outside_recording"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
def test_query(spark):
    from cairn.plans.calls import transcript_problems

    want = Counter((brute(r.text) or "none", r.role) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    assert {(r.problem, r.role): r.turns for r in transcript_problems(spark, SF).collect()} == want
