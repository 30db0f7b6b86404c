"""Exact pairs beside all pairs, suites over published tables, settings of runs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.functions import text as T
from cairn.operators import dedup as D
from cairn.operators import pairs as E
from cairn.operators import stages as S
from cairn.operators import validation as V
from cairn.session import table


def similarity(a, b):
    return len(a & b) / len(a | b)


def family(rng, n, size, changes):
    """Near copies of one set, and their copies."""
    first = [rng.randrange(10**6) for _ in range(size)]
    out = []
    for _ in range(n):
        s = set(first)
        for _ in range(rng.randrange(changes)):
            s.discard(rng.choice(first))
            s.add(rng.randrange(10**6))
        out.append(s)
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 1.0])
def test_pairs_are_all_of_those_with_the_similarity(spark, threshold):
    rng = random.Random(int(threshold * 10))
    sets = [s for k in range(6) for s in family(rng, 12, rng.choice([1, 3, 10, 40]), 8)]
    sets += [{rng.randrange(30) for _ in range(rng.randrange(1, 12))} for _ in range(60)] + [{1, 2, 3}] * 4 + [set(), set()]
    rows = [(i, list(s)) for i, s in enumerate(sets)]
    pairs, member = E.similar_pairs(spark.createDataFrame(rows, "doc_id bigint, shingles array<bigint>"), threshold)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s) if s else i, i)
    assert {r.doc_id: r["class"] for r in member.collect()} == {i: first[frozenset(s) if s else i] for i, s in enumerate(sets)}
    heads = sorted(i for k, i in first.items() if isinstance(k, frozenset))
    want = {(a, b) for k, a in enumerate(heads) for b in heads[k + 1 :] if similarity(sets[a], sets[b]) >= threshold}
    got = pairs.collect()
    assert {(r.left_id, r.right_id) for r in got} == want and len(got) == len(want)
    assert all(r.shingle_jaccard == pytest.approx(similarity(sets[r.left_id], sets[r.right_id])) for r in got)


def test_rows_below_the_budget_are_among_the_exact_ones_and_beyond_it_they_are_still_found(spark):
    docs = [(i, " ".join(f"w{(i // 4) * 50 + j}" for j in range(40)) + (" more" * (i % 4))) for i in range(80)]
    prints = T.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).cache()
    scored = D.scored_pairs(D.candidate_pairs(prints), prints).where(f"is_duplicate and shingle_jaccard < 1").collect()
    pairs, member = E.similar_pairs(prints, D.THRESHOLD)
    name = {r.doc_id: r["class"] for r in member.collect()}
    found = {(r.left_id, r.right_id): r.shingle_jaccard for r in pairs.collect()}
    assert scored and all(found[tuple(sorted((name[r.left_id], name[r.right_id])))] == pytest.approx(r.shingle_jaccard) for r in scored)
    with pytest.raises(D.PairBudgetExceeded):
        D.candidate_pairs(prints, budget=10)
    assert len(found) >= 80  # each group of four has six pairs


def test_odd_tables_have_no_pairs(spark):
    kind = "doc_id bigint, shingles array<bigint>"
    for rows in ([], [(1, [])], [(1, [1, 2])], [(None, [1]), (2, [1])]):
        pairs, member = E.similar_pairs(spark.createDataFrame(rows, kind), 0.7)
        assert pairs.collect() == [] and member.count() == sum(r[0] is not None for r in rows)
    with pytest.raises(ValueError):
        E.similar_pairs(spark.createDataFrame([], kind), 0)


def test_suites_tell_all_errors_and_warnings_together(spark):
    kind = StructType.fromDDL("k int, state string, pid string")
    parent = spark.createDataFrame([("p1",), ("p2",)], "pid string")
    rows = spark.createDataFrame([(1, "open", "p1"), (1, "odd", "p9"), (3, None, None)], kind)
    tables = {
        "mart": V.Published(rows, kind, ("k",), {"state": V.Rule(required=True, one_of=("open",))}, expected=2, warn={"late": F.col("k") > 2}),
        "parent": V.Published(parent, parent.schema), "none": V.Published(parent.limit(0), parent.schema), "wrong": V.Published(parent, StructType.fromDDL("pid int")),
        "meant": V.Published(parent.limit(0), parent.schema, expected=0),
    }
    found = V.suite(tables, (("mart.parent", "mart", "pid", "parent", "pid"), ("mart.wrong", "mart", "pid", "wrong", "pid")))
    assert found.warnings == ["mart.late: 1"]
    assert sorted(found.errors) == sorted(["mart.duplicate_key: 1", "mart.state_missing: 1", "mart.state_unknown: 1", "mart.parent: 1", "mart.wrong: not checked, a table of it is unsound", "mart: 3 rows, not 2", "none: no rows", "wrong: column pid is string, not int"])
    good = {"parent": tables["parent"], "meant": tables["meant"]}
    assert V.suite(good, (), ("two parents", lambda n: n["parent"] == 2)).raise_if_failed().errors == []
    assert V.suite(good, (), ("three parents", lambda n: n["parent"] == 3)).errors == ["three parents: {'parent': 2, 'meant': 0}"]


def test_settings_come_from_a_table(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("password", "x"), ("b", None)], "name string, value string")
    assert S.run_config(rows, "a int, b string, c double").collect() == [(1, None, None)]
    with pytest.raises(ValueError):
        S.run_config(rows, "password string")
    with pytest.raises(Exception, match="two values"):
        S.run_config(rows.unionByName(spark.createDataFrame([("a", "2")], "name string, value string")), "a int").collect()


def test_suite_of_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    tables = {"nation": V.Published(nation, nation.schema, ("n_nationkey",)), "region": V.Published(region, region.schema, ("r_regionkey",))}
    assert V.suite(tables, (("nation.region", "nation", "n_regionkey", "region", "r_regionkey"),)).raise_if_failed().facts["nation.rows"] == 25
