"""Clusters run to the end where the audit of pairs refuses."""

import pytest

from cairn.operators import dedup as D

SCHEMA = "doc_id bigint, shingles array<bigint>, signature array<bigint>, bands array<string>"


@pytest.mark.parametrize("block", [4096, 200])
def test_large_family_beyond_the_budget(spark, block):
    rows = [(i, [*range(50), 1000 + i], [0], [f"b{k}" for k in range(8)]) for i in range(520)]
    rows += [(600 + i, list(range(5000 + 60 * i, 5050 + 60 * i)), [0], ["b0"]) for i in range(5)]
    prints = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(D.PairBudgetExceeded):
        D.candidate_pairs(prints)
    if block == D.BLOCK:
        got = {r.doc_id: (r.cluster_id, r.cluster_size) for r in D.clusters(prints).collect()}
        assert got == {i: ("cluster-0", 520) for i in range(520)} | {600 + i: (f"cluster-{600 + i}", 1) for i in range(5)}
    else:
        parts = D.connected_components(D.bucket_links(prints, block=block)).collect()
        assert {(r.node, r.component) for r in parts} == {(i, 0) for i in range(520)}


def test_buckets_with_the_same_members_are_searched_once(spark):
    rows = [(1, ["a", "b"], [1] * 3), (2, ["a", "b"], [2] * 3), (3, ["c", "b"], [3] * 3), (4, ["c", None], [4] * 90)]
    heads = spark.createDataFrame(rows, "doc_id bigint, bands array<string>, shingles array<bigint>")
    got = {(r.band, r.key): r.blocks for r in D.distinct_buckets(heads, 4096, 1000).collect()}
    assert got == {(0, "a"): 1, (1, "b"): 1, (0, "c"): 1}
    assert {r.blocks for r in D.distinct_buckets(heads, 4096, 31).where("key = 'c'").collect()} == {3}  # 93 shingles
    same = heads.where("doc_id < 3")
    assert D.distinct_buckets(same, 4096, 1000).count() == 1


def test_pairs_of_copies_are_counted_not_listed(spark):
    """A family beyond the budget: linear rows, and the counts of all pairs of texts."""
    rows = [(i, list(range(50)), [1] * 8, [f"b{k}" for k in range(8)], "ab"[i % 2]) for i in range(600)]
    rows += [(600 + i, [*range(49), 99], [1] * 8, [f"b{k}" for k in range(8)], "a") for i in range(3)]
    prints = spark.createDataFrame(rows, SCHEMA + ", source string")
    with pytest.raises(D.PairBudgetExceeded):
        D.candidate_pairs(prints)
    member, heads = D.folded(prints)
    pairs = D.candidate_pairs(heads, None)
    assert [tuple(r) for r in pairs.collect()] == [(0, 600, 8)]
    links = D.copies(member).collect()
    assert len(links) == 599 + 2 and {r.left_id for r in links} == {0, 600} and {r.shared_bands for r in links} == {8}
    scored = D.scored_pairs(pairs, heads)
    every = 603 * 602 // 2
    assert D.candidate_summary(prints, pairs, member).first().candidate_pair_rows == every
    domains = {r.domain: (r.candidate_pair_rows, r.duplicate_pair_rows) for r in D.domain_summary(prints.withColumnRenamed("source", "domain"), scored, member).collect()}
    assert domains == {"a": (303 * 302 // 2,) * 2, "b": (300 * 299 // 2,) * 2}
    record = prints.selectExpr("doc_id", "source as record", "if(doc_id < 2, '', 'u') as url")
    exact = 600 * 599 // 2 + 3
    within = (303 * 302 + 300 * 299) // 2
    assert tuple(D.duplicate_summary(scored, record, member).first()) == (every, exact, every - exact, within, every - within, 0)
    members = prints.selectExpr("doc_id", "'c' as cluster_id", "603L as cluster_size", "source")
    (one,) = D.cluster_inspection(members, spark.createDataFrame([("c", 0)], "cluster_id string, doc_id bigint"), scored, member).collect()
    assert one.duplicate_edge_rows == every and one.weakest_shingle_jaccard == 49 / 51 and one.weakest_signature_overlap == 1.0


def test_classes_by_the_digest_of_the_fingerprints(spark):
    from cairn.functions import text as T
    from cairn.operators.pairs import classes

    texts = ["a b c d e f g", "A, b c d e f g!", "b c d e f a b c d e", "c d e f a b c d e f", "c d e f g", "", None, "c d e f a b c d e f"]
    prints = T.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).cache()
    rows = prints.collect()
    alike = {(a.doc_id, b.doc_id) for a in rows for b in rows if a.doc_id < b.doc_id and a.shingles_sha256 == b.shingles_sha256}
    assert alike == {(a.doc_id, b.doc_id) for a in rows for b in rows if a.doc_id < b.doc_id and sorted(a.shingles) == sorted(b.shingles)}
    plain = classes(prints.drop("shingles_sha256"))
    assert sorted(map(tuple, classes(prints).collect())) == sorted(map(tuple, plain.collect())) and classes(prints).where("doc_id <> class").count() == 3


@pytest.mark.parametrize("chunk", [4096, 3])
def test_pairs_of_classes_become_all_pairs_of_texts(spark, chunk):
    """Beside the plain join of bands: copies, near copies with copies, smallest ids on either side, texts without shingles."""
    bands = lambda *names: [*names, *(f"x{k}" for k in range(len(names), 8))]
    kinds = [(list(range(50)), bands("a", "b")), ([*range(49), 99], bands("a", "c")), (list(range(200, 230)), [f"y{k}" for k in range(8)])]
    rows = [(i, *kinds[i % 2], [i % 2] * 4) for i in range(1, 20)] + [(i, *kinds[2], [7] * 4) for i in (40, 41)]
    rows += [(50, [], None, [0] * 4), (51, [], None, [0] * 4), (60, [900], [f"z{k}" for k in range(8)], [8] * 4)]
    prints = spark.createDataFrame(rows, "doc_id bigint, shingles array<bigint>, bands array<string>, signature array<bigint>")
    plain = D.candidate_pairs(prints)
    member, heads = D.folded(prints)
    listed = D.candidate_pairs(heads, None)
    got = D.unfolded(listed, member, D.equal_scores(), chunk)
    want = sorted(map(tuple, plain.collect()))
    assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == want and len(want) == 19 * 18 // 2 + 1
    scored = D.unfolded(D.scored_pairs(listed, heads), member, D.equal_scores(), chunk)
    whole = D.scored_pairs(plain, prints)
    assert scored.columns == whole.columns and sorted(map(tuple, scored.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("name", ["dedup_candidate_pairs", "dedup_scored_pairs"])
def test_queries_list_the_pairs_of_further_texts(spark, tmp_path, name):
    from cairn.plans.dedup import QUERIES

    same, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61))
    rows = [(1, same), (2, same), (3, near), (4, same), (5, near)]
    spark.createDataFrame([(i, "s", len(t), t) for i, t in rows], "doc_id bigint, source string, n_chars bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.left_id, r.right_id) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert found == [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]
