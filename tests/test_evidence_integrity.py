"""The eighteen counts on rows that break each rule, beside counts by loops."""

from cairn.operators import evidence as E


def test_every_count_is_found(spark):
    cases = [("k1", "a", "q", "2024-01-10"), ("k1", "a", "q", "2024-01-10"), ("k2", " ", "q", None), (None, "a", "q", "2024-01-01"), (None, "a", "q", "2024-01-01"), ("k3", "a", "q", "2024-01-10")]
    needs = [("k1", "text"), ("k1", "text"), ("k9", "smell"), (None, "text"), ("k2", "")]
    proofs = [("r1", "k1", "m1", "s", "t", "2024-01-11", "x", "y"), ("r1", "k1", "m1", "s", "t", "2024-01-01", "x", ""), ("r2", "k8", "m9", "s", "", None, "", ""), ("r3", None, None, "s", "t", "2024-01-01", None, None)]
    media = [("m1", "text", "u", "l", "t", "a" * 64), ("m1", "text", "u", "l", "t", "z" * 64), ("m2", "text", "", "l", "t", "")]
    made = lambda rows, kind: spark.createDataFrame(rows, kind)
    dated = lambda df, c: df.selectExpr(*(f"cast({n} as date) as {n}" if n == c else n for n in df.columns))
    got = E.source_integrity(
        dated(made(cases, "case_id string, account_id string, business_question string, review_due_at string"), "review_due_at"), made(needs, "case_id string, evidence_type string"),
        dated(made(proofs, "record_id string, case_id string, asset_id string, source_system string, evidence_title string, observed_at string, claim_key string, claim_value string"), "observed_at"),
        made(media, "asset_id string, modality string, source_uri string, license_id string, mime_type string, expected_sha256 string"),
    )
    assert {r.check: r.violations for r in got.collect()} == {
        "empty case field": 3, "case with invalid review date": 1, "duplicate case_id": 2, "empty requirement field": 2, "unsupported requirement modality": 2, "duplicate requirement": 1,
        "empty evidence field": 2, "evidence with invalid observation date": 1, "evidence with incomplete claim": 1, "duplicate evidence record_id": 1, "empty asset field": 1, "invalid asset SHA-256": 2,
        "duplicate asset_id": 1, "requirement with unknown case": 2, "evidence with unknown case": 2, "evidence with unknown asset": 2, "case without requirement": 3, "evidence observed after review date": 2,
    }
    assert E.source_integrity(*(spark.createDataFrame([], t.schema) for t in (
        dated(made(cases, "case_id string, account_id string, business_question string, review_due_at string"), "review_due_at"), made(needs, "case_id string, evidence_type string"),
        dated(made(proofs, "record_id string, case_id string, asset_id string, source_system string, evidence_title string, observed_at string, claim_key string, claim_value string"), "observed_at"),
        made(media, "asset_id string, modality string, source_uri string, license_id string, mime_type string, expected_sha256 string"),
    ))).where("violations <> 0").count() == 0


def test_lines_are_numbered_before_texts_are_made(spark):
    from cairn.plans import evidence as P

    plan = P.inputs(spark, "/root/testdata/sf0.001")[2]._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Window [", 1)
    assert "source_system" in above and "source_system" not in below
