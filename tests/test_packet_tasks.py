"""Tasks of runs and findings by file, copies of photos within claims, and how often lines are sent."""

import os
import re

import pytest

from cairn.operators import packets as P
from cairn.plans import assets

SF = "/root/testdata/sf0.001"


def _frames(spark):
    made = lambda rows, kind: spark.createDataFrame(rows, kind)
    claims = made([("c1",), ("c2",)], "claim_id string")
    files = made([("c1", "f1", "image/jpeg"), ("c1", "f9", "image/png"), ("c2", "f2", "image/jpeg")], "claim_id string, file_id string, media_type string")
    photos = made(
        [("c1", "f1", "n1", 1, "h"), ("c1", "f1", "n1b", 1, "h"), ("c1", "f3", "n3", 2, "h"), ("c2", "f2", "n2", 1, "h"), ("c2", None, "n0", 3, None)], "claim_id string, file_id string, evidence_node_id string, ordinal int, perceptual_hash string"
    ).selectExpr("*", "true as decode_ok", "'' as decode_error", "false as needs_review", "1.0D as quality_score", "array('') as issue_flags")
    spans = made([], "claim_id string, file_id string, field_value string, valid_bbox boolean, evidence_node_id string, needs_review boolean")
    damages = made([("c1", "f1", "d1"), ("c1", "f3", "d3"), ("c2", "f2", "d2"), ("c2", "f2", "d2"), ("c2", None, "d0")], "claim_id string, file_id string, evidence_node_id string").selectExpr(
        "*", "file_id = 'f2' as vehicle_visible", "true as target_vehicle_clear", "0.5D as confidence", "array('x') as uncertainty_reasons", "coalesce(file_id, '') <> 'f1' as needs_review", "'p' as model_provider"
    )
    runs = made([("c1", "f1", "r1", "failed"), ("c1", "f1", "r2", "success"), ("c2", "f8", "r8", "failed"), ("c2", None, "r0", "failed")], "claim_id string, file_id string, run_id string, status string").selectExpr("*", "'e' as error_code", "'m' as error_message")
    return claims, files, photos, spans, damages, runs


def test_runs_and_findings_meet_by_file(spark):
    claims, files, photos, spans, damages, runs = _frames(spark)
    tasks = lambda *more: sorted((r.task_id, r.evidence_node_id, r.priority) for r in P.review_tasks(claims, files, photos, spans, *more).where("task_type in ('model_output_review', 'photo_damage_review')").collect() if r.task_id)
    run, found = "task:model_output_review:", "task:photo_damage_review:"
    left = [(found + "f2", "d2", "medium")] * 2 + [(found + "f3", "d3", "high")]
    assert tasks(damages, runs) == [(run + "r0", None, "high"), (run + "r1", "d1", "high"), (run + "r1", "d1", "high"), (run + "r8", None, "high"), *left]
    assert tasks(damages) == left
    assert tasks(None, runs) == [(run + "r0", None, "high"), (run + "r1", "n1", "high"), (run + "r1", "n1b", "high"), (run + "r8", None, "high")]
    # A finding without a file belongs to no run that failed.
    assert P.review_tasks(claims, files, photos, spans, damages, runs).where("evidence_node_id = 'd0'").count() == 1


def test_marked_copies_are_those_that_are_joined(spark):
    rows = [(c, o, f"p{f}", ok, h) for c in ("a", "b", None) for o in (1, 2, 10) for f in (9, 10) for ok, h in ((True, "h"), (False, "h"), (None, "h"), (True, ""), (True, None), (True, "g"))]
    photos = spark.createDataFrame(rows + rows[:7], "claim_id string, ordinal int, file_id string, decode_ok boolean, perceptual_hash string")
    told = lambda frame: sorted(map(repr, frame.select("claim_id", "ordinal", "file_id", "perceptual_hash", "first_file_id").collect()))
    want = told(P.copied_photos(photos))
    assert told(P.copied_photos(P.with_first(photos))) == want and len(want) > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
@pytest.mark.parametrize("query,most", [(assets.review_tasks, 3), (assets.claim_summary, 8)])
def test_photos_are_sent_once_by_file(spark, query, most):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Exchange hashpartitioning\(file_id", plan)) == 1 and "perceptual_hash" not in " ".join(re.findall(r"Exchange hashpartitioning.*", plan))
    assert plan.count("Exchange hashpartitioning") <= most
