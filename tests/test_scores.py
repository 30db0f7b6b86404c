"""The audit's golden outcome on a matrix of four experts and three suppliers, and its degraded outcomes."""

import json

from cairn.operators import scores as S


def run(spark, confidence=0.9, roles=("expert_recommendation", "committee_minutes")):
    matrix = {"E1": (98, 80, 70), "E2": (80, 88, 72), "E3": (80, 86, 71), "E4": (80, 87, 73)}
    scores = spark.createDataFrame([("P", e, f"S{k}", float(x)) for e, row in matrix.items() for k, x in enumerate(row, 1)], "project_id string, expert_id string, supplier_id string, score double")
    suppliers = spark.createDataFrame([("P", f"S{k}", f"Firm {k}", json.dumps([f"F{k}"])) for k in (1, 2, 3)], "project_id string, supplier_id string, supplier_name string, aliases_json string")
    averages = {k: sum(row[k - 1] for row in matrix.values()) / 4 for k in (1, 2, 3)}
    winner = f"S{max(averages, key=averages.get)}"
    project = spark.createDataFrame([("P", "t", winner, 15.0, 0.75)], "project_id string, title string, original_winner_supplier_id string, score_bias_threshold double, ai_min_confidence double")
    fact = lambda kind: json.dumps({"document_type": kind, "expert_id": "E1", "supplier_name": "F1", "recommended": True, "participated": True, "recused": False, "evidence_quote": "q", "confidence": confidence})
    rows = [("P", "f1", roles[0], fact("recommendation_record")), ("P", "f2", roles[1], fact("committee_minutes"))]
    facts = S.conflict_facts(spark.createDataFrame(rows, "project_id string, file_id string, role string, fact_json string"))
    metrics = S.score_metrics(facts, project, suppliers, S.valid_scores(scores, suppliers))
    findings = S.audit_findings(metrics)
    return metrics.collect(), findings.collect(), S.audit_summary(project, metrics, findings).collect()


def test_golden(spark):
    (metric,), findings, (summary,) = run(spark)
    assert metric.score_delta == 18.0 and metric.related_supplier_id == "S1"
    assert summary.status == ("review_required" if findings else "passed")
    assert {f.rule_id for f in findings} >= {S.CONFLICT[0], S.BIAS[0]}


def test_low_confidence_or_swapped_roles(spark):
    for args in ({"confidence": 0.6}, {"roles": ("committee_minutes", "expert_recommendation")}):
        _, findings, (summary,) = run(spark, **args)
        assert not findings and summary.status == "insufficient_evidence"


def test_equal_means_are_ties_in_any_order(spark):
    """0.1 + 0.2 + 0.3 depends on the order of the sum; the mean of a supplier must not."""
    for tenths in ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1)):
        rows = [("P", f"E{k}", "S2", x) for k, x in enumerate(tenths)] + [("P", f"E{k}", "S1", 0.2) for k in range(2)]
        scores = spark.createDataFrame(rows, "project_id string, expert_id string, supplier_id string, score double").coalesce(1)
        means = scores.groupBy("project_id", "supplier_id").agg(S.mean_score().alias("a"))
        assert {r.a for r in means.collect()} == {0.2}
        assert S._winner(means, "winner", "a").first().winner == "S1"
