"""Procurement audit: conflicts of interest, biased scores, and winners without the flagged expert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.storage import store

#: Which document type each evidence role may carry; fixed values.
ROLE_DOCUMENTS = {"expert_recommendation": "recommendation_record", "committee_minutes": "committee_minutes"}

#: Rules: id, severity, subject, metric, summary, action; fixed values of the findings.
CONFLICT = ("EXP-001-conflict-not-recused", "high", "expert", "recused", "专家曾推荐相关供应商，参加评审且未回避。", "暂停定标并复核专家回避义务。")
BIAS = ("EXP-002-score-bias", "medium", "expert", "score_delta_points", "该专家对其推荐供应商的评分显著高于其他专家均值。", "复核评分依据并开展专家评分离群分析。")
AWARD = ("EXP-003-award-impact", "high", "project", "winner_changed_without_expert", "剔除该专家评分后，排名第一的供应商发生变化。", "重新计算评审结果并提交采购监督复核。")

_FACT = "document_type string, expert_id string, supplier_name string, recommended boolean, participated boolean, recused boolean, evidence_quote string, confidence double"


def mean_score(holds: Column | None = None) -> Column:
    """The mean of the scores (of those that hold): the sum of whole millionths by their number, so that equal means are
    equal whatever order the rows come in, and a tie is a tie."""
    score = F.col("score") if holds is None else F.when(holds, F.col("score"))
    return F.sum(F.round(score * 1_000_000).cast("bigint")) / F.count(score) / 1_000_000


def valid_scores(scores: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Scores of known suppliers within 0 to 100."""
    return scores.where("score between 0 and 100").join(suppliers.select("project_id", "supplier_id"), ["project_id", "supplier_id"])


def matrix_problems(scores: DataFrame, experts: DataFrame, suppliers: DataFrame, project: DataFrame) -> DataFrame:
    """(project_id, problem): why a project's scores may not be judged; no row where nothing is wrong.

    ``incomplete_matrix``: not every expert scored every supplier of the project; ``duplicate_score``: one did twice;
    ``score_out_of_range``; ``unknown_supplier`` or ``unknown_expert``: a score that belongs to neither list;
    ``declared_winner_differs``: the declared winner has not the highest average (of equal ones the smallest id).
    Sizes are compared, so the full matrix is never listed.
    """
    named = lambda frame, c: frame.select("project_id", c, F.lit(True).alias(f"known_{c}")).distinct()
    size = lambda frame, c, n: frame.groupBy("project_id").agg(F.countDistinct(c).alias(n))
    rows = scores.join(named(experts, "expert_id"), ["project_id", "expert_id"], "left").join(named(suppliers, "supplier_id"), ["project_id", "supplier_id"], "left")
    both = F.col("known_expert_id").isNotNull() & F.col("known_supplier_id").isNotNull()
    cells = rows.groupBy("project_id", "expert_id", "supplier_id").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("score").between(0, 100), F.lit(False))).alias("out"),
        F.count_if(F.col("known_supplier_id").isNull()).alias("no_supplier"), F.count_if(F.col("known_expert_id").isNull()).alias("no_expert"), F.max(both).alias("known"),
    )
    seen = cells.groupBy("project_id").agg(
        F.count_if("known").alias("cells"), F.max("n").alias("most"), F.sum("out").alias("out"), F.sum("no_supplier").alias("no_supplier"), F.sum("no_expert").alias("no_expert"),
    )
    winner = _winner(scores.groupBy("project_id", "supplier_id").agg(mean_score().alias("a")), "winner", "a").select("project_id", "winner")
    all_ = project.select("project_id", F.col("original_winner_supplier_id").alias("declared")).join(seen, "project_id", "left").join(winner, "project_id", "left")
    all_ = all_.join(size(experts, "expert_id", "e"), "project_id", "left").join(size(suppliers, "supplier_id", "s"), "project_id", "left")
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    problems = F.array_compact(F.array(
        F.when(nought("cells") != nought("e") * nought("s"), "incomplete_matrix"), F.when(nought("most") > 1, "duplicate_score"), F.when(nought("out") > 0, "score_out_of_range"),
        F.when(nought("no_supplier") > 0, "unknown_supplier"), F.when(nought("no_expert") > 0, "unknown_expert"), F.when(~F.col("declared").eqNullSafe(F.col("winner")), "declared_winner_differs"),
    ))
    return all_.select("project_id", F.explode(problems).alias("problem"))


def conflict_facts(validated: DataFrame) -> DataFrame:
    """Typed facts of (project_id, file_id, role, fact_json) rows whose document type belongs to their trusted role."""
    bound = F.lit(False)
    for role, kind in ROLE_DOCUMENTS.items():
        bound = bound | ((F.col("role") == role) & (F.col("f.document_type") == kind))
    return validated.withColumn("f", F.from_json("fact_json", _FACT)).where(bound).select("project_id", "file_id", "role", "f.*")


def supplier_labels(suppliers: DataFrame) -> DataFrame:
    """(project_id, supplier_id, supplier_name, label): each name and alias once, so that naming a supplier is an equi-join."""
    names = F.array_distinct(F.concat(F.array("supplier_name"), F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))))
    return suppliers.select("project_id", "supplier_id", "supplier_name", F.explode(names).alias("label"))


def _winner(averages: DataFrame, name: str, average: str) -> DataFrame:
    """The supplier of the highest average, the smallest id among equals, of each project; by partial aggregation."""
    best = F.min(F.struct((-F.col("a")).alias("a"), F.col("supplier_id")))
    return averages.groupBy("project_id").agg(best.alias("b")).select("project_id", F.col("b.supplier_id").alias(name), (-F.col("b.a")).alias(average))


def matched_signals(facts: DataFrame, project: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Recommendations met by minutes of the same expert, and the supplier they name."""
    told = facts.where("document_type = 'recommendation_record'").select("project_id", F.col("expert_id").alias("flagged_expert_id"), F.col("supplier_name").alias("label"), "recommended", F.col("file_id").alias("recommendation_file_id"), F.col("confidence").alias("recommendation_confidence"))
    met = facts.where("document_type = 'committee_minutes'").select("project_id", F.col("expert_id").alias("flagged_expert_id"), "participated", "recused", F.col("file_id").alias("minutes_file_id"), F.col("confidence").alias("minutes_confidence"))
    terms = project.select("project_id", "score_bias_threshold", "ai_min_confidence", F.col("original_winner_supplier_id").alias("declared_original_winner_supplier_id"))
    labels = supplier_labels(suppliers).select("project_id", "label", F.col("supplier_id").alias("related_supplier_id"), F.col("supplier_name").alias("related_supplier_name"))
    return told.join(terms, "project_id").join(met, ["project_id", "flagged_expert_id"]).join(labels, ["project_id", "label"]).drop("label")


def score_metrics(facts: DataFrame, project: DataFrame, suppliers: DataFrame, scores: DataFrame) -> DataFrame:
    """One row a matched signal: the expert's score, the peers' mean, and the winners with and without the expert."""
    signal = store(matched_signals(facts, project, suppliers), "signals").df  # few rows, read three times
    keys = ["project_id", "flagged_expert_id", "related_supplier_id"]
    related = signal.select(*keys).distinct().join(scores.withColumnRenamed("supplier_id", "related_supplier_id"), ["project_id", "related_supplier_id"])
    own = F.col("expert_id") == F.col("flagged_expert_id")
    compared = related.groupBy(*keys).agg(F.max(F.when(own, F.col("score"))).alias("expert_score"), mean_score(~own).alias("peer"))
    compared = compared.where("expert_score is not null and peer is not null")
    first = _winner(scores.groupBy("project_id", "supplier_id").agg(mean_score().alias("a")), "computed_original_winner_supplier_id", "first_average")
    others = scores.join(signal.select("project_id", "flagged_expert_id"), "project_id").where("expert_id <> flagged_expert_id")
    second = _winner(others.groupBy("project_id", "supplier_id").agg(mean_score().alias("a")), "winner_without_flagged_expert", "second_average")
    joined = signal.join(compared, keys).join(first, "project_id").join(second, "project_id")
    out = joined.withColumns({
        "peer_average": F.round("peer", 4), "score_delta": F.round(F.col("expert_score") - F.col("peer"), 4), "original_winner_avg_score": F.round("first_average", 4),
        "winner_without_expert_avg_score": F.round("second_average", 4), "award_changed": F.col("computed_original_winner_supplier_id") != F.col("winner_without_flagged_expert"),
    })
    return out.drop("peer", "first_average", "second_average")


def audit_findings(metrics: DataFrame) -> DataFrame:
    """Findings of confident signals whose computed winner is the declared one: one pass, rules exploded."""
    sure = (F.col("recommendation_confidence") >= F.col("ai_min_confidence")) & (F.col("minutes_confidence") >= F.col("ai_min_confidence"))
    base = F.col("recommended") & F.col("participated") & ~F.col("recused")

    def finding(rule: tuple, holds: Column, subject: str, value: Column, threshold: Column, files: list[str]) -> Column:
        name, severity, kind, metric, summary, action = rule
        row = F.struct(
            F.concat("project_id", F.lit(f":{name}")).alias("finding_id"), F.lit(name).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(kind).alias("subject_type"), F.col(subject).alias("subject_id"),
            F.lit(metric).alias("metric_name"), value.cast("double").alias("metric_value"), threshold.cast("double").alias("threshold_value"), F.lit(summary).alias("finding_summary"),
            F.to_json(F.array(*files)).alias("evidence_file_ids_json"), F.lit(action).alias("recommended_action"),
        )
        return F.when(holds, row)

    both = ["recommendation_file_id", "minutes_file_id"]
    rules = F.array(
        finding(CONFLICT, base, "flagged_expert_id", F.lit(0.0), F.lit(1.0), both),
        finding(BIAS, base & (F.col("score_delta") >= F.col("score_bias_threshold")), "flagged_expert_id", F.col("score_delta"), F.col("score_bias_threshold"), both[:1]),
        finding(AWARD, base & F.col("award_changed"), "project_id", F.lit(1.0), F.lit(1.0), both),
    )
    eligible = metrics.where(sure & (F.col("computed_original_winner_supplier_id") == F.col("declared_original_winner_supplier_id")))
    confidence = F.round(F.least("recommendation_confidence", "minutes_confidence"), 4).alias("confidence")
    rows = eligible.select("project_id", F.col("related_supplier_id").alias("supplier_id"), confidence, F.explode(F.array_compact(rules)).alias("f"))
    return rows.select("project_id", "supplier_id", "confidence", "f.*")


def audit_summary(project: DataFrame, metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """Each project's status: insufficient_evidence, review_required or passed."""
    counts = findings.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("h"))
    known = metrics.select("project_id", F.lit(True).alias("known"), "recommendation_confidence", "minutes_confidence", "winner_without_flagged_expert", "flagged_expert_id")
    all_ = project.join(known, "project_id", "left").join(counts, "project_id", "left")
    weak = F.col("known").isNull() | (F.col("recommendation_confidence") < F.col("ai_min_confidence")) | (F.col("minutes_confidence") < F.col("ai_min_confidence"))
    status = F.when(weak, "insufficient_evidence").when(F.coalesce("n", F.lit(0)) > 0, "review_required").otherwise("passed")
    return all_.select("project_id", "title", status.alias("status"), F.coalesce("n", F.lit(0)).alias("finding_count"), F.coalesce("h", F.lit(0)).alias("high_severity_count"), "original_winner_supplier_id", "winner_without_flagged_expert", "flagged_expert_id")
