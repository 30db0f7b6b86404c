"""Procurement audit over ``lineitem`` read as a score matrix: ship year, line number and supplier group as project, expert and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import scores as S
from cairn.session import table
from cairn.storage import store


def inputs(spark, sf_dir: str) -> dict[str, DataFrame]:
    """The score matrix is small beside the lines it comes from: it is stored, and all else is made from it.

    A score is twice the mean quantity, rounded half up to tenths in whole numbers: quantities count in hundredths.
    """
    year = F.year("l_shipdate")
    items = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), year.cast("string")).alias("project_id"), F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("expert_id"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 6).cast("string")).alias("supplier_id"), "l_quantity", year.alias("y"),
    )
    matrix = store(items.groupBy("project_id", "y", "expert_id", "supplier_id").agg((F.expr("(2 * sum(cast(round(l_quantity * 100) as bigint)) + 5 * count(l_quantity)) div (10 * count(l_quantity))") / 10).alias("score")), "matrix").df
    scores = matrix.drop("y")
    names = matrix.select("project_id", "supplier_id").distinct()
    suppliers = names.select("*", F.concat(F.lit("Supplier "), "supplier_id").alias("supplier_name"), F.to_json(F.array(F.concat(F.lit("alias-"), "supplier_id"))).alias("aliases_json"))
    best = S._winner(scores.groupBy("project_id", "supplier_id").agg(S.mean_score().alias("a")), "original_winner_supplier_id", "a").drop("a")
    years = store(matrix.select("project_id", "y").distinct().join(best, "project_id"), "years").df
    project = years.select("project_id", F.concat(F.lit("Audit "), "project_id").alias("title"), "original_winner_supplier_id", F.lit(1.0).alias("score_bias_threshold"), F.lit(0.75).alias("ai_min_confidence"))
    name = F.when(F.col("y") % 2 == 0, F.concat(F.lit("Supplier S"), (F.col("y") % 6).cast("string"))).otherwise(F.concat(F.lit("alias-S"), (F.col("y") % 6).cast("string")))
    expert = F.concat(F.lit("E"), (F.col("y") % 4 + 1).cast("string"))

    def fact(kind: str) -> F.Column:
        return F.to_json(F.struct(F.lit(kind).alias("document_type"), expert.alias("expert_id"), name.alias("supplier_name"), F.lit(True).alias("recommended"), F.lit(True).alias("participated"), (F.col("y") % 7 == 0).alias("recused"), F.lit("quote").alias("evidence_quote"), (F.lit(0.7) + (F.col("y") % 5) * 0.05).alias("confidence")))

    told = years.select("project_id", F.concat(F.lit("rec-"), "project_id").alias("file_id"), F.lit("expert_recommendation").alias("role"), fact("recommendation_record").alias("fact_json"))
    met = years.select("project_id", F.concat(F.lit("min-"), "project_id").alias("file_id"), F.when(F.col("y") % 11 == 0, "expert_recommendation").otherwise("committee_minutes").alias("role"), fact("committee_minutes").alias("fact_json"))
    return {"scores": S.valid_scores(scores, suppliers), "suppliers": suppliers, "project": project, "facts": S.conflict_facts(told.unionByName(met))}


def _metrics(i: dict[str, DataFrame]) -> DataFrame:
    return store(S.score_metrics(i["facts"], i["project"], i["suppliers"], i["scores"]), "metrics").df


def conflict_facts(spark, sf_dir):
    return inputs(spark, sf_dir)["facts"].withColumn("confidence", F.round("confidence", 6))


def matrix_problems(spark, sf_dir):
    """The matrix with some scores left out, some doubled, and a supplier and an expert that no list has."""
    i = inputs(spark, sf_dir)
    experts = i["scores"].select("project_id", "expert_id").distinct()
    year = F.substring("project_id", 2, 4).cast("int")
    scores = i["scores"].where(~((year % 2 == 0) & (F.col("expert_id") == "E3") & (F.col("supplier_id") == "S1")))
    again = i["scores"].where((year % 3 == 0) & (F.col("expert_id") == "E1"))
    odd = i["project"].where(year % 5 == 0).select("project_id", F.lit("E99").alias("expert_id"), F.lit("S99").alias("supplier_id"), F.lit(101.0).alias("score"))
    return S.matrix_problems(scores.unionByName(again).unionByName(odd.select(*scores.columns)), experts, i["suppliers"], i["project"])


def score_metrics(spark, sf_dir):
    m = _metrics(inputs(spark, sf_dir))
    return m.withColumn("recommendation_confidence", F.round("recommendation_confidence", 6)).withColumn("minutes_confidence", F.round("minutes_confidence", 6))


def audit_findings(spark, sf_dir):
    return S.audit_findings(_metrics(inputs(spark, sf_dir)))


def audit_summary(spark, sf_dir):
    i = inputs(spark, sf_dir)
    metrics = _metrics(i)
    return S.audit_summary(i["project"], metrics, S.audit_findings(metrics))


#: The mean of scores as ``S.mean_score`` has it: whole millionths by their number.
_MEAN = "sum(round(score * 1000000)::bigint){0} / count(score){0} / 1000000"
_ALL = _MEAN.format("")
_BASE = f"""with items as (select 'P' || year(l_shipdate) as project_id, 'E' || l_linenumber as expert_id, 'S' || (l_suppkey % 6) as supplier_id, l_quantity, year(l_shipdate) as y from lineitem),
scores as materialized (select project_id, expert_id, supplier_id, ((2 * sum(round(l_quantity * 100)::bigint) + 5 * count(l_quantity)) // (10 * count(l_quantity))) / 10 as score from items group by all),
years as (select distinct project_id, y from items),
best as materialized (select project_id, supplier_id, {_ALL} as a, row_number() over (partition by project_id order by {_ALL} desc, supplier_id) as rn from scores group by 1, 2),
base as materialized (select y.project_id, y, 'E' || (y % 4 + 1) as expert_id, case when y % 2 = 0 then 'Supplier S' else 'alias-S' end || (y % 6) as label, 'S' || (y % 6) as related, y % 7 = 0 as recused, 0.7::double + (y % 5) * 0.05::double as confidence, y % 11 <> 0 as bound, b.supplier_id as declared from years y join best b on b.project_id = y.project_id and rn = 1),
compared as (select base.project_id, max(score) filter (where s.expert_id = base.expert_id) as es, {_MEAN.format(' filter (where s.expert_id <> base.expert_id)')} as pa from base join scores s on s.project_id = base.project_id and s.supplier_id = related group by 1),
without as materialized (select s.project_id, s.supplier_id, {_ALL} as a, row_number() over (partition by s.project_id order by {_ALL} desc, s.supplier_id) as rn from scores s join base on base.project_id = s.project_id and s.expert_id <> base.expert_id group by 1, 2),
metrics as materialized (select base.*, es, pa, round(es - pa, 4) as delta, b.a as fa, w.supplier_id as second, w.a as sa, declared <> w.supplier_id as changed from base join compared using (project_id) join best b on b.project_id = base.project_id and b.rn = 1 join without w on w.project_id = base.project_id and w.rn = 1 where bound and es is not null and pa is not null),
eligible as (select * from metrics where confidence >= 0.75 and not recused)"""
_RULES = "\nunion all\n".join(
    f"""select project_id, related as supplier_id, round(confidence, 4) as confidence, project_id || ':{r[0]}' as finding_id, '{r[0]}' as rule_id, '{r[1]}' as severity, '{r[2]}' as subject_type, {subject} as subject_id,
'{r[3]}' as metric_name, {value}::double as metric_value, {threshold}::double as threshold_value, '{r[4]}' as finding_summary, {files} as evidence_file_ids_json, '{r[5]}' as recommended_action from eligible where {holds}"""
    for r, subject, value, threshold, files, holds in (
        (S.CONFLICT, "expert_id", "0", "1", """'["rec-' || project_id || '","min-' || project_id || '"]'""", "true"),
        (S.BIAS, "expert_id", "delta", "1", """'["rec-' || project_id || '"]'""", "delta >= 1"),
        (S.AWARD, "project_id", "1", "1", """'["rec-' || project_id || '","min-' || project_id || '"]'""", "changed"),
    )
)
QUERIES = {"score_conflict_facts": conflict_facts, "score_matrix_problems": matrix_problems, "score_metrics": score_metrics, "score_audit_findings": audit_findings, "score_audit_summary": audit_summary}
ORACLES = {
    "score_matrix_problems": _BASE
    + """, bad as (select * from scores where not (substr(project_id, 2, 4)::int % 2 = 0 and expert_id = 'E3' and supplier_id = 'S1') union all select * from scores where substr(project_id, 2, 4)::int % 3 = 0 and expert_id = 'E1'
union all select project_id, 'E99', 'S99', 101.0 from years where substr(project_id, 2, 4)::int % 5 = 0),
size as (select project_id, count(distinct expert_id) * count(distinct supplier_id) as want from scores group by 1), cell as (select project_id, expert_id, supplier_id, count(*) as n from bad group by all),
win as (select project_id, supplier_id, row_number() over (partition by project_id order by """ + _ALL + """ desc, supplier_id) as rn from bad group by 1, 2)
select project_id, 'incomplete_matrix' as problem from size left join (select project_id, count(*) as n from cell where expert_id <> 'E99' group by 1) using (project_id) where coalesce(n, 0) <> want
union all select distinct project_id, 'duplicate_score' from cell where n > 1 union all select distinct project_id, 'score_out_of_range' from bad where not score between 0 and 100
union all select distinct project_id, 'unknown_supplier' from bad where supplier_id = 'S99' union all select distinct project_id, 'unknown_expert' from bad where expert_id = 'E99'
union all select b.project_id, 'declared_winner_differs' from base b left join win w on w.project_id = b.project_id and w.rn = 1 where b.declared is distinct from w.supplier_id""",
    "score_conflict_facts": _BASE
    + """ select project_id, 'rec-' || project_id as file_id, 'expert_recommendation' as role, 'recommendation_record' as document_type, expert_id, label as supplier_name, true as recommended, true as participated, recused, 'quote' as evidence_quote, round(confidence, 6) as confidence from base
union all select project_id, 'min-' || project_id, 'committee_minutes', 'committee_minutes', expert_id, label, true, true, recused, 'quote', round(confidence, 6) from base where bound""",
    "score_metrics": _BASE
    + """ select project_id, expert_id as flagged_expert_id, related as related_supplier_id, 'Supplier ' || related as related_supplier_name, 'rec-' || project_id as recommendation_file_id, 'min-' || project_id as minutes_file_id, true as recommended, true as participated, recused,
round(confidence, 6) as recommendation_confidence, round(confidence, 6) as minutes_confidence, es as expert_score, round(pa, 4) as peer_average, delta as score_delta, 1.0::double as score_bias_threshold, 0.75::double as ai_min_confidence, declared as declared_original_winner_supplier_id,
declared as computed_original_winner_supplier_id, second as winner_without_flagged_expert, round(fa, 4) as original_winner_avg_score, round(sa, 4) as winner_without_expert_avg_score, changed as award_changed from metrics""",
    "score_audit_findings": _BASE + ", findings as (" + _RULES + ") select * from findings",
    "score_audit_summary": _BASE
    + ", findings as ("
    + _RULES
    + """) select b.project_id, 'Audit ' || b.project_id as title, case when m.project_id is null or m.confidence < 0.75 then 'insufficient_evidence' when n > 0 then 'review_required' else 'passed' end as status, coalesce(n, 0) as finding_count, coalesce(h, 0) as high_severity_count,
b.declared as original_winner_supplier_id, m.second as winner_without_flagged_expert, m.expert_id as flagged_expert_id from base b left join metrics m using (project_id) left join (select project_id, count(*) as n, count(*) filter (where severity = 'high') as h from findings group by 1) using (project_id)""",
}
