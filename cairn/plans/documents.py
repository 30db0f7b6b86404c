"""Scanned claim forms over ``orders``: observations in several shapes, labelled fields, and the quality gate; answers of
models held against their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import jsonguard as J
from cairn.functions import ocr as O
from cairn.session import table


def _scans(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.concat(F.lit('{"text":"Claim No. C'), F.when(k % 11 == 0, 0).otherwise(k).cast("string"), F.lit('","confidence":0.9,"bbox":[0,0,50,10]}'))
    label = F.lit('{"txt":"LOSS DATE:","score":0.8,"box":[[0,20],[40,20],[40,30],[0,30]]}')
    written = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(',["'), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit('",0.7,[60,21,90,31]]')))
    raw = F.when(k % 13 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), label, written, F.lit(","), number, F.lit("]")))
    raw = F.when(k % 17 == 0, F.concat(F.lit('{"results":'), raw, F.lit("}"))).otherwise(raw)
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), k.cast("string")).alias("claim_id"), raw.alias("raw"))


def scanned_forms(spark, sf_dir):
    rows = _scans(spark, sf_dir).withColumn("ocr", O.observations(F.col("raw"))).withColumn("f", O.fields(F.col("ocr.text_lines")))
    rows = rows.withColumn("q", O.document_quality(F.col("ocr"), F.col("f"), F.col("claim_id"), ["claim_number", "loss_date"], 0.5))
    return rows.select("claim_id", "f.claim_number", F.nullif("f.loss_date", F.lit("")).alias("loss_date"), "q.ocr_confidence", "q.document_usable", F.array_join("q.failure_reasons", ",").alias("failure_reasons"))


def checked_answers(spark, sf_dir):
    """Answers of a model, a third of them broken: how many pass their contract, and what stands in for the rest."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"document_type":"committee_minutes","expert_id":"exp-'), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit('","supplier_name":null,"recommended":null,"participated":true,"recused":'), F.when(k % 3 == 0, "null").otherwise("false"), F.lit(',"evidence_quote":"seen","confidence":0.5}'))
    rows = table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("raw")).select(J.guarded(F.col("raw"), J.audit_fact).alias("g"))
    return rows.groupBy(F.col("g.error").isNull().alias("valid"), F.get_json_object("g.json", "$.recused").alias("recused")).agg(F.count("*").alias("answers"), F.countDistinct(F.get_json_object("g.json", "$.expert_id")).alias("experts"))


def _fenced(body: Column, k: Column) -> Column:
    """Bare, in a plain fence or in a json fence."""
    return F.when(k % 3 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(k % 3 == 2, F.concat(F.lit("```JSON\n"), body, F.lit("```"))).otherwise(body)


def _by_outcome(rows: DataFrame, answer: Column, *fields: str) -> DataFrame:
    """Answers by status, reason and some fields."""
    of = lambda name: F.get_json_object("a", f"$.{name}")
    found = rows.select(answer.alias("a")).select(of("status").alias("status"), of("uncertainty_reasons").alias("reasons"), *(of(f).alias(f) for f in fields), of("confidence").cast("double").alias("confidence"))
    return found.groupBy("status", "reasons", *fields).agg(F.count("*").alias("answers"), F.round(F.sum("confidence"), 2).alias("confidence"))


def damage_answers(spark, sf_dir):
    """Answers on photos: trimmed and lower-cased severities, fences of both kinds, and each way to break the contract."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(
        (k % 2 == 0).alias("vehicle_visible"), F.lit(True).alias("target_vehicle_clear"), F.lit(True).alias("damage_visible"), F.array(F.lit(" door "), F.lit(" ")).alias("damaged_parts"), F.array(F.lit("dent")).alias("damage_types"),
        F.when(k % 19 == 0, " ").otherwise(" two\nlines ").alias("evidence_summary"), (k % 17 != 0).alias("finding_determinate"), F.when(k % 34 == 0, F.array(F.lit("blur"))).when(k % 13 == 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("evidence_limitations"),
        F.when(k % 23 == 0, "huge").otherwise(" Minor ").alias("severity_hint"), F.when(k % 29 == 0, 1.5).otherwise(0.25).alias("confidence"),
    ))
    raw = F.when(k % 11 == 0, "[]").when(k % 7 == 0, "so: " + "{}").otherwise(_fenced(body, k))
    answer = J.guarded(raw, J.or_error(J.damage, J.NO_DAMAGE))["json"]
    return _by_outcome(table(spark, sf_dir, "orders"), answer, "severity_hint", "damaged_parts", "evidence_summary", "vehicle_visible")


def call_answers(spark, sf_dir):
    """Answers on calls: fences of both kinds, and ways to break the contract; the call's id stands in each answer."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(
        F.when(k % 7 == 0, "gossip").otherwise("praise").alias("problem_category"), F.lit("positive").alias("customer_sentiment"), F.when(k % 11 == 0, -2.0).otherwise(0.12346).alias("sentiment_score"), F.lit("low").alias("urgency"),
        F.array(F.lit(" late "), F.lit("")).alias("key_issues"), F.lit(" a\nrequest ").alias("customer_request"), F.lit("resolved").alias("resolution_status"), F.lit(False).alias("requires_followup"), F.lit("poor").alias("agent_attitude"),
        F.when(k % 13 == 0, "").otherwise("fine").alias("summary"), F.lit(0.5).alias("confidence"),
    ))
    checked = J.guarded(_fenced(body, k), J.or_error(J.call_analysis, J.NO_ANALYSIS))["json"]
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("call-"), (k % 2).cast("string")).alias("call_id"), checked.alias("checked"))
    return _by_outcome(rows, J.with_context(F.col("checked"), call_id=F.col("call_id")), "call_id", "problem_category", "sentiment_score", "key_issues", "customer_request")


QUERIES = {"scanned_forms": scanned_forms, "checked_answers": checked_answers, "damage_answers": damage_answers, "call_answers": call_answers}
ORACLES = {
    "scanned_forms": """with s as (select o_orderkey as k, 'C' || o_orderkey as claim_id, o_orderkey % 13 = 0 as blank, o_orderkey % 7 = 0 as undated, o_orderkey % 11 = 0 as other, o_orderdate from orders)
select claim_id, case when blank then '' when other then 'C0' else claim_id end as claim_number, case when not blank and not undated then strftime(o_orderdate::date, '%Y-%m-%d') end as loss_date, case when blank then 0.0 when undated then 0.85 else 0.8 end::double as ocr_confidence,
  not (blank or undated or (other and k <> 0)) as document_usable, concat_ws(',', case when blank then 'ocr_unreadable' end, case when blank then 'ocr_confidence_below_threshold' end, case when blank or undated then 'required_fields_missing' end, case when not blank and other and k <> 0 then 'claim_number_mismatch' end) as failure_reasons from s""",
    "checked_answers": "select o_orderkey % 3 <> 0 as valid, case when o_orderkey % 3 <> 0 then 'false' end as recused, count(*) as answers, count(distinct case when o_orderkey % 3 <> 0 then o_orderkey % 1000 end) as experts from orders group by all",
    "damage_answers": """with k as (select o_orderkey as k from orders), r as (select k, case when k % 11 = 0 then 'response_not_object' when k % 7 = 0 then 'invalid_json' when k % 19 = 0 then 'invalid_evidence_summary' when k % 13 = 0 and k % 34 <> 0 then 'invalid_evidence_limitations'
  when k % 17 = 0 and k % 34 <> 0 then 'indeterminate_without_evidence_limitation' when k % 23 = 0 then 'invalid_severity' when k % 29 = 0 then 'invalid_confidence' end as why from k)
select case when why is null then 'success' else 'invalid_response' end as status, case when why is not null then '["' || why || '"]' when k % 34 = 0 then '["blur"]' else '[]' end as reasons, case when why is null then 'minor' else 'unknown' end as severity_hint, case when why is null then '["door"]' else '[]' end as damaged_parts,
  case when why is null then 'two' || chr(10) || 'lines' else '' end as evidence_summary, (why is null and k % 2 = 0)::varchar as vehicle_visible, count(*) as answers, round(sum(case when why is null then 0.25 else 0 end), 2)::double as confidence from r group by all""",
    "call_answers": """with r as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'invalid_problem_category' when o_orderkey % 11 = 0 then 'invalid_sentiment_score' when o_orderkey % 13 = 0 then 'invalid_summary' end as why from orders)
select case when why is null then 'success' else 'invalid_response' end as status, case when why is null then '[]' else '["' || why || '"]' end as reasons, 'call-' || (k % 2) as call_id, case when why is null then 'praise' else 'other' end as problem_category, case when why is null then '0.1235' else '0.0' end as sentiment_score,
  case when why is null then '["late"]' else '[]' end as key_issues, case when why is null then 'a' || chr(10) || 'request' else '' end as customer_request, count(*) as answers, round(sum(case when why is null then 0.5 else 0 end), 2)::double as confidence from r group by all""",
}
