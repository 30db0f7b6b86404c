"""Evidence governance over ``orders`` as cases and ``lineitem`` as their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import evidence as E
from cairn.session import table

#: Columns of a line read as evidence; the same text runs in Spark and in the oracle.
_ITEM = {
    "case_id": "concat('K', l_orderkey)",
    "seq": "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax)",
    "evidence_type": "l_returnflag",
    "source_system": "concat('sys', l_suppkey % 3)",
    "modality": "case when l_linenumber % 3 = 0 then 'audio' when l_linenumber % 3 = 1 then 'document' else 'image' end",
    "claim_key": "case when l_quantity < 3 then '' else concat('k', l_linenumber % 4) end",
    "claim_value": "case when l_discount >= 0.095 then 'blocked' else 'ready' end",
    "observed_at": "cast(l_shipdate as date)",
    "asset_id": "concat('a', l_partkey % 50)",
    "asset_decision": "case when l_tax > 0.078 then 'rejected' else 'accepted' end",
    "risk_count": "case when l_tax > 0.078 then 1 else 0 end",
    "blocking_risk_count": "case when l_tax > 0.079 then 1 else 0 end",
    "license_id": "concat('lic', l_suppkey % 2)",
    "evidence_title": "concat('t', l_linenumber)",
    "evidence_text": "concat('part ', l_partkey)",
}


def _numbered(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, requirements and evidence with the order's number as case_id."""
    # Lines are numbered as they are read: texts made of them would be sent and sorted with them.
    placed = table(spark, sf_dir, "lineitem").withColumn("seq", F.expr(_ITEM["seq"]))
    made = {n: n if n == "seq" else "l_orderkey" if n == "case_id" else e for n, e in _ITEM.items()}
    features = placed.selectExpr(*(f"{e} as {n}" for n, e in made.items())).withColumn("record_id", F.concat_ws("-", _name("case_id"), F.col("seq").cast("string")))
    orders = table(spark, sf_dir, "orders")
    cases = orders.select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("account_id"), F.date_add(F.col("o_orderdate").cast("date"), 90).alias("review_due_at"))
    needed = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 2 == 0, "N").otherwise("R").alias("evidence_type"))
    return cases, needed, features


def _name(key: str) -> Column:
    return F.concat(F.lit("K"), F.col(key).cast("string"))


def inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(rows.withColumn("case_id", _name("case_id")) for rows in _numbered(spark, sf_dir))


def _context(spark, sf_dir: str) -> DataFrame:
    """Cases are grouped by number, by which lines are dealt out once, as numbers; names are made of the result."""
    found = E.agent_context(*_numbered(spark, sf_dir)).withColumn("case_id", _name("case_id"))
    return found.withColumn("context_id", F.concat(F.lit("ctx-"), "case_id"))


_LISTS = ["evidence_ids", "asset_ids", "source_systems", "modalities", "license_ids"]


def _joined(context: DataFrame) -> DataFrame:
    return context.withColumns({c: F.concat_ws(",", c) for c in _LISTS}).withColumn("review_due_at", F.col("review_due_at").cast("string"))


def evidence_gaps(spark, sf_dir):
    _, needed, features = inputs(spark, sf_dir)
    return E.evidence_gaps(needed, features)


def evidence_conflicts(spark, sf_dir):
    return E.evidence_conflicts(inputs(spark, sf_dir)[2])


def agent_context(spark, sf_dir):
    return _joined(_context(spark, sf_dir))


def review_queue(spark, sf_dir):
    return E.review_queue(_context(spark, sf_dir)).select("case_id", "review_state", "queue_place", "missing_evidence_count", "conflict_count", "stale_evidence_count")


def status_summary(spark, sf_dir):
    return E.status_summary(_context(spark, sf_dir))


#: Columns of four tables with some rows of every kind of violation; the same text runs in Spark and in the oracle.
_CASES = {
    "case_id": "case when o_orderkey % 97 = 0 then concat('K', o_orderkey - 1) else concat('K', o_orderkey) end", "account_id": "case when o_custkey % 50 = 0 then ' ' else concat('c', o_custkey) end",
    "business_question": "o_orderpriority", "review_due_at": "case when o_orderkey % 89 = 0 then null else cast(o_orderdate as date) end",
}
_NEEDS = {
    "case_id": "case when o_orderkey % 103 = 0 then 'X' when o_orderkey % 107 = 0 then '' else concat('K', o_orderkey) end",
    "evidence_type": "case o_orderkey % 6 when 0 then 'text' when 1 then 'image' when 2 then 'audio' when 3 then 'document' when 4 then 'image' else 'video' end",
}
_PROOFS = {
    "record_id": "case when l_quantity = 50 then 'twice' else concat_ws('-', l_orderkey, l_linenumber) end", "case_id": "case when l_quantity = 49 then 'X' else concat('K', l_orderkey) end",
    "asset_id": "case when l_quantity = 48 then 'zz' else concat('a', l_partkey) end", "source_system": "case when l_quantity = 47 then null else 's' end", "evidence_title": "l_returnflag",
    "observed_at": "case when l_quantity = 46 then null else cast(l_shipdate as date) end", "claim_key": "case when l_quantity = 45 then '' else 'k' end", "claim_value": "case when l_quantity >= 44.5 and l_quantity < 46 then 'v' when l_quantity < 2 then null else 'w' end",
}
_MEDIA = {
    "asset_id": "concat('a', case when p_partkey % 13 = 0 then p_partkey - 1 else p_partkey end)", "modality": "'image'", "source_uri": "p_name", "license_id": "case when p_partkey % 17 = 0 then '' else 'l' end", "mime_type": "'image/png'",
    "expected_sha256": "case when p_partkey % 20 = 0 then 'short' else repeat('aB', 32) end",
}


def source_integrity(spark, sf_dir):
    made = lambda name, columns: table(spark, sf_dir, name).selectExpr(*(f"{e} as {n}" for n, e in columns.items()))
    return E.source_integrity(made("orders", _CASES), made("orders", _NEEDS), made("lineitem", _PROOFS), made("part", _MEDIA))


_SUMS = ("evidence", "source", "modality", "rejected_asset", "risk", "blocking_risk", "stale_evidence", "missing_evidence", "conflict")
_BASE = f"""with f as materialized (select *, case_id || '-' || seq as record_id from (select {", ".join(f"{e} as {n}" for n, e in _ITEM.items())} from lineitem)),
cases as (select 'K' || o_orderkey as case_id, 'c' || o_custkey as account_id, (o_orderdate::date + 90)::date as review_due_at from orders),
needed as (select 'K' || o_orderkey as case_id, case when o_orderkey % 2 = 0 then 'N' else 'R' end as evidence_type from orders where o_orderkey % 3 <> 0),
gaps as (select case_id, evidence_type as missing_evidence_type, 'missing_required_evidence' as reason from needed n where not exists (select 1 from f where f.case_id = n.case_id and f.evidence_type = n.evidence_type)),
conflicts as (select case_id, claim_key, count(distinct claim_value) as distinct_values, string_agg(distinct claim_value, ', ' order by claim_value) as claim_values, string_agg(record_id, ', ' order by record_id) as evidence_ids from f where claim_key <> '' group by all having count(distinct claim_value) > 1),
rollup as (select case_id, count(*) as evidence_count, count(distinct source_system) as source_count, count(distinct modality) as modality_count, count(*) filter (asset_decision = 'rejected') as rejected_asset_count, sum(risk_count)::bigint as risk_count,
  sum(blocking_risk_count)::bigint as blocking_risk_count, count(*) filter (date_diff('day', observed_at, review_due_at) > {E.FRESHNESS_DAYS}) as stale_evidence_count, string_agg(record_id, ',' order by observed_at desc, record_id) as evidence_ids, string_agg(asset_id, ',' order by observed_at desc, record_id) as asset_ids,
  string_agg(distinct source_system, ',' order by source_system) as source_systems, string_agg(distinct modality, ',' order by modality) as modalities, string_agg(distinct license_id, ',' order by license_id) as license_ids,
  string_agg('[' || modality || '/' || source_system || '] ' || evidence_title || ': ' || evidence_text, chr(10) order by observed_at desc, record_id) as context_text from f join cases using (case_id) group by 1),
context as materialized (select c.case_id, account_id, review_due_at::varchar as review_due_at, {", ".join(f"coalesce({n}_count, 0) as {n}_count" for n in _SUMS)}, {", ".join(f"coalesce({c}, '') as {c}" for c in [*_LISTS, "context_text"])}, 'ctx-' || c.case_id as context_id,
  case when coalesce(missing_evidence_count, 0) > 0 or coalesce(conflict_count, 0) > 0 or coalesce(blocking_risk_count, 0) > 0 then 'blocked' when coalesce(stale_evidence_count, 0) > 0 or coalesce(risk_count, 0) > 0 then 'needs_review' else 'ready' end as review_state
  from cases c left join rollup using (case_id) left join (select case_id, count(*) as missing_evidence_count from gaps group by 1) using (case_id) left join (select case_id, count(*) as conflict_count from conflicts group by 1) using (case_id))
"""
_cols = lambda columns: ", ".join(f"{e} as {n}" for n, e in columns.items())
_blank = lambda *names: " or ".join(f"trim(coalesce({n}, '')) = ''" for n in names)
_INTEGRITY = f"""with c as (select {_cols(_CASES)} from orders), r as (select {_cols(_NEEDS)} from orders), e as (select {_cols(_PROOFS)} from lineitem), a as (select {_cols(_MEDIA)} from part) """ + " union all ".join(
    f"""select '{name}' as "check", count(*) as violations from {rows}"""
    for name, rows in {
        "empty case field": f"c where {_blank('case_id', 'account_id', 'business_question')}", "case with invalid review date": "c where review_due_at is null", "duplicate case_id": "(select 1 from c group by case_id having count(*) > 1)",
        "empty requirement field": f"r where {_blank('case_id', 'evidence_type')}", "unsupported requirement modality": "r where evidence_type not in ('text', 'image', 'audio', 'document')", "duplicate requirement": "(select 1 from r group by case_id, evidence_type having count(*) > 1)",
        "empty evidence field": f"e where {_blank('record_id', 'case_id', 'asset_id', 'source_system', 'evidence_title')}", "evidence with invalid observation date": "e where observed_at is null",
        "evidence with incomplete claim": "e where (trim(coalesce(claim_key, '')) = '') <> (trim(coalesce(claim_value, '')) = '')", "duplicate evidence record_id": "(select 1 from e group by record_id having count(*) > 1)",
        "empty asset field": f"a where {_blank('asset_id', 'modality', 'source_uri', 'license_id', 'mime_type', 'expected_sha256')}", "invalid asset SHA-256": "a where not regexp_matches(expected_sha256, '^[0-9a-fA-F]{64}$')",
        "duplicate asset_id": "(select 1 from a group by asset_id having count(*) > 1)", "requirement with unknown case": "r where not exists (select 1 from c where c.case_id = r.case_id)", "evidence with unknown case": "e where not exists (select 1 from c where c.case_id = e.case_id)",
        "evidence with unknown asset": "e where not exists (select 1 from a where a.asset_id = e.asset_id)", "case without requirement": "c where not exists (select 1 from r where r.case_id = c.case_id)", "evidence observed after review date": "e join c using (case_id) where observed_at > review_due_at",
    }.items()
)
QUERIES = {"evidence_source_integrity": source_integrity, "evidence_gaps": evidence_gaps, "evidence_conflicts": evidence_conflicts, "evidence_agent_context": agent_context, "evidence_review_queue": review_queue, "evidence_status_summary": status_summary}
ORACLES = {
    "evidence_source_integrity": _INTEGRITY,
    "evidence_gaps": _BASE + "select * from gaps",
    "evidence_conflicts": _BASE + "select * from conflicts",
    "evidence_agent_context": _BASE + "select * from context",
    "evidence_review_queue": _BASE + "select case_id, review_state, case review_state when 'blocked' then 0 when 'needs_review' then 1 else 2 end as queue_place, missing_evidence_count, conflict_count, stale_evidence_count from context where review_state <> 'ready'",
    "evidence_status_summary": _BASE + "select review_state, count(*) as cases, sum(evidence_count)::bigint as evidence_records from context group by 1",
}
