"""The relations between stages over ``orders``, ``lineitem``, ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import dedup as D
from cairn.operators import stages as S
from cairn.plans import claims as P
from cairn.plans import dedup as W
from cairn.session import table
from cairn.storage import store

def _settings(spark, sf_dir: str, kind: str) -> DataFrame:
    """(name, value): a run's settings as its own tables tell them; a password is among them, and must not be shown."""
    orders = table(spark, sf_dir, "orders").agg(F.concat(F.max("o_orderdate").cast("date").cast("string"), F.lit(" 00:00:00")).alias("day"))
    regions = table(spark, sf_dir, "region").agg(F.count("*").cast("string").alias("version"), F.min("r_name").alias("engine"), F.max("r_name").alias("model"))
    told = {
        "claim": {"runtime_config_version": "version", "run_started_at": "day", "ocr_engine": "engine", "required_fields_json": "'[\"claim_number\"]'", "minimum_text_confidence": "'0.5'", "ai_model": "model", "minio_bucket": "'b'", "database_password": "'x'"},
        "call": {"runtime_config_version": "version", "asr_engine": "engine", "min_text_chars": "'10'", "minio_bucket": "'b'", "database_password": "'x'"},
    }[kind]
    pairs = ", ".join(f"named_struct('name', '{n}', 'value', {v})" for n, v in told.items())
    return regions.crossJoin(orders).selectExpr(f"inline(array({pairs}))")


def _config(spark, sf_dir: str, kind: str) -> DataFrame:
    """The settings, written as a table once and read from it by whatever needs them."""
    return S.run_config(store(_settings(spark, sf_dir, kind), "settings").df, {"claim": S.CLAIM_SETTINGS, "call": S.CALL_SETTINGS}[kind])


def claim_run_config(spark, sf_dir):
    return _config(spark, sf_dir, "claim").withColumn("run_started_at", F.col("run_started_at").cast("string"))


def call_run_config(spark, sf_dir):
    return _config(spark, sf_dir, "call")


def _inputs(spark, sf_dir: str) -> DataFrame:
    """Materials of the claims; those of some claims lie in another bucket."""
    materials = P.materials(spark, sf_dir)
    moved = materials.withColumn("bucket", F.when(F.substring("claim_id", 2, 20).cast("bigint") % 9 == 0, "elsewhere").otherwise(F.col("bucket")))
    return S.claim_material_inputs(moved, _config(spark, sf_dir, "claim"))


def claim_material_inputs(spark, sf_dir):
    return _inputs(spark, sf_dir).groupBy("role", "supported", "locator_valid", "runtime_locator_valid").agg(F.count("*").alias("materials"))


def claim_objects(spark, sf_dir):
    """What the trusted locators find, and which photos go on to be judged."""
    inputs = store(_inputs(spark, sf_dir), "material-inputs").df
    objects = inputs.where("length(object_key) % 3 > 0").select("bucket", "object_key", F.sha2("object_key", 256).alias("sha256")).distinct()
    found = S.readable(inputs, objects).join(inputs.select("claim_id", "material_index", "role", "media_type"), ["claim_id", "material_index"])
    return found.withColumn("judged", S.is_judged()).groupBy("role", "object_exists", "judged").agg(F.count("*").alias("objects"), F.count("sha256").alias("hashed"))


def claim_validation_inputs(spark, sf_dir):
    """Photos asked about beside their answers: some answers are of another file or another content."""
    k = F.col("o_orderkey")
    photo = lambda i: F.struct(F.lit(str(i)).alias("file_order"), F.concat(F.lit(f"p{i}-"), k.cast("string")).alias("file_id"), F.sha2(F.concat(k.cast("string"), F.lit(str(i))), 256).alias("sha256"), F.lit("{}").alias("photo_quality"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), k.cast("string")).alias("claim_id"), (k % 2 == 0).alias("model_input_usable"), F.to_json(F.array(photo(1), photo(2))).alias("usable_photo_inputs_json"), "o_orderkey")
    answered = orders.select("claim_id", F.concat(F.lit("p1-"), F.when(k % 5 == 0, k + 1).otherwise(k).cast("string")).alias("file_id"), F.sha2(F.concat(F.when(k % 7 == 0, k + 1).otherwise(k).cast("string"), F.lit("1")), 256).alias("photo_sha256"), F.lit("raw").alias("raw_damage_response"))
    rows = S.damage_validation_inputs(orders, answered)
    return rows.groupBy("file_order", "photo_quality_json", F.col("raw_damage_response").isNotNull().alias("answered")).agg(F.count("*").alias("photos"))


def document_quality_inputs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("claim_id"), (F.col("o_orderkey") % 3).cast("int").alias("material_index"))
    ocr, found = orders.withColumn("document_ocr_text", F.lit("{}")), orders.where("material_index > 0").withColumn("document_fields_text", F.lit("{}"))
    rows = S.document_quality_inputs(ocr, found, _config(spark, sf_dir, "claim"))
    return rows.groupBy("material_index", "required_fields_text", "minimum_text_confidence").agg(F.count("*").alias("documents"), F.count_if(F.col("claim_id") == F.col("claim_id_text")).alias("bound"))


def evidence_inputs(spark, sf_dir):
    """Images of evidence, what was read of them, and answers bound to their trusted role."""
    k = F.col("o_orderkey")
    evidence = table(spark, sf_dir, "orders").select((k % 50).alias("project_id"), F.concat(F.lit("f"), k.cast("string")).alias("file_id"), F.when(k % 2 == 0, "committee_minutes").otherwise("expert_recommendation").alias("role"), F.lit("b").alias("bucket"), F.lit("o").alias("object_key"), F.when(k % 3 == 0, "image/jpeg").otherwise("image/png").alias("media_type"))
    images = S.evidence_images(evidence)
    read = S.evidence_ocr(images.withColumn("ocr_json", F.format_string('{"status":"success","full_text":"t","mean_confidence":0.5,"text_line_count":%d}', F.length("file_id"))))
    answers = evidence.select(F.col("project_id").cast("string"), "file_id", F.lit("raw").alias("raw_response"))
    bound = S.conflict_validation_inputs(answers, images).withColumnRenamed("role", "trusted_role")
    rows = read.join(bound, ["project_id", "file_id"])
    return rows.groupBy("project_id", "role", "trusted_role", "ocr_status", "ocr_confidence", "ocr_text_line_count").agg(F.count("*").alias("files"))


def call_stages(spark, sf_dir):
    """Locators of calls, transcripts of the usable ones, and answers beside the recording's hash."""
    text = F.coalesce("text", F.lit(""))
    calls = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.lit("b").alias("bucket"), F.concat_ws("/", "conv_id", "turn").alias("object_key"), "role", text.alias("said"))
    facts = S.call_inputs(calls).join(calls.select("call_id", "role", "said"), "call_id").select("call_id", "object_key", "role", F.sha2("said", 256).alias("object_sha256"), F.length("said").cast("double").alias("duration_seconds"), (F.length("said") > 30).alias("audio_usable"))
    heard = S.call_transcripts(facts, F.to_json(F.struct(F.lit("success").alias("status"))))
    answers = calls.where("role = 'user'").select("call_id", F.lit("raw").alias("raw_analysis_response"))
    bound = S.analysis_validation_inputs(answers, heard)
    return bound.agg(F.count("*").alias("answers"), F.countDistinct("object_sha256").alias("recordings"), F.min("raw_analysis_response").alias("raw"))


def dedup_bucket_members(spark, sf_dir):
    prints = W._prints(spark, sf_dir)
    bands = S.checked_bands(prints, D.exploded_bands(prints), T.BANDS)
    buckets = D.collision_buckets(bands)
    found = S.bucket_members(bands, prints.select("doc_id", F.col("source").alias("domain")), buckets)
    return found.withColumn("member_doc_ids", F.array_join(F.col("member_doc_ids").cast("array<string>"), ",")).withColumn("member_domains", F.array_join("member_domains", ","))


def dedup_source_summary(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    blocks = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("record_id"), F.concat_ws("/", "source", "lang").alias("capture_url"), F.col("source").alias("domain"), F.col("lang").alias("target_url"), day.cast("string").alias("crawled_at"))
    return S.source_summary(blocks)


QUERIES = {
    "stage_claim_run_config": claim_run_config, "stage_call_run_config": call_run_config, "stage_claim_material_inputs": claim_material_inputs, "stage_claim_objects": claim_objects,
    "stage_claim_validation_inputs": claim_validation_inputs, "stage_document_quality_inputs": document_quality_inputs, "stage_evidence_inputs": evidence_inputs, "stage_calls": call_stages,
    "dedup_bucket_members": dedup_bucket_members, "dedup_source_summary": dedup_source_summary,
}
_MOVED = P._BASE + ", moved as (select *, substr(claim_id, 2)::bigint % 9 = 0 as away from valid), inside as (select *, ok and not away as trusted from moved) "
ORACLES = {
    "stage_claim_run_config": """select count(*)::int as runtime_config_version, (select max(o_orderdate)::date::varchar || ' 00:00:00' from orders) as run_started_at, min(r_name) as ocr_engine, null::varchar as ocr_device, '["claim_number"]' as required_fields_json, 0.5::double as minimum_text_confidence, null::varchar as ai_provider, max(r_name) as ai_model, 'b' as minio_bucket from region""",
    "stage_call_run_config": "select count(*)::int as runtime_config_version, null::varchar as run_started_at, min(r_name) as asr_engine, null::varchar as asr_model, null::varchar as asr_language, 10 as min_text_chars, null::varchar as ai_provider, null::varchar as ai_model, 'b' as minio_bucket from region",
    "stage_claim_material_inputs": _MOVED + "select role, supported, ok as locator_valid, trusted as runtime_locator_valid, count(*) as materials from inside group by all",
    "stage_claim_objects": _MOVED
    + """, f as (select role, length(object_key) % 3 > 0 as hit from inside where trusted)
select role, hit as object_exists, hit and role = 'damage_photo' as judged, count(*) as objects, count(*) filter (hit) as hashed from f group by all""",
    "stage_claim_validation_inputs": """with p as (select o_orderkey as k, unnest([1, 2]) as i from orders where o_orderkey % 2 = 0)
select i as file_order, '{}' as photo_quality_json, i = 1 and k % 5 <> 0 and k % 7 <> 0 as answered, count(*) as photos from p group by all""",
    "stage_document_quality_inputs": "select (o_orderkey % 3)::int as material_index, '[\"claim_number\"]' as required_fields_text, 0.5::double as minimum_text_confidence, count(*) as documents, count(*) as bound from orders where o_orderkey % 3 > 0 group by 1",
    "stage_evidence_inputs": "select (o_orderkey % 50)::varchar as project_id, case when o_orderkey % 2 = 0 then 'committee_minutes' else 'expert_recommendation' end as role, role as trusted_role, 'success' as ocr_status, 0.5::double as ocr_confidence, length('f' || o_orderkey)::int as ocr_text_line_count, count(*) as files from orders where o_orderkey % 3 <> 0 group by all",
    "stage_calls": "select count(*) as answers, count(distinct sha256(coalesce(text, ''))) as recordings, 'raw' as raw from conversations where role = 'user' and length(coalesce(text, '')) > 30",
    "dedup_bucket_members": W._BASE + "select band, key, pair_slots, members as member_count, (select string_agg(doc_id::varchar, ',' order by doc_id) from bands b where b.band = buckets.band and b.key = buckets.key) as member_doc_ids, (select string_agg(distinct source, ',' order by source) from bands b join documents using (doc_id) where b.band = buckets.band and b.key = buckets.key) as member_domains from buckets",
    "dedup_source_summary": "select count(*) as text_block_rows, count(distinct source) filter (doc_id % 4 <> 0) as warc_record_rows, count(distinct source || '/' || lang) as capture_url_rows, count(distinct source) as domain_rows, count(distinct lang) as target_url_rows, min(('2024-01-01'::date + (doc_id % 400)::int)::varchar) as earliest_capture_date, max(('2024-01-01'::date + (doc_id % 400)::int)::varchar) as latest_capture_date from documents",
}
