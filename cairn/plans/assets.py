"""Training assets, photo quality, packets and page blocks over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import html as H
from cairn.functions import media as M
from cairn.operators import packets as P
from cairn.session import table
from cairn.storage import store


def _assets(spark, sf_dir: str) -> DataFrame:
    """Every document as a text or a document, and beside it an SVG image of a size by its id."""
    docs = table(spark, sf_dir, "documents", spread=True)
    number = F.col("doc_id").cast("string")
    license_ = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source")).alias("license_id")
    side = (F.col("doc_id") % 700 + 300).cast("string")
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), side, F.lit('px" height="800"/>'))
    kind = F.when(F.col("doc_id") % 2 == 0, "text").otherwise("document").alias("modality")
    written = docs.select(number.alias("record_id"), kind, license_, F.lit("text/plain").alias("mime_type"), "text", F.lit("").alias("content_base64"), F.lit("").alias("expected_sha256"))
    drawn = docs.select(F.concat(F.lit("img-"), number).alias("record_id"), F.lit("image").alias("modality"), license_, F.lit("image/svg+xml").alias("mime_type"), F.lit("").alias("text"), F.base64(svg.cast("binary")).alias("content_base64"), F.sha2(svg, 256).alias("expected_sha256"))
    return written.unionByName(drawn)


def asset_release(spark, sf_dir):
    rows = M.released(M.asset_features(_assets(spark, sf_dir)))
    return rows.select("record_id", "modality", "license_id", "content_sha256", "byte_size", "token_count", "width", "height", "quality_score", F.array_join("risk_flags", ",").alias("risk_flags"), "decision")


def asset_release_summary(spark, sf_dir):
    return M.release_summary(M.released(M.asset_features(_assets(spark, sf_dir))))


#: Columns of a line read as a photo; the same text runs in Spark and in the oracle.
_PHOTO = {
    "claim_id": "concat('C', l_orderkey)", "file_id": "concat('p', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)", "ordinal": "l_linenumber", "decode_ok": "l_quantity <> 50", "decode_error": "case when l_quantity = 50 then 'truncated' end",
    "image_width": "cast(l_quantity * 40 as int)", "image_height": "800", "brightness_mean": "l_discount * 3000", "brightness_std": "l_tax * 1000", "blur_score": "l_quantity * 10", "perceptual_hash": "concat('h', l_linenumber % 3)",
}


#: What tells photos apart, as numbers: a file_id is null where one of its four numbers is.
_TOLD = {
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", **{n: f"case when l_orderkey is not null and l_linenumber is not null and l_partkey is not null and l_suppkey is not null then {n} end" for n in ("l_partkey", "l_suppkey")},
    "decode_ok": _PHOTO["decode_ok"], "image_width": _PHOTO["image_width"], "brightness_mean": _PHOTO["brightness_mean"], "brightness_std": _PHOTO["brightness_std"], "blur_score": _PHOTO["blur_score"],
}


def _told_apart(spark, sf_dir: str) -> DataFrame:
    """A row a photo, as numbers: lines are dealt out by order alone, once, so that what is sought within a claim is not sent."""
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} as {n}" for n, e in _TOLD.items())).repartition("l_orderkey").distinct()


def _named(told: DataFrame, *more: str) -> DataFrame:
    """The photos of ``_told_apart``, with what their metrics say."""
    made = {n: n if n in _TOLD else e for n, e in _PHOTO.items()} | {"decode_error": "case when not decode_ok then 'truncated' end"}
    lines = told.selectExpr(*(f"{e} as {n}" for n, e in made.items()), *more)
    return M.photo_quality(lines).withColumn("evidence_node_id", F.concat(F.lit("evidence:photo_quality:"), "file_id"))


def _photos(spark, sf_dir: str) -> DataFrame:
    return _named(_told_apart(spark, sf_dir))


def photo_quality(spark, sf_dir):
    return _photos(spark, sf_dir).select("file_id", F.array_join("issue_flags", ",").alias("issue_flags"), "quality_score", "needs_review")


def _packet(spark, sf_dir: str):
    """Photos are told apart by one exchange and stored as numbers, with the first file of copies: tasks, nodes and summaries
    read them up to ten times."""
    told = _told_apart(spark, sf_dir).selectExpr("*", *(f"{_PHOTO[n]} as {n}" for n in ("ordinal", "file_id", "perceptual_hash")))
    told = store(P.with_first(told, "l_orderkey").select(*_TOLD, "first_file_id"), "packet-photos").df
    photos = _named(told, "first_file_id").withColumn("needs_review", F.col("needs_review") | ~F.col("decode_ok"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("claim_id"), "o_orderkey")
    claims = orders.select("claim_id")
    forms = orders.where("o_orderkey % 4 = 0").select("claim_id", F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("file_id"), F.concat(F.lit('{"form":[{"id":1,"label":"question","text":" ","box":[0,0,5,9],"words":[{"text":"w"},{"text":"v"}]},{"label":"answer","text":"'), F.when(F.col("o_orderkey") % 8 == 0, "").otherwise("ok"), F.lit('","box":[3,3,3,4],"words":[]}]}')).alias("annotation_json"))
    files = photos.select("claim_id", "file_id", F.lit("image/jpeg").alias("media_type"), F.lit(True).alias("file_exists")).unionByName(forms.select("claim_id", "file_id", F.lit("image/png").alias("media_type"), F.lit(True).alias("file_exists")))
    return claims, files, photos, P.form_spans(forms), *_answers(photos)


def _answers(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a model said of every photo, and its runs: some failed, with and without a finding."""
    w = F.col("image_width") / 40
    damages = photos.where("image_width <> 1960").select(
        "claim_id", "file_id", F.concat(F.lit("evidence:photo_damage:"), "file_id").alias("evidence_node_id"), (w != 7).alias("vehicle_visible"), (w != 8).alias("target_vehicle_clear"),
        F.when(w < 10, 0.3).when(w < 20, 0.6).otherwise(0.9).alias("confidence"), F.when(w > 45, F.array(F.lit("blur"), F.lit("glare"))).otherwise(F.array().cast("array<string>")).alias("uncertainty_reasons"),
        ((w < 20) | (w > 45)).alias("needs_review"), F.lit("given").alias("model_provider"), F.lit("m").alias("model_name"), F.lit("p1").alias("prompt_version"),
    )
    status = F.when(w.isin(5, 49), "failed").otherwise("success")
    runs = photos.select("claim_id", "file_id", F.concat(F.lit("run:"), "file_id").alias("run_id"), status.alias("status"), F.when(status == "failed", "timeout").alias("error_code"), F.when(status == "failed", "late").alias("error_message"))
    return damages, runs


def form_spans(spark, sf_dir):
    """Every fourth order stands for a claim with a form, the others for claims without one; all orders are read."""
    return _packet(spark, sf_dir)[3].withColumn("bbox", F.array_join(F.col("bbox").cast("array<string>"), ","))


def _tasks(spark, sf_dir: str):
    claims, files, photos, spans, damages, runs = _packet(spark, sf_dir)
    return claims, files, photos, spans, damages, P.review_tasks(claims, files, photos, spans, damages, runs)


def review_tasks(spark, sf_dir):
    """All seven kinds, with what people are told."""
    claims, files, photos, spans, damages, runs = _packet(spark, sf_dir)
    return P.review_tasks(claims, files, photos, spans, damages, runs).select("claim_id", "task_id", "task_type", "priority", "source_file_id", "evidence_node_id", "status")


def review_reasons(spark, sf_dir):
    """The reasons of findings and runs that people see."""
    tasks = _tasks(spark, sf_dir)[-1].where("task_type in ('photo_damage_review', 'model_output_review', 'document_field_review')")
    return tasks.groupBy("task_type", "priority", "reason").agg(F.count("*").alias("tasks"))


def evidence_node_counts(spark, sf_dir):
    claims, files, photos, spans, damages, tasks = _tasks(spark, sf_dir)
    nodes = P.evidence_nodes(claims, files, photos, spans, tasks, damages)
    return nodes.groupBy("node_type", "created_by").agg(F.count("*").alias("nodes"), F.count_if("requires_human_confirmation").alias("to_confirm"))


def claim_summary(spark, sf_dir):
    claims, files, photos, spans, _, tasks = _tasks(spark, sf_dir)
    return P.claim_summary(claims, files, photos, spans, tasks)


def photo_quality_means(spark, sf_dir):
    """The profile that takes the mean of four scores; some photos did not decode."""
    q = F.col("l_quantity")
    photos = table(spark, sf_dir, "lineitem").select(
        (q * 40).cast("int").alias("width"), F.lit(800).alias("height"), (F.col("l_discount") * 10).alias("brightness"), (q * 1.0).alias("contrast"), (F.col("l_tax") * 50).alias("sharpness"), F.when(q == 50, "OSError").alias("error_type"),
    )
    json = lambda name: F.get_json_object("photo_quality_json", f"$.{name}")
    rows = M.photo_quality_means(photos).select(json("status").alias("status"), json("photo_usable").alias("usable"), json("quality_reasons").alias("reasons"), json("quality_score").cast("double").alias("score"))
    return rows.groupBy("status", "usable", "reasons").agg(F.count("*").alias("photos"), F.round(F.avg("score"), 4).alias("mean_score"))


def html_blocks(spark, sf_dir):
    return H.page_blocks(table(spark, sf_dir, "pages", spread=True))


def html_block_ids(spark, sf_dir):
    """The first block of each page with the id of a captured page's block."""
    rows = H.page_blocks(table(spark, sf_dir, "pages", spread=True)).where("block_index = 0")
    return rows.select("page_id", H.block_ids(F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.col("block_index")).alias("doc_id"))


def page_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(H.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


_ASSETS = f"""with a as (select doc_id::varchar as record_id, case doc_id % 2 when 0 then 'text' else 'document' end as modality, case when doc_id % 10 = 0 then '' else source end as license_id, '' as svg, text, 0 as w from documents
union all select 'img-' || doc_id, 'image', case when doc_id % 10 = 0 then '' else source end, '<svg xmlns="http://www.w3.org/2000/svg" width="' || (doc_id % 700 + 300) || 'px" height="800"/>', '', doc_id % 700 + 300 from documents),
b as (select *, case when modality = 'image' then svg else text end as raw, len(regexp_extract_all(case when modality = 'image' then '' else text end, '[a-zA-Z0-9_]+'))::bigint as token_count from a),
c as (select *, modality = 'text' and token_count < {M.MIN_TOKENS} as short, modality = 'document' and trim(regexp_replace(text, '\\s+', '', 'g')) = '' as bare, modality = 'image' and w < {M.MIN_SIDE} as low, license_id = '' as nolic from b),
d as (select *, round(greatest(0, (case when short then 0.6 when bare then 0.0 when low then 0.5 else 1.0 end)::double - case when nolic then {M.LICENSE_PENALTY} else 0 end), 3) as quality_score, concat_ws(',', case when short then 'text_too_short' end, case when bare then 'empty_document' end, case when low then 'low_resolution' end, case when nolic then 'missing_license' end) as risk_flags from c),
r as (select record_id, modality, license_id, sha256(raw) as content_sha256, strlen(raw) as byte_size, token_count, case when modality = 'image' then w end as width, case when modality = 'image' then 800 end as height, quality_score, risk_flags, case when risk_flags = '' and quality_score >= {M.ACCEPT} then 'accepted' else 'rejected' end as decision from d) """
_PHOTOS = f"""with p as (select distinct {", ".join(f"{e} as {n}" for n, e in _PHOTO.items())} from lineitem),
q as materialized (select * replace (case when decode_ok then issue_flags else 'decode_error' end as issue_flags, case when decode_ok then quality_score else 0.0 end as quality_score) from (select *, concat_ws(',', {", ".join(f"case when {rule} then '{name}' end" for name, rule, _ in M.PHOTO_RULES)}) as issue_flags, round(greatest(0, 1 - {" - ".join(f"(case when {rule} then {price} else 0 end)::double" for _, rule, price in M.PHOTO_RULES)}), 6) as quality_score from p)),
r as materialized (select *, quality_score < 0.6 or issue_flags <> '' as flagged, quality_score < 0.6 or issue_flags <> '' or not decode_ok as needs_review, row_number() over (partition by claim_id, perceptual_hash, decode_ok order by ordinal, file_id) as place from q),
spans as materialized (select 'C' || o_orderkey as claim_id, 'd' || o_orderkey as file_id, unnest([1, 2]) as k, o_orderkey % 8 = 0 as bare from orders where o_orderkey % 4 = 0),
s as materialized (select claim_id, file_id, case k when 1 then 'question_1' else 'answer_1' end as field_name, case when k = 1 then 'w v' when bare then '' else 'ok' end as field_value, case k when 1 then 'question' else 'answer' end as field_type, case k when 1 then '0.0,0.0,5.0,9.0' else '3.0,3.0,3.0,4.0' end as bbox, k = 1 as valid_bbox, 'evidence:document_span:' || file_id || ':1' as evidence_node_id, k = 2 as needs_review from spans),
dam as materialized (select claim_id, file_id, image_width / 40 as w from r),
lacks as (select 'C' || o_orderkey as claim_id from orders o where o_orderkey % 4 <> 0 or not exists (select 1 from lineitem where l_orderkey = o_orderkey)),
t as materialized (select claim_id, 'task:photo_decode_review:' || file_id as task_id, 'photo_decode_review' as task_type, 'high' as priority, file_id as source_file_id, 'evidence:photo_quality:' || file_id as evidence_node_id, 'open' as status from r where not decode_ok
union all select claim_id, 'task:photo_quality_review:' || file_id, 'photo_quality_review', case when quality_score < 0.4 then 'high' else 'medium' end, file_id, 'evidence:photo_quality:' || file_id, 'open' from r where decode_ok and needs_review
union all select claim_id, 'task:duplicate_photo_review:' || file_id, 'duplicate_photo_review', 'medium', file_id, 'evidence:photo_quality:' || file_id, 'open' from r where decode_ok and place > 1
union all select claim_id, 'task:document_field_review:' || evidence_node_id, 'document_field_review', 'medium', file_id, evidence_node_id, 'open' from s where needs_review
union all select claim_id, 'task:model_output_review:run:' || file_id, 'model_output_review', 'high', file_id, 'evidence:' || case when w = 49 then 'photo_quality' else 'photo_damage' end || ':' || file_id, 'open' from dam where w in (5, 49)
union all select claim_id, 'task:photo_damage_review:' || file_id, 'photo_damage_review', case when w = 7 or w < 10 then 'high' else 'medium' end, file_id, 'evidence:photo_damage:' || file_id, 'open' from dam where w not in (5, 49) and (w < 20 or w > 45)
union all select claim_id, 'task:missing_material_review:' || claim_id, 'missing_material_review', 'high', null, 'evidence:claim:' || claim_id, 'open' from lacks),
files as materialized (select claim_id, file_id from r union all select distinct claim_id, file_id from s) """
QUERIES = {
    "asset_release": asset_release, "asset_release_summary": asset_release_summary, "photo_quality": photo_quality, "photo_quality_means": photo_quality_means, "html_block_ids": html_block_ids, "packet_form_spans": form_spans, "packet_review_tasks": review_tasks, "packet_review_reasons": review_reasons, "packet_node_counts": evidence_node_counts,
    "packet_claim_summary": claim_summary, "html_blocks": html_blocks, "page_domains": page_domains,
}
ORACLES = {
    "photo_quality_means": """with p as (select (l_quantity * 40)::int as w, 800 as h, l_discount * 10 as b, l_quantity * 1.0 as c, l_tax * 50 as s, l_quantity = 50 as broken from lineitem),
q as (select *, (least(1, w / 1280, h / 960) + greatest(0, 1 - abs(b - 0.5) / 0.5) + least(1, c / 40) + least(1, s / 8)) / 4 as score from p),
r as (select *, '[' || concat_ws(',', case when w < 640 or h < 480 then '"resolution_too_low"' end, case when b < 0.1 then '"too_dark"' when b > 0.95 then '"too_bright"' end, case when c < 10 then '"low_contrast"' end, case when s < 1.5 then '"low_detail"' end, case when score < 0.4 then '"quality_score_below_threshold"' end) || ']' as why from q)
select case when broken then 'decode_error' else 'success' end as status, case when broken then 'false' else (why = '[]')::varchar end as usable, case when broken then '["image_decode_failed"]' else why end as reasons, count(*) as photos, round(avg(case when broken then 0 else round(score, 4) end), 4) as mean_score from r group by 1, 2, 3""",

    "asset_release": _ASSETS + "select * from r",
    "asset_release_summary": _ASSETS + "select modality, count(*) as raw_assets, count(*) filter (decision = 'accepted') as released_assets, count(*) filter (decision = 'rejected') as rejected_assets, round(avg(quality_score), 3) as average_quality, sum(byte_size)::bigint as total_bytes from r group by 1",
    "photo_quality": _PHOTOS + "select file_id, issue_flags, quality_score, flagged as needs_review from r",
    "packet_form_spans": _PHOTOS + "select * from s",
    "packet_review_tasks": _PHOTOS + "select * from t",
    "packet_review_reasons": _PHOTOS
    + """, x as (select 'model_output_review' as task_type, 'high' as priority, 'image model status=failed; error=timeout: late' as reason from dam where w in (5, 49)
union all select 'document_field_review', 'medium', case when field_value = '' then 'empty field value; invalid bbox' else 'invalid bbox' end from s where needs_review
union all select 'photo_damage_review', case when w < 10 then 'high' else 'medium' end, concat_ws('; ', case when w = 7 then 'vehicle not visible' end, case when w = 8 then 'target vehicle unclear' end, case when w < 10 then 'low confidence 0.30' when w < 20 then 'low confidence 0.60' end, case when w > 45 then 'uncertainty=blur,glare' end)
  from dam where w not in (5, 49) and (w < 20 or w > 45)) select task_type, priority, reason, count(*) as tasks from x group by all""",
    "packet_node_counts": _PHOTOS
    + """select 'claim' as node_type, 'manifest' as created_by, count(*) as nodes, 0 as to_confirm from orders union all select 'file', 'manifest', count(*), 0 from files union all select 'photo_quality', 'rule:photo_quality_v2', count(*), count(*) filter (needs_review) from r
union all select 'photo_damage', 'model:given:m:p1', count(*), count(*) from dam where w <> 49 union all select 'document_span', 'gold_annotation:funsd', count(*), count(*) filter (needs_review) from s union all select 'review_task', 'rule:review_task_v1', count(*), count(*) from t""",
    "packet_claim_summary": _PHOTOS
    + """select claim_id, coalesce(a, 0) as file_count, coalesce(b, 0) as photo_count, coalesce(c, 0) as photos_to_review, coalesce(d, 0) as span_count, coalesce(e, 0) as open_task_count, coalesce(f, 0) as high_priority_count from (select 'C' || o_orderkey as claim_id from orders)
left join (select claim_id, count(*) as a from files group by 1) using (claim_id) left join (select claim_id, count(*) as b, count(*) filter (needs_review) as c from r group by 1) using (claim_id) left join (select claim_id, count(*) as d from s group by 1) using (claim_id) left join (select claim_id, count(*) as e, count(*) filter (priority = 'high') as f from t group by 1) using (claim_id)""",
    "page_domains": "select regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '\\.+$', ''), '^www\\.', '') as domain, count(*) as pages from pages group by 1",
}
