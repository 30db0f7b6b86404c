"""The small relations between the stages of the staged pipelines: run settings, and what goes into and out of each
kernel, bound by identity. Each is a projection or a join on unique keys; the settings are one row, broadcast."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings of a run of the claims and of the call pipeline, with their types; fixed values.
CLAIM_SETTINGS = (
    "runtime_config_version int, run_started_at timestamp, ocr_engine string, ocr_device string, required_fields_json string, "
    "minimum_text_confidence double, ai_provider string, ai_model string, minio_bucket string"
)
CALL_SETTINGS = (
    "runtime_config_version int, run_started_at string, asr_engine string, asr_model string, asr_language string, "
    "min_text_chars int, ai_provider string, ai_model string, minio_bucket string"
)
#: Parts of names that a setting which is shown must not have.
SECRET = re.compile(r"secret|password|token|api_key|access_key|credential", re.IGNORECASE)


def run_config(settings: DataFrame, schema: str) -> DataFrame:
    """The one row of a run's settings, of the given columns and types, from a table of (name, value) rows.

    Settings that the table lacks are null, others are left out, and a schema that would show a secret is refused. A name
    with two different values fails the query.
    """
    shown = [part.strip().split() for part in schema.split(",")]
    secret = [name for name, _ in shown if SECRET.search(name)]
    if secret:
        raise ValueError(f"settings must not hold secrets: {', '.join(secret)}")

    def value(name: str) -> Column:
        of = F.when(F.col("name") == name, F.col("value").cast("string"))
        return F.when(F.min(of) == F.max(of), F.min(of)).when(F.min(of).isNotNull(), F.raise_error(F.lit(f"the setting {name} has two values")).cast("string"))

    return settings.agg(*(value(name).cast(kind).alias(name) for name, kind in shown))


def with_config(rows: DataFrame, config: DataFrame, *columns: str) -> DataFrame:
    """Rows beside settings of the run: a cross join with one row."""
    return rows.crossJoin(F.broadcast(config.select(*columns)))


# --- claims ------------------------------------------------------------------------------------------------------


def claim_material_inputs(materials: DataFrame, config: DataFrame) -> DataFrame:
    """Materials and whether their locator may be read: a trusted path of a supported role in the run's own bucket."""
    mine = F.col("supported") & F.col("locator_valid") & (F.col("bucket") == F.col("minio_bucket"))
    return with_config(materials, config, "minio_bucket").withColumn("runtime_locator_valid", F.coalesce(mine, F.lit(False)))


def readable(inputs: DataFrame, objects: DataFrame) -> DataFrame:
    """(claim_id, material_index, object_exists, sha256) of what may be read: trusted locators beside listed objects."""
    trusted = inputs.where("runtime_locator_valid").select("claim_id", "material_index", "bucket", "object_key")
    found = trusted.join(objects.select("bucket", "object_key", "sha256", F.lit(True).alias("there")), ["bucket", "object_key"], "left")
    return found.select("claim_id", "material_index", F.coalesce("there", F.lit(False)).alias("object_exists"), "sha256")


def is_judged() -> Column:
    """Whether a row of object facts goes on to be judged: damage photos that are there, of the one type that is decoded."""
    return F.coalesce(F.expr("object_exists and role = 'damage_photo' and media_type = 'image/jpeg'"), F.lit(False))


def photos_to_judge(object_facts: DataFrame) -> DataFrame:
    return object_facts.where(is_judged())


def document_quality_inputs(ocr: DataFrame, fields: DataFrame, config: DataFrame) -> DataFrame:
    """What was read of a document and found in it, the claim's own number, and the run's thresholds."""
    rows = ocr.join(fields, ["claim_id", "material_index"]).withColumn("claim_id_text", F.col("claim_id").cast("string"))
    return with_config(rows, config, "required_fields_json", "minimum_text_confidence").withColumnRenamed("required_fields_json", "required_fields_text")


#: Photos of a claim as its facts list them.
_PHOTOS = "array<struct<file_order:string,file_id:string,sha256:string,photo_quality:string>>"


def damage_validation_inputs(facts: DataFrame, responses: DataFrame) -> DataFrame:
    """Every photo that a model was asked about with its answer, if there is one for just this file and content.

    ``facts`` has claim_id, model_input_usable and usable_photo_inputs_json.
    """
    listed = facts.where("model_input_usable").select("claim_id", F.explode(F.from_json("usable_photo_inputs_json", _PHOTOS)).alias("p"))
    photos = listed.select(
        "claim_id", F.col("p.file_order").try_cast("int").alias("file_order"), "p.file_id", F.col("p.sha256").alias("photo_sha256"),
        F.col("p.photo_quality").alias("photo_quality_json"),
    )
    return photos.join(responses.select("claim_id", "file_id", "photo_sha256", "raw_damage_response"), ["claim_id", "file_id", "photo_sha256"], "left")


# --- score audit -------------------------------------------------------------------------------------------------


def evidence_images(evidence: DataFrame) -> DataFrame:
    """Evidence of the one type that is read."""
    texts = ("project_id", "file_id", "role", "bucket", "object_key", "media_type")
    return evidence.where("media_type = 'image/png'").select(*(F.col(c).cast("string").alias(c) for c in texts))


def evidence_ocr(read: DataFrame) -> DataFrame:
    """Typed fields of what was read, the whole answer kept beside them."""
    field = lambda path: F.get_json_object("ocr_json", f"$.{path}")
    return read.withColumns({
        "ocr_status": field("status"), "ocr_text": field("full_text"), "ocr_confidence": field("mean_confidence").cast("double"), "ocr_text_line_count": field("text_line_count").cast("int"),
    })


def conflict_validation_inputs(answers: DataFrame, images: DataFrame) -> DataFrame:
    """Answers of a model bound to the role that the evidence is trusted to have, never to one that they name."""
    return answers.select("project_id", "file_id", F.col("raw_response").cast("string")).join(images.select("project_id", "file_id", "role"), ["project_id", "file_id"])


# --- calls -------------------------------------------------------------------------------------------------------


def call_inputs(calls: DataFrame) -> DataFrame:
    return calls.select("call_id", "bucket", "object_key")


def call_transcripts(facts: DataFrame, transcript: Column) -> DataFrame:
    """Transcripts of the recordings that can be used; the others are never sent to a recogniser."""
    return facts.where("audio_usable").select("call_id", "object_key", "object_sha256", "duration_seconds", transcript.alias("transcript_json"))


def analysis_validation_inputs(answers: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Answers of a model beside the hash of the recording that they are about."""
    return answers.select("call_id", "raw_analysis_response").join(transcripts.select("call_id", "object_sha256"), "call_id")


# --- near-duplicate web text -------------------------------------------------------------------------------------


def bucket_members(bands: DataFrame, docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(band, key, member_count, member_doc_ids, member_domains, pair_slots) of shared buckets.

    Members are listed because the audit shows them: a row is as long as its bucket, and no pair is made.
    """
    rows = bands.join(docs.select("doc_id", "domain"), "doc_id").join(buckets.select("band", "key", "pair_slots"), ["band", "key"])
    return rows.groupBy("band", "key", "pair_slots").agg(
        F.countDistinct("doc_id").alias("member_count"), F.array_sort(F.collect_set("doc_id")).alias("member_doc_ids"), F.array_sort(F.collect_set("domain")).alias("member_domains"),
    )


def source_summary(blocks: DataFrame) -> DataFrame:
    """One row: text blocks, distinct records, captures, domains and targets, first and last day of capture."""
    named = lambda c: F.countDistinct(F.nullif(F.col(c), F.lit("")))
    return blocks.agg(
        F.count("*").alias("text_block_rows"), named("record_id").alias("warc_record_rows"), named("capture_url").alias("capture_url_rows"), F.countDistinct("domain").alias("domain_rows"),
        named("target_url").alias("target_url_rows"), F.min("crawled_at").alias("earliest_capture_date"), F.max("crawled_at").alias("latest_capture_date"),
    )


def checked_bands(prints: DataFrame, bands: DataFrame, per_text: int) -> DataFrame:
    """``bands``, once there are just ``per_text`` of them for each text with shingles; fails otherwise."""
    wanted = prints.agg(F.count_if(F.size("shingles") > 0)).first()[0] * per_text
    found = bands.count()
    if found != wanted:
        raise RuntimeError(f"band expansion violated its row-count invariant: expected {wanted}, got {found}")
    return bands
