"""Call audit: probe, transcript and analysis facts from JSON, and one report row a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _get(column: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_cast(get_json_object({column}, '$.{path}') as {kind})")


def call_facts(probes: DataFrame) -> DataFrame:
    """(call_id, object_sha256, audio_probe_json) typed; a call without a clear verdict is not usable."""
    return probes.select(
        "call_id", "object_sha256", _get("audio_probe_json", "status").alias("probe_status"), F.coalesce(_get("audio_probe_json", "audio_usable", "boolean"), F.lit(False)).alias("audio_usable"),
        _get("audio_probe_json", "duration_seconds", "double").alias("duration_seconds"), _get("audio_probe_json", "channels", "int").alias("channels"), _get("audio_probe_json", "sample_rate", "int").alias("sample_rate"),
        F.coalesce(_get("audio_probe_json", "quality_reasons"), F.lit("[]")).alias("quality_reasons_json"),
    )


def transcript_facts(transcripts: DataFrame) -> DataFrame:
    """(call_id, transcript_json, transcript_quality_json) typed."""
    t, q = "transcript_json", "transcript_quality_json"
    return transcripts.select(
        "call_id", F.trim(F.coalesce(_get(t, "text"), F.lit(""))).alias("transcript_text"), F.coalesce(_get(t, "status"), F.lit("unknown")).alias("asr_status"), F.coalesce(_get(q, "transcript_usable", "boolean"), F.lit(False)).alias("transcript_usable"),
        _get(q, "text_length", "int").alias("text_length"), _get(q, "language_confidence", "double").alias("language_confidence"), F.coalesce(_get(q, "failure_reasons"), F.lit("[]")).alias("transcript_failure_reasons_json"),
    )


#: What a report says where no analysis is trusted; fixed values.
ABSENT = {
    "analysis_status": "no_analysis", "problem_category": "other", "customer_sentiment": "neutral", "sentiment_score": 0.0, "urgency": "medium", "key_issues_json": "[]", "customer_request": "", "resolution_status": "not_applicable",
    "requires_followup": True, "agent_attitude": "unknown", "summary": "", "uncertainty_reasons_json": "[]", "confidence": 0.0,
}


def analysis_facts(analyses: DataFrame) -> DataFrame:
    """(call_id, analysis_json) typed; invalid answers keep their status."""
    j, kinds = "analysis_json", {float: "double", bool: "boolean", str: "string"}
    path = {"analysis_status": "status", "key_issues_json": "key_issues", "uncertainty_reasons_json": "uncertainty_reasons"}
    return analyses.select("call_id", *(_get(j, path.get(name, name), kinds[type(value)]).alias(name) for name, value in ABSENT.items()))


def call_audit_report(calls: DataFrame, probes: DataFrame, transcripts: DataFrame, analyses: DataFrame, config: dict[str, str] | None = None) -> DataFrame:
    """One row a call, whatever is known of it, and why it needs review: left joins by call, defaults where nothing is trusted.

    ``config`` holds what the run was made with (engine, models, ...): one column each, the same in every row.
    """
    rows = calls.join(call_facts(probes), "call_id", "left").join(transcript_facts(transcripts), "call_id", "left").join(analysis_facts(analyses), "call_id", "left")
    defaults = {"asr_status": "not_transcribed", "transcript_text": "", "transcript_usable": False, "transcript_failure_reasons_json": "[]"} | ABSENT
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    verdict = F.when(~F.coalesce("audio_usable", F.lit(False)), "review_unusable_audio").when(~F.col("transcript_usable"), "review_low_quality_transcript").when(F.col("analysis_status") != "success", "review_invalid_analysis").otherwise("audited")
    return rows.withColumns({"review_disposition": verdict} | {c: F.lit(v) for c, v in (config or {}).items()})


def transcript_gate(text: Column, confidence: Column, status: Column, shortest: int = 10) -> Column:
    """The transcript quality object as JSON: usable if the recogniser succeeded and the text is long enough.

    The confidence in the language is reported and decides nothing.
    """
    length = F.char_length(F.trim(F.coalesce(text, F.lit(""))))
    heard = F.coalesce(status, F.lit("unknown"))
    reasons = F.array_compact(F.array(F.when(heard != "success", "asr_unsuccessful"), F.when(length < shortest, "transcript_too_short")))
    return F.to_json(F.struct(
        (F.size(reasons) == 0).alias("transcript_usable"), heard.alias("asr_status"), length.alias("text_length"), F.lit(shortest).alias("min_text_chars"),
        F.round(F.coalesce(confidence, F.lit(0.0)), 4).alias("language_confidence"), reasons.alias("failure_reasons"),
    ))


def audio_gate(header: Column, shortest: float = 1.0, longest: float = 900.0) -> Column:
    """The probe object as JSON, of a struct as ``media.wav_headers`` gives it: usable between two lengths in seconds."""
    seconds = header["frame_count"] / header["sample_rate"]
    reasons = F.array_compact(F.array(F.when(seconds < shortest, "audio_too_short"), F.when(seconds > longest, "audio_too_long")))
    broken = F.to_json(F.struct(F.lit("decode_error").alias("status"), F.lit(False).alias("audio_usable"), header["error"].alias("error_type")))
    sound = F.to_json(F.struct(
        F.lit("success").alias("status"), *(header[c].alias(c) for c in ("channels", "sample_rate", "sample_width_bytes", "frame_count")),
        F.round(seconds, 4).alias("duration_seconds"), (F.size(reasons) == 0).alias("audio_usable"), reasons.alias("quality_reasons"),
    ))
    return F.when(header["error"].isNotNull(), broken).otherwise(sound)


def transcribed(text: Column, language: Column, usable: Column, engine: str, model: str) -> Column:
    """The transcript object as JSON; a recording that is not usable is never heard."""
    heard = lambda value, none: F.when(usable, value).otherwise(none)
    said = F.trim(F.coalesce(text, F.lit("")))
    return F.to_json(F.struct(
        heard("success", "unusable_audio").alias("status"), heard(said, "").alias("text"), heard(F.coalesce(language, F.lit("")), "").alias("language"),
        heard(F.when(F.coalesce(language, F.lit("")) != "", 1.0).otherwise(0.0), 0.0).alias("language_probability"),
        heard((said != "").cast("int"), 0).alias("segment_count"), F.lit(engine).alias("engine"), F.lit(model).alias("model"),
    ))
