"""Call audit, intents and evaluation over ``conversations``, ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import media as M
from cairn.operators import calls as A
from cairn.operators import evaluation as V
from cairn.session import table

INTENTS = {"handover": ["the", "with"], "article": ["die", "der"], "request": ["les", "que"], "greeting": ["los", "el"]}
QUEUES = {"handover": "north", "article": "north", "request": "south", "greeting": "south"}
CONFIG = {"asr_model": "given", "analysis_model": "given", "report_date": "2026-01-01"}


def _little(value, width: int):
    """Bytes of a number, least first."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width)))))


def _calls(spark, sf_dir: str) -> DataFrame:
    """Every turn is a recorded message: its text is what was said, its length how long it took."""
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    return turns.select(F.concat_ws("-", F.lit("call"), "conv_id", "turn").alias("call_id"), "role", text.alias("said"), F.char_length(text).alias("n"))


def _recordings(calls: DataFrame) -> DataFrame:
    """Headers of WAV files of 8-bit sound: 400 frames a second and 40 a character; some without a rate, some cut off."""
    rate = F.when(F.col("n") % 17 == 0, 0).otherwise(400)
    size = F.col("n").cast("bigint") * 40
    part = lambda text: F.lit(text).cast("binary")
    header = F.concat(
        part("RIFF"), _little(size + 36, 4), part("WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(1), 2),
        _little(rate, 4), _little(rate, 4), _little(F.lit(1), 2), _little(F.lit(8), 2), part("data"), _little(size, 4),
    )
    return calls.withColumn("content", F.when(F.col("n") % 19 == 0, F.substring(header, 1, 20)).otherwise(header))


def call_audit_report(spark, sf_dir):
    calls = _recordings(_calls(spark, sf_dir)).withColumn("audio_probe_json", A.audio_gate(M.wav_headers("content")))
    probes = calls.select("call_id", F.sha2("said", 256).alias("object_sha256"), "audio_probe_json")
    usable = F.coalesce(F.get_json_object("audio_probe_json", "$.audio_usable") == "true", F.lit(False))
    heard = calls.where("trim(said) <> ''").select("call_id", A.transcribed(F.col("said"), F.lit("en"), usable, "given", "given").alias("transcript_json"))
    field = lambda name: F.get_json_object("transcript_json", f"$.{name}")
    heard = heard.withColumn("transcript_quality_json", A.transcript_gate(field("text"), field("language_probability").cast("double"), field("status"), 40))
    answer = F.to_json(F.struct(F.when(F.col("n") % 7 == 0, "invalid_response").otherwise("success").alias("status"), F.lit("billing").alias("problem_category"), F.lit("negative").alias("customer_sentiment"), F.lit(-0.5).alias("sentiment_score"), F.array(F.lit("late")).alias("key_issues"), F.lit(0.8).alias("confidence")))
    told = calls.where("role = 'user'").select("call_id", answer.alias("analysis_json"))
    return A.call_audit_report(calls.select("call_id"), probes, heard, told, CONFIG)


def call_disposition_counts(spark, sf_dir):
    return call_audit_report(spark, sf_dir).groupBy("review_disposition").agg(F.count("*").alias("calls"), F.count_if("requires_followup").alias("followups"))


def intent_macro_f1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True)
    actual = F.when(F.col("lang") == "en", "handover").when(F.col("lang") == "de", "article").when(F.col("lang") == "fr", "request").when(F.col("lang") == "es", "greeting")
    rows = docs.select(actual.alias("actual"), V.keyword_intent(F.col("text"), INTENTS).alias("predicted"))
    scores = V.macro_scores(rows, [*INTENTS, "never_seen"], queues=QUEUES)
    return scores.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "queue_accuracy")), "records")


def intent_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents", spread=True).groupBy(V.keyword_intent(F.col("text"), INTENTS).alias("intent")).agg(F.count("*").alias("documents"))


def transcript_problems(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.coalesce(V.transcript_problem(F.col("text")), F.lit("none")).alias("problem"), "role").agg(F.count("*").alias("turns"))


def quality_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").contains("%%%").alias("marked")), "doc_id")
    found = V.confusion(rows, ~F.col("marked"), F.col("quality") == 1, "lang")
    return found.select("lang", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def set_overlap_eval(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    told = F.array_compact(F.array(*[F.when(F.lower("text").contains(w), w) for w in ("idiot", "trash", "scum")]))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(told.alias("predicted"), F.when(F.col("toxic") == 1, F.array(F.lit("idiot"), F.lit("scum"))).otherwise(F.array().cast("array<string>")).alias("actual"))
    found = V.set_overlap(rows, "predicted", "actual")
    return found.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_REPORT = """with c as (select concat_ws('-', 'call', conv_id, turn) as call_id, role, coalesce(text, '') as said, length(coalesce(text, '')) as n from conversations),
r as (select *, n % 19 = 0 as cut, n % 17 = 0 as rateless, n * 40 / 400 as d, trim(said) <> '' as heard, role = 'user' as told from c),
s as (select *, not cut and not rateless as sound, not cut and not rateless and d between 1 and 900 as audio, case when not told then 'no_analysis' when n % 7 = 0 then 'invalid_response' else 'success' end as st from r),
t as (select *, case when audio then trim(said) else '' end as words from s),
u as (select *, heard and audio and length(words) >= 40 as fine from t),
report as (select call_id, sha256(said) as object_sha256, case when sound then 'success' else 'decode_error' end as probe_status, audio as audio_usable, case when sound then round(d, 4) end as duration_seconds, case when sound then 1 end as channels, case when sound then 400 end as sample_rate,
  case when not sound then '[]' when d < 1 then '["audio_too_short"]' when d > 900 then '["audio_too_long"]' else '[]' end as quality_reasons_json, case when not heard then 'not_transcribed' when audio then 'success' else 'unusable_audio' end as asr_status,
  case when heard then words else '' end as transcript_text, fine as transcript_usable, case when heard then length(words)::int end as text_length, case when heard then audio::int::double end as language_confidence,
  case when not heard then '[]' else '[' || concat_ws(',', case when not audio then '"asr_unsuccessful"' end, case when length(words) < 40 then '"transcript_too_short"' end) || ']' end as transcript_failure_reasons_json,
  st as analysis_status, case when told then 'billing' else 'other' end as problem_category, case when told then 'negative' else 'neutral' end as customer_sentiment, case when told then -0.5 else 0.0 end::double as sentiment_score, 'medium' as urgency, case when told then '["late"]' else '[]' end as key_issues_json,
  '' as customer_request, 'not_applicable' as resolution_status, true as requires_followup, 'unknown' as agent_attitude, '' as summary, '[]' as uncertainty_reasons_json, case when told then 0.8 else 0.0 end::double as confidence,
  case when not audio then 'review_unusable_audio' when not fine then 'review_low_quality_transcript' when st <> 'success' then 'review_invalid_analysis' else 'audited' end as review_disposition, 'given' as asr_model, 'given' as analysis_model, '2026-01-01' as report_date from u) """
_BARE = "regexp_replace(lower(coalesce(text, '')), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')"
_HITS = ", ".join(f"({' + '.join(f'contains(bare, {chr(39)}{w}{chr(39)})::int' for w in words)}) as h{i}" for i, words in enumerate(INTENTS.values()))
_PICK = "case " + " ".join(f"when h{i} > 0 and h{i} > greatest({', '.join(f'h{k}' for k in range(len(INTENTS)) if k != i)}) then '{name}'" for i, name in enumerate(INTENTS)) + " else 'other' end"
_INTENT = f"with b as (select lang, {_BARE} as bare from documents), h as (select case lang when 'en' then 'handover' when 'de' then 'article' when 'fr' then 'request' when 'es' then 'greeting' end as actual, {_HITS} from b), p as (select actual, {_PICK} as predicted from h)"
_QUEUE = lambda c: "case " + c + " " + " ".join(f"when '{k}' then '{v}'" for k, v in QUEUES.items()) + f" else {c} end"
_RATE = "round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) as f1"
QUERIES = {
    "call_audit_report": call_audit_report, "call_disposition_counts": call_disposition_counts, "intent_macro_f1": intent_macro_f1, "intent_counts": intent_counts, "transcript_problems": transcript_problems,
    "quality_confusion": quality_confusion, "set_overlap_eval": set_overlap_eval,
}
ORACLES = {
    "call_audit_report": _REPORT + "select * from report",
    "call_disposition_counts": _REPORT + "select review_disposition, count(*) as calls, count(*) filter (requires_followup) as followups from report group by 1",
    "intent_macro_f1": _INTENT
    + f""", l(label) as (values {", ".join(f"('{x}')" for x in [*INTENTS, "never_seen"])}), f as (select label, coalesce(2 * count(*) filter (actual = label and predicted = label) / nullif(count(*) filter (actual = label) + count(*) filter (predicted = label), 0), 0) as f1 from l, p group by 1)
select (select round(avg(coalesce((predicted = actual)::int, 0)), 6) from p) as accuracy, (select round(avg(f1), 6) from f) as macro_f1, (select round(avg(coalesce(({_QUEUE("predicted")} = {_QUEUE("actual")})::int, 0)), 6) from p) as queue_accuracy, (select count(*) from p) as records""",
    "intent_counts": _INTENT + "select predicted as intent, count(*) as documents from p group by 1",
    "quality_confusion": f"with r as (select lang, not contains(text, '%%%') as p, quality = 1 as a from labels join documents using (doc_id)), c as (select lang, count(*) filter (p and a) as tp, count(*) filter (p and not a) as fp, count(*) filter (not p and a) as fn, count(*) filter (not p and not a) as tn from r group by 1) select *, {_RATE} from c",
    "set_overlap_eval": f"with r as (select regexp_matches(lower(text), 'idiot|scum') as core, regexp_matches(lower(text), 'idiot|scum|trash') as p, toxic = 1 as a from documents join labels using (doc_id)), c as (select count(*) filter (core and a) as tp, count(*) filter (not (core and a) and p) as fp, count(*) filter (not (core and a) and a) as fn, count(*) filter (not p and not a) as tn from r) select *, {_RATE} from c",
}
