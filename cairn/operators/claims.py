"""Claims: materials validated, facts gathered, model results classified, rules ranked, dispositions given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Supported roles: media type, folder of the canonical path, extension; fixed values.
ROLES = {"damage_photo": ("image/jpeg", "photos", "jpg"), "supporting_document": ("image/png", "documents", "png")}
#: Parts and kinds of damage that say nothing, and severities by weight; fixed values.
MEANINGLESS = ("", "unknown", "none", "none_visible", "no_damage")
SEVERITY = {"total_loss": 5, "severe": 4, "moderate": 3, "minor": 2, "none": 1}
#: From which confidence a finding counts, below which a photo is asked for anew, and the least score of a photo.
MIN_CONFIDENCE, CONFIDENCE_FLOOR, MIN_PHOTO_SCORE = 0.80, 0.40, 0.40
#: Dispositions by priority: name, confidence, reason, action; fixed values.
OUTCOMES = {
    "request_more_materials": ("0.95", "We need additional or clearer materials before we can continue reviewing this claim.", "Request replacement or additional materials from the claimant."),
    "manual_review": ("0.75", "The submitted materials are present, but the claim needs adjuster review due to uncertainty, inconsistency, or risk.", "Assign the claim to a claims adjuster with the supporting evidence and review tasks."),
    "deny_claim": ("0.88", "The submitted materials were reviewed, but they do not show payable vehicle damage for this claim.", "Prepare denial review and customer communication according to applicable policy and regulatory requirements."),
    "approve_for_payment": ("0.90", "The claim packet is complete and supports a low-risk payable vehicle damage claim.", "Proceed to payment or repair settlement workflow."),
}
#: Signals and the reason codes they give, the first that holds first; fixed values.
REASONS = (
    ("bad_material", "model_input_unusable"), ("no_photo", "missing_required_photo"), ("no_document", "missing_required_document"), ("photo_unreadable", "photo_unreadable"), ("photo_poor", "photo_quality_too_low"),
    ("document_unreadable", "document_field_unreadable"), ("input_unusable", "model_input_unusable"), ("output_failed", "model_output_failed"), ("model_uncertain", "damage_model_uncertain"), ("vehicle_hidden", "vehicle_not_visible"),
    ("target_unclear", "target_vehicle_unclear"), ("damage_uncertain", "damage_model_uncertain"), ("severe_risk", "high_severity_or_total_loss_risk"), ("deny", "no_visible_vehicle_damage"), ("approve", "clear_low_risk_damage"),
)

_MATERIAL = "array<struct<file_id:string,file_order:string,role:string,media_type:string,bucket:string,object_key:string>>"


def _any(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)


def _all(*flags: Column) -> Column:
    return reduce(lambda a, b: a & b, flags)


def _repeated(among: str) -> Column:
    """The values that an array holds more than once; most arrays have none, which their distinct values show."""
    twice = F.filter(among, lambda x: F.size(F.filter(among, lambda y: y == x)) > 1)
    return F.when(F.size(F.array_distinct(among)) < F.size(among), twice).otherwise(F.slice(among, 1, 0))


def claim_materials(claims: DataFrame) -> DataFrame:
    """A row a material of each claim's JSON list, with its place, and whether its locator may be trusted.

    Ids and orders repeated within a claim are found in its list, before it is exploded; a locator must be the
    canonical path of its role, so that metadata cannot send a read elsewhere.
    """
    listed = claims.select("claim_id", F.from_json("materials_json", _MATERIAL).alias("ms"))
    place = lambda x: x.try_cast("int")
    ids, places = F.transform("ms", lambda m: m["file_id"]), F.transform("ms", lambda m: place(m["file_order"]))
    listed = listed.withColumns({"ids": ids, "places": places}).select("claim_id", "ms", _repeated("ids").alias("ids"), _repeated("places").alias("places"))
    rows = listed.select("claim_id", "ids", "places", F.posexplode("ms").alias("material_index", "m")).select("claim_id", "ids", "places", "material_index", "m.*")
    rows = rows.withColumn("file_order", place(F.col("file_order")))
    supported, path = F.lit(False), F.lit(None).cast("string")
    for role, (media, folder, extension) in ROLES.items():
        supported = supported | ((F.col("role") == role) & (F.col("media_type") == media))
        path = F.when(F.col("role") == role, F.concat(F.lit("claims/"), "claim_id", F.lit(f"/{folder}/"), "file_id", F.lit(f".{extension}"))).otherwise(path)
    twice = lambda among, c: F.coalesce(F.array_contains(among, F.col(c)), F.lit(False))
    rows = rows.withColumns({"supported": F.coalesce(supported, F.lit(False)), "duplicate_file_id": twice("ids", "file_id"), "duplicate_file_order": twice("places", "file_order")})
    rows = rows.drop("ids", "places")
    named = (F.trim("file_id") != "") & (F.trim("bucket") != "") & (F.col("file_order") > 0)
    valid = F.col("supported") & named & ~F.col("duplicate_file_id") & ~F.col("duplicate_file_order") & (F.col("object_key") == path)
    return rows.withColumn("locator_valid", F.coalesce(valid, F.lit(False)))


def material_facts(claims: DataFrame, materials: DataFrame, objects: DataFrame, min_text: float = 0.0) -> DataFrame:
    """One row a claim: counts of its materials by state, its best photo, its first files, and whether a model may run.

    ``objects`` holds what the file probes gave: claim_id, material_index, object_exists, photo_quality_json,
    document_quality_json; a material without a row does not exist.
    """
    yes = lambda c: F.coalesce(F.col(c).try_cast("boolean"), F.lit(False))
    told = objects.select("claim_id", "material_index", "object_exists", "document_quality_json", F.json_tuple("photo_quality_json", "photo_usable", "status", "quality_score").alias("usable", "read", "score"))
    probed = told.select(  # before they meet the materials, so that flags are sent instead of texts
        "claim_id", "material_index", F.coalesce("object_exists", F.lit(False)).alias("there"), yes("usable").alias("photo_ok"), F.coalesce(F.get_json_object("document_quality_json", "$.document_usable").try_cast("boolean"), F.lit(False)).alias("document_ok"),
        F.coalesce(F.col("read") == "success", F.lit(False)).alias("photo_read"), F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("photo_score"),
    )
    flags = ("there", "photo_ok", "document_ok", "photo_read")
    rows = materials.join(probed, ["claim_id", "material_index"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {"photo_score": F.coalesce("photo_score", F.lit(0.0))})
    rows = rows.withColumn("there", F.col("locator_valid") & F.col("there"))
    photo, document, ok = F.col("role") == "damage_photo", F.col("role") == "supporting_document", F.col("locator_valid")
    typed = {k: (F.col("role") == k) & (F.col("media_type") == v[0]) for k, v in ROLES.items()}
    n = F.count_if
    first = lambda who, c: F.min(F.when(who & F.col("there") & F.col(c).isNotNull(), F.struct("file_order", F.col(c).alias("x"))))["x"]
    facts = rows.groupBy("claim_id").agg(
        F.count("*").alias("material_count"), n(~F.col("supported")).alias("unsupported_material_count"), n(F.col("supported") & ~ok).alias("invalid_material_count"),
        n(typed["damage_photo"]).alias("required_photo_count"), n(typed["supporting_document"]).alias("required_document_count"), n(typed["damage_photo"] & F.col("there")).alias("available_photo_count"),
        n(typed["supporting_document"] & F.col("there")).alias("available_document_count"), n(photo & ok & F.col("photo_read")).alias("readable_photo_count"), n(photo & ok & F.col("photo_ok")).alias("usable_photo_count"),
        n(document & ok & F.col("document_ok")).alias("usable_document_count"), F.max(F.when(photo & ok, F.col("photo_score"))).alias("best_photo_quality_score"),
        first(typed["damage_photo"], "file_id").alias("primary_photo_file_id"), first(typed["supporting_document"], "file_id").alias("primary_document_file_id"),
    )
    counts = [c for c in facts.columns if c.endswith("_count")]
    facts = claims.select("claim_id").join(facts, "claim_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
    present = (F.col("required_photo_count") > 0) & (F.col("required_document_count") > 0)
    whole = [F.col(a) == F.col(b) for a, b in (("available_photo_count", "required_photo_count"), ("available_document_count", "required_document_count"), ("readable_photo_count", "required_photo_count"), ("usable_photo_count", "required_photo_count"), ("usable_document_count", "required_document_count"))]
    usable = _all(F.col("unsupported_material_count") == 0, F.col("invalid_material_count") == 0, present, *whole)
    return facts.withColumn("required_materials_present", present).withColumn("model_input_usable", usable)


def damage_results(answers: DataFrame) -> DataFrame:
    """Per-photo model answers (claim_id, file_id, file_order, damage_json) typed, and whether they are clear either way.

    Each field is read on its own: one of a wrong type is null and spoils no other.
    """
    fields = ("status", "vehicle_visible", "target_vehicle_clear", "damage_visible", "finding_determinate", "confidence", "severity_hint", "damaged_parts", "damage_types", "uncertainty_reasons")
    told = answers.select("claim_id", "file_id", "file_order", "damage_json", F.json_tuple("damage_json", *fields).alias(*(f"a_{f}" for f in fields)))
    text = lambda field: F.col(f"a_{field}")
    listed = lambda field: F.from_json(text(field), "array<string>")
    rows = told.select(
        "claim_id", "file_id", "file_order", "damage_json", text("status").alias("status"),
        *(text(f).try_cast("boolean").alias(f) for f in ("vehicle_visible", "target_vehicle_clear", "damage_visible", "finding_determinate")),
        text("confidence").try_cast("double").alias("confidence"), text("severity_hint").alias("severity_hint"),
        text("damaged_parts").alias("parts_json"), text("damage_types").alias("types_json"),
        listed("damaged_parts").alias("damaged_parts"), listed("damage_types").alias("damage_types"),
        F.coalesce(listed("uncertainty_reasons"), F.array().cast("array<string>")).alias("uncertainty_reasons"),
    )
    says = lambda c: F.coalesce(F.size(F.filter(c, lambda x: ~F.lower(F.trim(x)).isin(*MEANINGLESS))) > 0, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumns({
        "success": F.coalesce(F.col("status") == "success", F.lit(False)), "parts": says("damaged_parts"), "kinds": says("damage_types"),
        "reasons": F.size("uncertainty_reasons"), "doubts": F.when(yes("finding_determinate"), 0).otherwise(F.size("uncertainty_reasons")),
        "damaged": yes("damage_visible"), "visible": yes("vehicle_visible"), "clear": yes("target_vehicle_clear"),
    })
    sure = _all(F.col("success"), yes("finding_determinate"), F.col("confidence") >= MIN_CONFIDENCE, F.col("visible"), F.col("clear"), F.col("doubts") == 0)
    hint = lambda *names: F.col("severity_hint").isin(*names)
    positive = _all(sure, F.col("damaged"), F.col("parts"), F.col("kinds"), hint("minor", "moderate"))
    negative = _all(sure, ~F.col("damaged"), ~F.col("parts"), ~F.col("kinds"), hint("none", "unknown"))
    return rows.withColumns({name: F.coalesce(flag, F.lit(False)) for name, flag in (("positive", positive), ("negative", negative))})


def damage_facts(results: DataFrame) -> DataFrame:
    """One row a claim with model results: counts, agreement, worst severity, lowest confidence, and what was said.

    Of the parts and types those of the most confident answer stand, of equal confidence those of the first file.
    """
    ok, confidence = F.col("success"), F.col("confidence")
    weight = reduce(lambda out, kv: F.when(F.col("severity_hint") == kv[0], kv[1]).otherwise(out), SEVERITY.items(), F.lit(0))
    any_ = lambda flag: F.coalesce(F.bool_or(ok & F.coalesce(flag, F.lit(False))), F.lit(False))
    surest = lambda c: F.max_by(c, F.when(ok & confidence.isNotNull() & F.col(c).isNotNull(), F.struct("confidence", -F.col("file_order"))))
    said = F.sort_array(F.collect_list(F.when(ok, F.struct("file_order", "file_id", "uncertainty_reasons"))))
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("bigint")
    return results.groupBy("claim_id").agg(
        F.count("*").alias("model_result_count"), F.count_if(ok).alias("successful_model_result_count"),
        F.count_if("positive").alias("positive_damage_result_count"), F.count_if("negative").alias("negative_damage_result_count"),
        ((F.count_if(ok & F.col("damaged")) > 0) & (F.count_if(ok & ~F.col("damaged")) > 0)).alias("conflicting_damage_results"),
        F.min_by("damage_json", F.struct("file_order", "file_id")).alias("damage_result_json"),
        F.bool_and(F.when(ok, F.col("visible"))).alias("vehicle_visible"), F.bool_and(F.when(ok, F.col("clear"))).alias("target_vehicle_clear"),
        F.bool_or(F.when(ok, F.col("damaged"))).alias("damage_visible"), surest("parts_json").alias("damaged_parts_json"), surest("types_json").alias("damage_types_json"),
        F.max(F.when(ok & F.col("severity_hint").isNotNull(), F.struct(weight.alias("w"), "severity_hint")))["severity_hint"].alias("severity_hint"),
        F.to_json(F.flatten(F.transform(said, lambda x: x["uncertainty_reasons"]))).alias("uncertainty_reasons_json"),
        F.min(F.when(ok, confidence)).alias("damage_confidence"), any_(F.col("parts")).alias("meaningful_damaged_parts"), any_(F.col("kinds")).alias("meaningful_damage_types"),
        total("reasons").alias("uncertainty_reason_count"), total("doubts").alias("blocking_uncertainty_reason_count"),
        any_(confidence < CONFIDENCE_FLOOR).alias("any_model_confidence_below_floor"),
        any_((confidence >= CONFIDENCE_FLOOR) & (confidence < MIN_CONFIDENCE)).alias("any_damage_model_uncertain"),
        any_(~F.col("visible")).alias("any_vehicle_not_visible"), any_(~F.col("clear")).alias("any_target_vehicle_unclear"),
        any_(F.col("doubts") > 0).alias("any_damage_has_uncertainty"), any_(F.col("severity_hint").isin("severe", "total_loss")).alias("any_high_severity_risk"),
    )


def claim_facts(materials: DataFrame, damage: DataFrame) -> DataFrame:
    """Facts of a claim's materials and, where a model ran, of its answers: the defaults of a claim without any."""
    rows = materials.join(damage.withColumn("model_was_run", F.lit(True)), "claim_id", "left")
    ran = F.coalesce("model_was_run", F.lit(False))
    counts = [c for c in damage.columns if c.endswith("_count")]
    flags = [c for c in damage.columns if c.startswith(("any_", "meaningful_", "conflicting_"))]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts} | {c: F.coalesce(c, F.lit(False)) for c in flags} | {"model_was_run": ran})
    rows = rows.withColumns({c: F.coalesce(c, F.lit("[]")) for c in ("damaged_parts_json", "damage_types_json", "uncertainty_reasons_json")})
    whole = ran & (F.col("successful_model_result_count") == F.col("model_result_count"))
    status = F.when(~F.col("model_was_run"), "not_run").when(F.col("all_model_results_successful"), "success").otherwise("failed")
    rows = rows.withColumn("severity_hint", F.coalesce("severity_hint", F.lit("unknown"))).withColumn("all_model_results_successful", whole)
    return rows.withColumn("model_status", status)


#: Which signals ask for materials, and which for a review.
ASKS = ("bad_material", "no_photo", "no_document", "photo_unreadable", "photo_poor", "document_unreadable", "input_unusable")
RISKS = ("output_failed", "model_uncertain", "vehicle_hidden", "target_unclear", "damage_uncertain", "severe_risk", "conflict")


def decision_facts(facts: DataFrame) -> DataFrame:
    """``claim_facts`` and the signals of the rules, the rule that holds (ask, review, deny, approve), and counts.

    Materials come before manual review, that before denial, that before approval.
    """
    c, told = F.col, lambda name: F.col("model_was_run") & F.col(name)
    photos, documents, usable = c("required_photo_count"), c("required_document_count"), c("usable_photo_count")
    bad = (c("unsupported_material_count") > 0) | (c("invalid_material_count") > 0)
    poor = (usable < photos) | (F.coalesce(c("best_photo_quality_score"), F.lit(0.0)) < MIN_PHOTO_SCORE)
    rows = facts.withColumns({
        "bad_material": bad, "no_photo": photos == 0, "no_document": documents == 0,
        "photo_unreadable": (photos > 0) & (c("readable_photo_count") < photos), "photo_poor": (photos > 0) & (c("readable_photo_count") == photos) & poor,
        "document_unreadable": (documents > 0) & (c("usable_document_count") < documents), "input_unusable": bad | told("any_model_confidence_below_floor"),
        "output_failed": c("model_was_run") & ~c("all_model_results_successful"), "model_uncertain": told("any_damage_model_uncertain"),
        "vehicle_hidden": told("any_vehicle_not_visible"), "target_unclear": told("any_target_vehicle_unclear"),
        "damage_uncertain": told("any_damage_has_uncertainty"), "severe_risk": told("any_high_severity_risk"), "conflict": c("conflicting_damage_results"),
    })
    positive, negative = c("positive_damage_result_count"), c("negative_damage_result_count")
    complete = _all(c("required_materials_present"), c("model_input_usable"), c("all_model_results_successful"), c("model_result_count") == usable, ~c("conflict"))
    rows = rows.withColumns({
        "may_deny": complete & (negative == usable) & (positive == 0),
        "may_approve": complete & (positive >= 1) & (positive == c("successful_model_result_count")) & (negative == 0),
        "ask": _any(*(c(x) for x in ASKS)),
    })
    rows = rows.withColumn("review", ~c("ask") & (_any(*(c(x) for x in RISKS)) | (~c("may_deny") & ~c("may_approve"))))
    settled = ~c("ask") & ~c("review")
    return rows.withColumns({
        "deny": settled & c("may_deny"), "approve": settled & ~c("may_deny") & c("may_approve"),
        "blocking_condition_count": (c("ask") | c("review")).cast("int"), "risk_flag_count": reduce(lambda a, b: a + b, (c(x).cast("int") for x in RISKS)),
    })


def dispositions(facts: DataFrame, damage: DataFrame) -> DataFrame:
    """claim_id, disposition, confidence, reason code, summary, action, blocking and risk counts.

    What matches no rule is for review. The reason is that of the first signal of ``REASONS`` that holds.
    """
    c = F.col
    rows = decision_facts(claim_facts(facts, damage))
    name = F.when(c("ask"), "request_more_materials").when(c("review"), "manual_review").when(c("deny"), "deny_claim").when(c("approve"), "approve_for_payment").otherwise("manual_review")
    reason = reduce(lambda out, r: F.when(c(r[0]), r[1]).otherwise(out), reversed(REASONS), F.lit("open_review_tasks"))
    pick = lambda i: reduce(lambda out, kv: F.when(c("disposition") == kv[0], kv[1][i]).otherwise(out), OUTCOMES.items(), F.lit(None))
    rows = rows.withColumn("disposition", name)
    return rows.select(
        "claim_id", "disposition", pick(0).cast("decimal(4,2)").alias("disposition_confidence"), reason.alias("primary_reason_code"),
        pick(1).alias("reason_summary"), pick(2).alias("next_action"), "blocking_condition_count", "risk_flag_count",
    )
