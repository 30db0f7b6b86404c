"""JSON guards, HTML blocks, media kernels, prompts, evaluation."""

import base64
import io
import json
import math
import wave

import pytest
from pyspark.sql import functions as F

from cairn.functions import html as H
from cairn.functions import jsonguard as J
from cairn.functions import media as M
from cairn.functions import ocr as O
from cairn.operators import evaluation as V
from cairn.operators import prompts as R

FACT = {"document_type": "recommendation_record", "expert_id": "exp-001", "supplier_name": " A  B ", "recommended": True, "participated": None, "recused": None, "evidence_quote": "seen", "confidence": 0.91239}


def test_audit_fact():
    assert json.loads(J.audit_fact(json.dumps(FACT))) == FACT | {"expert_id": "EXP-001", "supplier_name": "A B", "confidence": 0.9124}
    assert J.audit_fact("```json\n" + json.dumps(FACT) + "\n```")
    for change in ({"confidence": True}, {"confidence": 2}, {"expert_id": "x"}, {"participated": False}, {"supplier_name": None}, {"evidence_quote": " "}, {"document_type": "other"}, {"extra": 1}):
        with pytest.raises(J.Rejected):
            J.audit_fact(json.dumps(FACT | change))
    for raw in (None, "[]", "{", '{"a":1,"a":2}', '{"a":NaN}', "text"):
        with pytest.raises(J.Rejected):
            J.strict_object(raw)
    assert J.salvaged('so: {"a": 1} done') == '{"a":1}' and J.salvaged("none") is None


def test_guarded_rows(spark):
    rows = spark.createDataFrame([(1, json.dumps(FACT)), (2, "bad"), (3, None)], "id int, raw string").select("id", J.guarded(F.col("raw"), J.audit_fact).alias("g")).select("id", "g.*").collect()
    assert [r.id for r in rows if r.json] == [1] and all(r.error for r in rows if not r.json)


def test_html_blocks():
    page = "<html><head><title>The title of it</title><script>var x='no';</script></head><body><div>Direct text here <p>A paragraph of some length</p><p>A paragraph of some length</p></div><ul><li>first item text<li>second item text</ul><img alt='a picture of it' src=x></body></html>"
    title, blocks = H.html_blocks(page, shortest=10)
    assert title == "The title of it"
    assert blocks == ["The title of it", "Direct text here", "A paragraph of some length", "first item text", "second item text", "a picture of it"]
    assert H.html_blocks(page, 10, 2)[1] == blocks[:2] and H.html_blocks("") == ("", [])


def wav(rate, frames):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes(b"\0\0" * frames)
    return base64.b64encode(out.getvalue()).decode()


def test_media(spark):
    svg = lambda w, h: base64.b64encode(f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}"/>'.encode()).decode()
    rows = [
        ("ok-text", "text", "mit", "text/plain", "four words are here", None), ("short", "text", "mit", "text/plain", "two words", None), ("doc", "document", "", "text/plain", "any", None), ("empty", "document", "mit", "text/plain", " ", None),
        ("big", "image", "mit", "image/svg+xml", None, svg(800, 600)), ("small", "image", "mit", "image/svg+xml", None, svg(136, 168)), ("png", "image", "mit", "image/png", None, "AAAA"), ("tone", "audio", "mit", "audio/wav", "said", wav(8000, 8000)), ("blip", "audio", "mit", "audio/wav", "said", wav(8000, 8)), ("noise", "audio", "mit", "audio/wav", "said", "AAAA"),
    ]
    frame = spark.createDataFrame([(*r, None) for r in rows], "record_id string, modality string, license_id string, mime_type string, text string, content_base64 string, expected_sha256 string")
    got = {r.record_id: (r.decision, r.quality_score, r.risk_flags) for r in M.released(M.asset_features(frame)).collect()}
    assert got == {
        "ok-text": ("accepted", 1.0, []), "short": ("rejected", 0.6, ["text_too_short"]), "doc": ("rejected", 0.75, ["missing_license"]), "empty": ("rejected", 0.0, ["empty_document"]), "big": ("accepted", 1.0, []), "small": ("rejected", 0.5, ["low_resolution"]),
        "png": ("rejected", 0.5, ["invalid_image"]), "tone": ("accepted", 1.0, []), "blip": ("rejected", 0.5, ["audio_too_short"]), "noise": ("rejected", 0.5, ["invalid_audio"]),
    }
    odd = spark.createDataFrame([("a", "text", "mit", "t", "x", "!!", None), ("b", "text", "mit", "t", None, base64.b64encode(b"four words \xff here").decode(), None), ("c", "image", "mit", "image/svg+xml", None, base64.b64encode(b'<svg viewBox="0 0 700 600.5" width="50%"/>').decode(), None), ("d", "image", "mit", "image/svg+xml", None, base64.b64encode(b"<p/>").decode(), None)], frame.schema)
    got = {r.record_id: (r.base_flags, r.width, r.height, r.content_text) for r in M.asset_features(odd).collect()}
    assert got["a"] == (["invalid_base64", "text_too_short"], None, None, "") and got["b"] == (["invalid_utf8", "text_too_short"], None, None, "four words \ufffd here")
    assert got["c"][:3] == ([], 700, 600) and got["d"][0] == ["invalid_image"]
    for change in ({"expected_sha256": "00"}, {"modality": "video"}, {"modality": None}):
        with pytest.raises(Exception, match="expected hash|unknown modality"):
            M.asset_features(frame.limit(1).withColumns({k: F.lit(v).cast("string") for k, v in change.items()})).collect()


def test_prompts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, p string")
    build = lambda: R.TablePrompter({"a": "yes", "STRICT b": "yes"})

    def must(answer):
        if answer != "yes":
            raise ValueError("no")
        return answer

    got = R.prompt(rows, build, "id", "p", must, stricter="STRICT ")
    assert {r.id: r.status for r in got.collect()} == {1: "success", 2: "success", 3: "skipped", 4: "invalid_response"}
    assert R.enforce_budget(got, 1)["success"] == 2
    with pytest.raises(R.ErrorBudgetExceeded):
        R.enforce_budget(got, 0)


def test_macro_scores(spark):
    labels = [f"l{i}" for i in range(14)]
    score = lambda rows: V.macro_scores(spark.createDataFrame(rows, "actual string, predicted string"), labels).first()
    perfect = score([(x, x) for x in labels])
    assert (perfect.accuracy, perfect.macro_f1) == (1, 1)
    none = score([(x, None) for x in labels])
    assert (none.accuracy, none.macro_f1) == (0, 0)
    half = score([("l0", "l0"), ("l0", "l1")])
    assert half.accuracy == 0.5 and math.isclose(half.macro_f1, (2 / 3) / 14)


def test_damage_and_calls(spark):
    found = {"vehicle_visible": True, "target_vehicle_clear": True, "damage_visible": True, "damaged_parts": ["door", " "], "damage_types": [], "evidence_summary": "dent", "finding_determinate": True, "evidence_limitations": [], "severity_hint": "minor", "confidence": 0.9, "other": 1}
    assert json.loads(J.damage(json.dumps(found)))["damaged_parts"] == ["door"]
    for change in ({"finding_determinate": False}, {"evidence_limitations": ["blur", "blur"]}, {"severity_hint": "odd"}, {"damage_visible": 1}):
        assert json.loads(J.or_error(J.damage, J.NO_DAMAGE)(json.dumps(found | change)))["status"] == "invalid_response"
    call = {"problem_category": "praise", "customer_sentiment": "positive", "sentiment_score": 0.5, "urgency": "low", "key_issues": [], "customer_request": "none", "resolution_status": "resolved", "requires_followup": False, "agent_attitude": "professional", "summary": "fine", "confidence": 1}
    assert json.loads(J.call_analysis(json.dumps(call)))["status"] == "success"
    rows = spark.createDataFrame([(json.dumps(call),), ("x",)], "raw string").select(J.guarded(F.col("raw"), J.or_error(J.call_analysis, J.NO_ANALYSIS))["json"].alias("j"))
    assert sorted(json.loads(r.j)["status"] for r in rows.collect()) == ["invalid_response", "success"]


def test_ocr(spark):
    lines = [{"text": "Claimant Name:", "confidence": 0.9, "bbox": [0, 20, 50, 30]}, {"txt": "Ada", "score": 1.5, "box": [[60, 21], [90, 21], [90, 31], [60, 31]]}, ["CLAIM NO. C-1", 0.8, [0, 0, 50, 10]], [[0, 40, 40, 50], "Loss date", 0.7], ["03/04/2024", True, [45, 41, 90, 51]], {"text": 7}, ["short"], None, {"text": " "}]
    raws = [("list", json.dumps(lines)), ("held", json.dumps({"results": lines})), ("bad", "bad"), ("none", None), ("empty", "{}"), ("placeless", json.dumps([["a", 0.5, None], ["b", 0.25, [[1, "x"]]]]))]
    rows = spark.createDataFrame(raws, "k string, raw string").withColumn("o", O.observations(F.col("raw"))).withColumn("f", O.fields(F.col("o.text_lines")))
    got = {r.k: r for r in rows.collect()}
    for k in ("list", "held"):
        assert [x.text for x in got[k].o.text_lines] == ["CLAIM NO. C-1", "Claimant Name:", "Ada", "Loss date", "03/04/2024"]
        assert got[k].o.mean_confidence == 0.68 and got[k].o.text_lines[2].bbox == [60, 21, 90, 31]
        assert tuple(got[k].f) == ("C-1", "Ada", "2024-03-04")
    for k in ("bad", "none", "empty"):
        assert (got[k].o.status, got[k].o.failure_reason, got[k].o.text_lines, tuple(got[k].f)) == ("unreadable", "no_text_detected", [], ("", "", ""))
    assert [(x.text, x.bbox) for x in got["placeless"].o.text_lines] == [("a", [0, 0, 0, 0]), ("b", [0, 10, 0, 10])]
    rows = spark.createDataFrame([("C-1", json.dumps(lines)), ("C-2", json.dumps(lines)), ("C-3", None)], "claim_id string, raw string").withColumn("o", O.observations(F.col("raw"))).withColumn("f", O.fields(F.col("o.text_lines")))
    rows = rows.select("claim_id", O.document_quality(F.col("o"), F.col("f"), F.col("claim_id"), ["claim_number", "loss_date"], 0.5).alias("q"))
    assert {r.claim_id: r.q.failure_reasons for r in rows.collect()} == {"C-1": [], "C-2": ["claim_number_mismatch"], "C-3": ["ocr_unreadable", "ocr_confidence_below_threshold", "required_fields_missing"]}


def test_ocr_values_beside_labels(spark):
    """Two labels of a field, a value taken once, and values too far off or to the left."""
    line = lambda text, left, top: {"text": text, "confidence": 1.0, "bbox": [left, top, left + 40, top + 10]}
    cases = {
        "nearest": ([line("Claimant name", 0, 0), line("far", 60, 6), line("near", 90, 1)], ("", "near", "")),
        "taken": ([line("Claimant name", 0, 0), line("Loss date", 0, 1), line("2024-01-02", 60, 0)], ("", "2024-01-02", "")),
        "left": ([line("value", 0, 0), line("Claimant name", 100, 0)], ("", "", "")),
        "below": ([line("Claimant name", 0, 0), line("value", 60, 9)], ("", "", "")),
        "last inline": ([line("Claim # A", 0, 0), line("claim no: B", 0, 50)], ("B", "", "")),
        "odd date": ([line("Loss date: someday", 0, 0)], ("", "", "")),
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()], "k string, raw string").select("k", O.fields(O.observations(F.col("raw"))["text_lines"]).alias("f"))
    assert {r.k: tuple(r.f) for r in rows.collect()} == {k: want for k, (_, want) in cases.items()}


def test_answers_in_fences(spark):
    found = {"vehicle_visible": True, "target_vehicle_clear": True, "damage_visible": True, "damaged_parts": [], "damage_types": [], "evidence_summary": " a\nb ", "finding_determinate": True, "evidence_limitations": [], "severity_hint": " Minor ", "confidence": 0.5}
    for wrap in ("{}", "```\n{}\n```", "```json {} ```", "```JSON\n{}", " {} "):
        got = json.loads(J.damage(wrap.replace("{}", json.dumps(found))))
        assert (got["severity_hint"], got["evidence_summary"]) == ("minor", "a\nb")
    why = lambda raw: json.loads(J.or_error(J.damage, J.NO_DAMAGE)(raw))["uncertainty_reasons"]
    assert why(None) == ["invalid_json"] and why("[]") == ["response_not_object"] and why(json.dumps(found | {"confidence": float("nan")})) == ["invalid_confidence"]
    assert why(json.dumps(found | {"evidence_limitations": ["blur", ""]})) == ["invalid_evidence_limitations"] and why(json.dumps(found | {"damaged_parts": "door"})) == ["invalid_list_fields"]


def test_meta_attributes_are_told_apart():
    page = '<meta name="og:title" content="not a block of the page"><meta property="description" content="neither is this one"><meta name="description" content="what the page is about"><meta property="og:title" content="the title for sharing">'
    assert H.html_blocks(page, 10)[1] == ["what the page is about", "the title for sharing"]


def test_wav_headers_and_gates(spark):
    from cairn.operators import calls as A

    sound = lambda rate, frames: base64.b64decode(wav(rate, frames))
    rateless = bytearray(sound(8000, 10))
    rateless[24:28] = b"\0\0\0\0"
    cases = {"fine": sound(8000, 16000), "short": sound(8000, 100), "long": sound(10, 9010), "rateless": bytes(rateless), "cut": sound(8000, 10)[:20], "none": None}
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in cases.items()], "k string, content binary").select("k", A.audio_gate(M.wav_headers("content")).alias("j"))
    got = {r.k: json.loads(r.j) for r in rows.collect()}
    assert got["fine"] == {"status": "success", "channels": 1, "sample_rate": 8000, "sample_width_bytes": 2, "frame_count": 16000, "duration_seconds": 2.0, "audio_usable": True, "quality_reasons": []}
    assert got["short"]["quality_reasons"] == ["audio_too_short"] and got["long"]["quality_reasons"] == ["audio_too_long"]
    assert got["rateless"] == {"status": "decode_error", "audio_usable": False, "error_type": "invalid_wave_header"} and {got[k]["error_type"] for k in ("cut", "none")} == {"EOFError"}
    rows = spark.createDataFrame([("success", " long enough ", 0.1), ("success", "short", 0.9), ("failed", "long enough", None), (None, None, None)], "s string, t string, c double")
    gates = [json.loads(r.g) for r in rows.select(A.transcript_gate(F.col("t"), F.col("c"), F.col("s")).alias("g")).collect()]
    assert [g["failure_reasons"] for g in gates] == [[], ["transcript_too_short"], ["asr_unsuccessful"], ["asr_unsuccessful", "transcript_too_short"]]
    assert gates[0]["language_confidence"] == 0.1 and gates[3]["asr_status"] == "unknown"


def test_intents_without_white_space(spark):
    rows = spark.createDataFrame([("o n e\ttwo",), ("two",), ("three",), (None,), ("ONE",)], "t string").select(V.keyword_intent(F.col("t"), {"a": ["one", "on"], "b": ["two"], "c": ["zzz"]}).alias("i"))
    assert [r.i for r in rows.collect()] == ["a", "b", "other", "other", "a"]
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), (None, "b"), ("x", "x")], "predicted string, actual string")
    got = V.macro_scores(rows, ["a", "b"], queues={"a": "q", "b": "q"}).first()
    assert (got.accuracy, got.queue_accuracy, got.records) == (0.4, 0.6, 5) and math.isclose(got.macro_f1, 0.5 * (2 * 1 / (2 + 2)))


def test_claim_confidence_edges(spark):
    """0.39 is below the floor, 0.40 and 0.79 are uncertain, 0.80 counts."""
    from cairn.operators import claims as C

    answer = lambda c, **more: json.dumps({"status": "success", "vehicle_visible": True, "target_vehicle_clear": True, "damage_visible": True, "damaged_parts": ["door"], "damage_types": ["dent"], "finding_determinate": True, "severity_hint": "minor", "uncertainty_reasons": ["blur"], "confidence": c} | more)
    rows = [(str(c), "f", 1, answer(c)) for c in (0.39, 0.40, 0.79, 0.80)] + [("odd", "f", 1, answer(0.9, confidence="high", damaged_parts="door")), ("two", "a", 2, answer(0.9)), ("two", "b", 1, answer(0.85, uncertainty_reasons=["x", "y"]))]
    got = {r.claim_id: r for r in C.damage_facts(C.damage_results(spark.createDataFrame(rows, "claim_id string, file_id string, file_order int, damage_json string"))).collect()}
    flags = {k: (r.any_model_confidence_below_floor, r.any_damage_model_uncertain, r.positive_damage_result_count) for k, r in got.items()}
    assert flags["0.39"] == (True, False, 0) and flags["0.4"] == flags["0.79"] == (False, True, 0) and flags["0.8"] == (False, False, 1)
    assert flags["odd"] == (False, False, 0) and got["odd"].successful_model_result_count == 1
    assert got["two"].uncertainty_reasons_json == '["x","y","blur"]' and got["two"].damage_confidence == 0.85


def test_photo_quality_profiles(spark):
    rows = spark.createDataFrame([(1280, 960, 0.5, 40.0, 8.0, None), (639, 480, 0.05, 9.0, 1.0, None), (None, None, None, None, None, "OSError")], "width int, height int, brightness double, contrast double, sharpness double, error_type string")
    got = [json.loads(r.photo_quality_json) for r in M.photo_quality_means(rows).collect()]
    assert (got[0]["quality_score"], got[0]["photo_usable"]) == (1.0, True)
    assert got[1]["quality_reasons"] == ["resolution_too_low", "too_dark", "low_contrast", "low_detail", "quality_score_below_threshold"]
    assert got[2] == {"status": "decode_error", "photo_usable": False, "quality_score": 0.0, "quality_reasons": ["image_decode_failed"], "error_type": "OSError"}
    photo = spark.createDataFrame([(False, 100.0, 50.0, 100.0, 800, 800)], "decode_ok boolean, brightness_mean double, brightness_std double, blur_score double, image_width int, image_height int")
    one = M.photo_quality(photo).first()
    assert (one.issue_flags, one.quality_score, one.needs_review) == (["decode_error"], 0.0, True)


def test_classes_are_built_once_a_worker(spark, tmp_path):
    class Work:
        def __init__(self):
            import os
            import uuid

            (tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def __call__(self, batch):
            return batch.select(["id"])

    for _ in range(1):
        assert R.map_batches(spark.range(0, 200, 1, 16), Work, "id bigint", batch_size=3).count() == 200
    built = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert built and len(built) == len(set(built))
    R.register_function(spark, "cairn_twice", lambda a, b: None if a is None else f"{a}{b}", "string")
    assert [r.x for r in spark.sql("select cairn_twice(a, 'y') as x from values ('x'), (null) as t(a)").collect()] == ["xy", None]


def test_prompt_forms(spark):
    rows = spark.createDataFrame([(1, "a", "u"), (2, "b", None)], "id int, p string, q string")

    class Echo:
        def answer(self, prompts, system=None):
            return [json.dumps({"said": p, "n": len(p), "system": system}) for p in prompts]

    got = R.prompt(rows, Echo, "id", R.messages(F.col("p"), " and ", F.col("q")), system="be brief", returns="said string, n bigint, system string").collect()
    assert {r.id: (r.status, r.response and r.response.asDict()) for r in got} == {1: ("success", {"said": "a and u", "n": 7, "system": "be brief"}), 2: ("skipped", None)}
    assert {r.status for r in R.prompt(rows, Echo, "id", "p", returns="said string, n string, system string").collect()} == {"invalid_response"}
    with pytest.raises(Exception, match="id 1"):
        R.prompt(rows.limit(1), Echo, "id", "p", returns="other string", on_error="raise").collect()


def test_judge(spark):
    questions = {"angry": R.Question("Is the caller angry?"), "topic": R.Question("What is it about?", "choice", ("card", "loan")), "grade": R.Question("How clear?", "scale", ("poor", "fair", "good"))}

    class Judge:
        def answer(self, prompts, system=None):
            assert all("hidden" not in p for p in prompts)
            return [json.dumps({"angry": "mad" in p.split("\n")[-1], "topic": "card", "grade": 7 if "unclear" in p.split("\n")[-1] else 2}) for p in prompts]

    rows = spark.createDataFrame([(1, "mad", "hidden"), (2, "calm", "hidden"), (3, None, "hidden"), (4, "unclear", "hidden")], "id int, said string, secret string")
    state = F.when(F.col("said").isNotNull(), F.struct("said"))
    got = {r.id: (r.status, r.response and tuple(r.response)) for r in R.judge(rows, Judge, "id", state, questions).collect()}
    assert got == {1: ("success", (True, "card", 2)), 2: ("success", (False, "card", 2)), 3: ("skipped", None), 4: ("invalid_response", None)}


def test_materials_are_read_without_the_facts(spark, monkeypatch):
    from cairn.operators import claims as C
    from cairn.plans import claims as P

    def refused(*_):
        raise AssertionError("facts were made")

    monkeypatch.setattr(C, "material_facts", refused)
    assert P.claim_materials(spark, "/root/testdata/sf0.001").count() > 0
    listed = '[{"file_id":"a","file_order":"1"},{"file_id":"a","file_order":"2"},{"file_id":null,"file_order":"2"},{"file_id":null,"file_order":"x"},{"file_id":"b","file_order":"y"}]'
    rows = C.claim_materials(spark.createDataFrame([("C1", listed)], "claim_id string, materials_json string")).orderBy("material_index").collect()
    assert [(r.duplicate_file_id, r.duplicate_file_order) for r in rows] == [(True, False), (True, True), (False, True), (False, False), (False, False)]
