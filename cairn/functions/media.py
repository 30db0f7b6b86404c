"""Features of training assets: text, documents, SVG images and WAV audio, and whether they may be released.

Content is decoded, hashed and judged by Spark's own functions; only two small readers are Python: the root element of
an SVG image and the header of a WAV recording, each called with nothing for rows of another kind.
"""

from __future__ import annotations

import io
import wave
import xml.parsers.expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits and penalties of the rules; fixed values.
MIN_SIDE, MIN_SECONDS, MIN_TOKENS, ACCEPT, LICENSE_PENALTY = 512, 0.005, 4, 0.8, 0.25
#: What a flag costs, by modality; fixed values.
FLAG_COST = {"text": 0.4, "document": 1.0, "image": 0.5, "audio": 0.5}
#: Runs of white space as Python's ``str.split`` sees it.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

_SVG = T.StructType([T.StructField(c, T.StringType()) for c in ("root", "width", "height", "box")])
_WAV = T.StructType([T.StructField("error", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("channels", "sample_rate", "sample_width_bytes")), T.StructField("frame_count", T.LongType())])


def tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9_]+"), F.lit(0))).cast("bigint")


def first_element(data: bytes | None) -> tuple[str, dict[str, str]] | None:
    """Name and attributes of an XML document's root; None where it is not well-formed."""
    seen: list[tuple[str, dict[str, str]]] = []
    parser = xml.parsers.expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler = lambda name, values: seen or seen.append((name.rpartition(" ")[2], values))
    try:
        parser.Parse(data or b"", True)
    except xml.parsers.expat.ExpatError:
        return None
    return seen[0]


@F.pandas_udf(_SVG)
def svg_roots(content: pd.Series) -> pd.DataFrame:
    found = [first_element(x) or (None, {}) for x in content]
    return pd.DataFrame([(name, v.get("width"), v.get("height"), v.get("viewBox")) for name, v in found], columns=["root", "width", "height", "box"], dtype="object")


def wav_header(content: bytes | None) -> tuple[str | None, int | None, int | None, int | None, int | None]:
    """(error, channels, sample rate, bytes a sample, frames) of a WAV file's header."""
    try:
        with wave.open(io.BytesIO(content or b"")) as sound:
            found = sound.getnchannels(), sound.getframerate(), sound.getsampwidth(), sound.getnframes()
    except (EOFError, wave.Error) as e:
        return type(e).__name__, None, None, None, None
    return ("invalid_wave_header" if min(found[:3]) <= 0 else None), *found


@F.pandas_udf(_WAV)
def wav_headers(content: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([wav_header(x) for x in content], columns=["error", "channels", "sample_rate", "sample_width_bytes", "frame_count"])
    return rows.astype({"channels": "Int32", "sample_rate": "Int32", "sample_width_bytes": "Int32", "frame_count": "Int64"})


def svg_size(root: Column) -> Column:
    """struct<width, height> of an SVG's root: its lengths in pixels, or else those of its view box."""
    length = lambda c: F.nullif(F.regexp_extract(F.coalesce(root[c], F.lit("")), r"^\s*(\d+(?:\.\d+)?)\s*(?:px)?\s*$", 1), F.lit("")).try_cast("double").cast("int")
    side = lambda i: F.nullif(F.regexp_extract(F.coalesce(root["box"], F.lit("")), r"^\s*(?:-?\d+(?:\.\d+)?[\s,]+){2}(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)\s*$", i), F.lit("")).try_cast("double").cast("int")
    either = lambda c, i: F.coalesce(F.nullif(length(c), F.lit(0)), side(i), length(c)).cast("bigint")
    return F.struct(either("width", 1).alias("width"), either("height", 2).alias("height"))


def asset_features(assets: DataFrame) -> DataFrame:
    """Features of rows with record_id, modality, mime_type, license_id, text, content_base64, expected_sha256.

    What a row carries is its base64 content, line breaks or not, before its text. A hash that is expected and differs,
    and a modality that is not known, fail the query.
    """
    kind, c = F.col("modality"), F.col
    coded = F.regexp_replace(F.coalesce("content_base64", F.lit("")), r"\s+", "")
    rows = assets.select("record_id", "modality", "license_id", "mime_type", "text", "expected_sha256", coded.alias("coded"))
    data = F.when(c("coded") == "", F.coalesce("text", F.lit("")).cast("binary")).otherwise(F.try_to_binary("coded", F.lit("base64")))
    rows = rows.withColumn("broken", data.isNull()).withColumn("data", F.coalesce(data, F.lit("").cast("binary"))).drop("coded")
    rows = rows.withColumn("content_sha256", F.sha2("data", 256))
    expected = F.lower(F.trim(F.coalesce("expected_sha256", F.lit(""))))
    differs = F.raise_error(F.concat(F.lit("content of "), c("record_id"), F.lit(" does not have the expected hash")))
    unknown = F.raise_error(F.concat(F.lit("unknown modality "), F.coalesce(kind, F.lit("null"))))
    checked = F.when(~F.coalesce(kind.isin(*FLAG_COST), F.lit(False)), unknown).when((expected != "") & ~c("broken") & (expected != c("content_sha256")), differs)
    rows = rows.withColumn("content_sha256", F.coalesce(checked.cast("string"), c("content_sha256")))
    rows = rows.withColumn("svg", svg_roots(F.when((kind == "image") & (c("mime_type") == "image/svg+xml"), c("data"))))
    rows = rows.withColumn("wav", wav_headers(F.when(kind == "audio", c("data"))))
    is_svg = F.coalesce(c("svg.root") == "svg", F.lit(False))
    rows = rows.withColumn("size", F.when(is_svg, svg_size(c("svg"))))
    said = c("data").cast("string")
    rows = rows.withColumn("utf8", F.is_valid_utf8(said)).withColumn("said", F.make_valid_utf8(said))
    folded = F.trim(F.regexp_replace("said", SPACE, " "))
    stripped = F.regexp_replace("said", f"^{SPACE}|{SPACE}$", "")
    rows = rows.withColumn("content_text", F.when(kind == "text", folded).when(kind == "document", stripped).otherwise(F.coalesce("text", F.lit(""))))
    read = F.col("wav.error").isNull()
    seconds = F.when(read, c("wav.frame_count") / c("wav.sample_rate"))
    rows = rows.withColumn("seconds", seconds).withColumn("token_count", tokens(c("content_text")))
    least, plain = F.least("size.width", "size.height"), kind.isin("text", "document")
    rules = (
        (c("broken"), "invalid_base64"), (plain & ~c("utf8"), "invalid_utf8"), ((kind == "text") & (c("token_count") < MIN_TOKENS), "text_too_short"),
        ((kind == "document") & (c("content_text") == ""), "empty_document"), ((kind == "image") & ~is_svg, "invalid_image"),
        ((kind == "image") & is_svg & ((F.coalesce("size.width", F.lit(0)) == 0) | (F.coalesce("size.height", F.lit(0)) == 0)), "missing_dimensions"),
        ((kind == "image") & is_svg & (least > 0) & (least < MIN_SIDE), "low_resolution"), ((kind == "audio") & ~read, "invalid_audio"),
        ((kind == "audio") & (c("seconds") < MIN_SECONDS), "audio_too_short"),
    )
    rows = rows.withColumn("base_flags", F.array_compact(F.array(*(F.when(holds, flag) for holds, flag in rules))))
    cost = F.create_map(*(F.lit(x) for pair in FLAG_COST.items() for x in pair))
    score = F.when(kind == "document", (c("content_text") != "").cast("double")).otherwise(1 - F.try_element_at(cost, kind) * F.size("base_flags"))
    return rows.select(
        "record_id", "modality", "license_id", "mime_type", "content_text", "content_sha256", F.octet_length("data").cast("bigint").alias("byte_size"), "token_count",
        score.alias("base_score"), "base_flags", c("size.width").alias("width"), c("size.height").alias("height"), F.round("seconds", 4).alias("duration_seconds"),
        F.when(read, c("wav.sample_rate").cast("bigint")).alias("sample_rate"),
    )


def released(features: DataFrame) -> DataFrame:
    """``features`` and risk_flags, quality_score, decision: accepted without flags and from ACCEPT on."""
    bare = F.trim(F.coalesce("license_id", F.lit(""))) == ""
    flags = F.when(bare, F.array_append("base_flags", F.lit("missing_license"))).otherwise(F.col("base_flags"))
    score = F.round(F.greatest(F.col("base_score") - F.when(bare, LICENSE_PENALTY).otherwise(0.0), F.lit(0.0)), 3)
    rows = features.withColumn("risk_flags", flags).withColumn("quality_score", score).drop("base_flags", "base_score")
    return rows.withColumn("decision", F.when((F.size("risk_flags") == 0) & (F.col("quality_score") >= ACCEPT), "accepted").otherwise("rejected"))


def release_summary(rows: DataFrame) -> DataFrame:
    """Counts a modality: raw, accepted and rejected assets, mean quality, bytes."""
    return rows.groupBy("modality").agg(
        F.count("*").alias("raw_assets"), F.count_if(F.col("decision") == "accepted").alias("released_assets"), F.count_if(F.col("decision") == "rejected").alias("rejected_assets"),
        F.round(F.avg("quality_score"), 3).alias("average_quality"), F.sum("byte_size").cast("bigint").alias("total_bytes"),
    )


# --- photos, from measured brightness, contrast and sharpness ----------------------------------------------------

#: Flag, what holds, what it costs; fixed values. Too dark and too bright cost once.
PHOTO_RULES = (("too_dark", "brightness_mean < 45", 0.25), ("too_bright", "brightness_mean > 230", 0.25), ("low_contrast", "brightness_std < 28", 0.25), ("blurry", "blur_score < 60", 0.35), ("low_resolution", "least(image_width, image_height) < 400", 0.15))


def photo_quality(photos: DataFrame) -> DataFrame:
    """``photos`` and issue_flags, quality_score, needs_review, from metric columns alone.

    A photo that failed to decode (``decode_ok`` false, where there is such a column) has score 0 and one flag.
    """
    flags = F.array_compact(F.array(*[F.when(F.expr(rule), name) for name, rule, _ in PHOTO_RULES]))
    cost: Column = F.lit(0.0)
    for _, rule, price in PHOTO_RULES:
        cost = cost + F.when(F.coalesce(F.expr(rule), F.lit(False)), price).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), 1 - cost), 6)
    if "decode_ok" in photos.columns:
        broken = ~F.coalesce("decode_ok", F.lit(False))
        flags, score = F.when(broken, F.array(F.lit("decode_error"))).otherwise(flags), F.when(broken, 0.0).otherwise(score)
    rows = photos.withColumn("issue_flags", flags).withColumn("quality_score", score)
    return rows.withColumn("needs_review", (F.col("quality_score") < 0.6) | (F.size("issue_flags") > 0))


#: The other profile: reason, what holds; fixed values. Too bright is only told where a photo is not too dark.
MEAN_RULES = (
    ("resolution_too_low", "width < 640 or height < 480"), ("too_dark", "brightness < 0.10"), ("too_bright", "brightness >= 0.10 and brightness > 0.95"), ("low_contrast", "contrast < 10.0"),
    ("low_detail", "sharpness < 1.5"), ("quality_score_below_threshold", "score < 0.40"),
)


def photo_quality_means(photos: DataFrame) -> DataFrame:
    """``photos`` and photo_quality_json: the mean of four scores, of resolution, brightness (0 to 1), contrast and
    sharpness (mean absolute change of brightness along both axes), and the reasons that make a photo unusable.

    Columns: width, height, brightness, contrast, sharpness, error_type (null where the photo was decoded).
    """
    one = lambda *parts: F.least(F.lit(1.0), *parts)
    scores = (
        one(F.col("width") / 1280.0, F.col("height") / 960.0), F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("brightness") - 0.5) / 0.5),
        one(F.col("contrast") / 40.0), one(F.col("sharpness") / 8.0),
    )
    rows = photos.withColumn("score", sum(scores[1:], scores[0]) / 4.0)
    reasons = F.array_compact(F.array(*(F.when(F.expr(rule), name) for name, rule in MEAN_RULES)))
    broken = F.struct(F.lit("decode_error").alias("status"), F.lit(False).alias("photo_usable"), F.lit(0.0).alias("quality_score"), F.array(F.lit("image_decode_failed")).alias("quality_reasons"), "error_type")
    sound = F.struct(
        F.lit("success").alias("status"), "width", "height", *(F.round(c, 4).alias(c) for c in ("brightness", "contrast", "sharpness")), F.round("score", 4).alias("quality_score"),
        (F.size(reasons) == 0).alias("photo_usable"), reasons.alias("quality_reasons"),
    )
    json = F.when(F.col("error_type").isNotNull(), F.to_json(broken)).otherwise(F.to_json(sound))
    return rows.withColumn("photo_quality_json", json).drop("score")
