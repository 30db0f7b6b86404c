"""Raster photos: every document's bytes as the pixels of a picture, its measures, both quality profiles and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import media as M
from cairn.functions import raster as R
from cairn.operators import packets as P
from cairn.session import bounded, table

#: Columns of a picture; every so many documents' file is cut in half; what parts ties before figures are rounded.
WIDTH, DAMAGED, TIE = 64, 50, 1e-9


def _files(spark, sf_dir: str) -> DataFrame:
    """Each document's whole text as a lossless PNG; some files are cut off, as uploads are."""
    docs = bounded(table(spark, sf_dir, "documents", spread=True))
    drawn = docs.select("doc_id", "source", R.rendered(F.encode("text", "utf-8"), WIDTH).alias("png"))
    cut = F.when(F.col("doc_id") % DAMAGED == 0, F.substring("png", F.lit(1), (F.octet_length("png") / 2).cast("int"))).otherwise(F.col("png"))
    return drawn.select("doc_id", "source", cut.alias("content"))


def photo_pixels(spark, sf_dir):
    """Measures of every picture and what the first profile says of them."""
    rows = M.photo_quality(R.photo_metrics(_files(spark, sf_dir)))
    return rows.select("doc_id", "decode_ok", "image_width", "image_height", F.round(F.col("brightness_mean") + TIE, 4).alias("brightness_mean"), F.round(F.col("brightness_std") + TIE, 4).alias("brightness_std"), F.round(F.col("blur_score") + TIE, 3).alias("blur_score"), F.array_join("issue_flags", ",").alias("issue_flags"), "quality_score", "needs_review")


def photo_pixel_means(spark, sf_dir):
    """What the other profile says of every picture."""
    c = F.col
    photos = R.photo_metrics(_files(spark, sf_dir)).select("doc_id", c("image_width").alias("width"), c("image_height").alias("height"), (c("brightness_mean") / 255).alias("brightness"), c("brightness_std").alias("contrast"), "sharpness", "error_type")
    json = lambda name: F.get_json_object("photo_quality_json", f"$.{name}")
    return M.photo_quality_means(photos).select("doc_id", json("status").alias("status"), json("photo_usable").alias("usable"), json("quality_reasons").alias("reasons"))


def photo_copies(spark, sf_dir):
    """Pictures of one source that look like an earlier one of it."""
    c = F.col
    photos = R.photo_metrics(_files(spark, sf_dir)).select(c("source").alias("claim_id"), c("doc_id").alias("ordinal"), c("doc_id").cast("string").alias("file_id"), "decode_ok", "perceptual_hash")
    return P.copied_photos(photos).select("claim_id", "file_id", "first_file_id", "perceptual_hash")


_PIXELS = f"""with b as (select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::int) p from documents),
h as (select doc_id, greatest(1, ceil(len(p) / {WIDTH}.0))::int h, p from b),
px as materialized (select doc_id, h, list_concat(p, list_transform(range(h * {WIDTH} - len(p)), lambda i: 255)) p from h),
inner_ as (select doc_id, list_filter(range({WIDTH} + 2, h * {WIDTH} - {WIDTH}), lambda i: i % {WIDTH} >= 2) ix from px),
m as (select doc_id, h, doc_id % {DAMAGED} = 0 as cut, list_avg(p) mean, list_stddev_pop(p) std,
  coalesce(list_var_pop(list_transform(ix, lambda i: p[i - 1] + p[i + 1] + p[i - {WIDTH}] + p[i + {WIDTH}] - 4 * p[i])), 0) blur,
  coalesce(list_avg(list_transform(list_filter(range(1, h * {WIDTH}), lambda i: i % {WIDTH} > 0), lambda i: abs(p[i + 1] - p[i]))), 0) across,
  coalesce(list_avg(list_transform(range(1, (h - 1) * {WIDTH} + 1), lambda i: abs(p[i + {WIDTH}] - p[i]))), 0) down
  from px join inner_ using (doc_id)) """
QUERIES = {"photo_pixels": photo_pixels, "photo_pixel_means": photo_pixel_means, "photo_copies": photo_copies}
ORACLES = {
    "photo_pixels": _PIXELS + f""", r as (select *, mean as brightness_mean, std as brightness_std, blur as blur_score, {WIDTH} as image_width, h as image_height from m),
s as (select *, concat_ws(',', {", ".join(f"case when {rule} then '{name}' end" for name, rule, _ in M.PHOTO_RULES)}) flags, round(greatest(0, 1 - {" - ".join(f"(case when {rule} then {price} else 0 end)::double" for _, rule, price in M.PHOTO_RULES)}), 6) score from r)
select doc_id, not cut as decode_ok, case when cut then 0 else {WIDTH} end as image_width, case when cut then 0 else h end as image_height, case when not cut then round(mean + {TIE}, 4) end as brightness_mean, case when not cut then round(std + {TIE}, 4) end as brightness_std, case when not cut then round(blur + {TIE}, 3) end as blur_score,
case when cut then 'decode_error' else flags end as issue_flags, case when cut then 0.0 else score end as quality_score, cut or score < 0.6 or flags <> '' as needs_review from s""",
    "photo_pixel_means": _PIXELS + f""", q as (select *, mean / 255 as b, (across + down) / 2 as s from m),
v as (select *, (least(1, {WIDTH} / 1280, h / 960) + greatest(0, 1 - abs(b - 0.5) / 0.5) + least(1, std / 40) + least(1, s / 8)) / 4 as score from q)
select doc_id, case when cut then 'decode_error' else 'success' end as status, 'false' as usable, case when cut then '["image_decode_failed"]' else '[' || concat_ws(',', '"resolution_too_low"', case when b < 0.1 then '"too_dark"' when b > 0.95 then '"too_bright"' end, case when std < 10 then '"low_contrast"' end, case when s < 1.5 then '"low_detail"' end, case when score < 0.4 then '"quality_score_below_threshold"' end) || ']' end as reasons from v""",
}
