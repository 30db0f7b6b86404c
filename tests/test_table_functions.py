"""Table functions of SQL beside the operators that they stand for."""

from pyspark.sql import functions as F

from cairn.functions import html as H
from cairn.functions import tables as X
from cairn.operators import packets as P
from cairn.session import table

SF = "/root/testdata/sf0.001"


def test_page_blocks_are_those_of_the_operator(spark):
    X.register(spark)
    pages = table(spark, SF, "pages")
    got = spark.sql("select * from html_page_blocks(table(select page_id, html from {p}))", p=pages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, H.page_blocks(pages).collect()))
    odd = spark.createDataFrame([(1, None), (2, "")], "page_id bigint, html string")
    assert spark.sql("select * from html_page_blocks(table(select * from {p}))", p=odd).collect() == []


FORMS = [
    ("c", "a", '{"form":[{"id":1,"label":"question","text":" ","box":[0,0,5,9],"words":[{"text":"w"},{"text":" "},{"text":"v"}]},{"label":"answer","text":"ok","box":[3,3,3,4],"words":[]}]}'),
    ("c", "b", '{"form":[{"id":7,"text":null,"box":[1,2]},{"label":"x","box":null}]}'), ("d", "n", None), ("d", "m", '{"other":1}'), ("d", "e", '{"form":[]}'),
]


def test_form_spans_are_those_of_the_operator(spark):
    X.register(spark)
    forms = spark.createDataFrame(FORMS, "claim_id string, file_id string, annotation_json string")
    got = spark.sql("select * from claim_form_spans(table(select claim_id, file_id, annotation_json from {f}))", f=forms)
    want = P.form_spans(forms)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert spark.sql("select * from claim_form_spans(table(select 'c', 'f', 'broken'))").collect() == []


def test_leading_rows_end_early(spark):
    X.register(spark)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.lpad(F.col("id").cast("string"), 8, "0").alias("at"), F.col("id").cast("string").alias("v"))
    got = spark.sql("select * from leading_rows(table(select g, at, v from {r}) partition by g order by (at desc), 2)", r=rows).collect()
    want = rows.groupBy("g").agg(F.slice(F.sort_array(F.collect_list("at"), asc=False), 1, 2).alias("top")).collect()
    assert sorted((r.part, r.place, r["at"]) for r in got) == sorted((r.g, i, a) for r in want for i, a in enumerate(r.top, 1))


def test_photos_of_packets_are_told_apart_once(spark, capsys):
    """Every part of the summary reads the stored photos: none makes them from the lines again."""
    from cairn.plans import assets

    assets.claim_summary(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "lineitem.parquet" not in plan and "packet-photos" in plan
