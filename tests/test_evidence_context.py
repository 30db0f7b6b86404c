"""Evidence of cases is dealt out once; cases that share an id get the evidence of each, as in the SQL."""

import os

import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from cairn.plans import evidence as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", ["evidence_agent_context", "evidence_status_summary"])
def test_repeated_cases_and_cases_without_evidence(spark, tmp_path, name):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    later = orders.withColumn("o_orderdate", F.expr("o_orderdate - interval 80 days")).where("o_orderkey % 5 = 0")
    orders.unionByName(later).unionByName(orders.where("o_orderkey % 15 = 0")).write.parquet(f"{tmp_path}/orders.parquet")
    lines.where("l_orderkey % 4 <> 0").unionByName(lines.where("l_orderkey % 9 = 1").selectExpr("* except (l_orderkey)", "l_orderkey + 100000000 as l_orderkey").select(lines.columns)).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert same_rows(spark, P.QUERIES[name], P.ORACLES[name], str(tmp_path)) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
def test_lines_are_sent_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.agent_context(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 3  # lines, cases, requirements
