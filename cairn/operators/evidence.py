"""Evidence governance: gaps, conflicts, staleness and risk of the cases' evidence, and the queue for review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of evidence; fixed values.
MODALITIES = ("text", "image", "audio", "document")
#: Days after which evidence is stale at review, and flags that do not block; fixed values.
FRESHNESS_DAYS = 30
#: Order of the review queue.
QUEUE_ORDER = {"blocked": 0, "needs_review": 1}


def evidence_gaps(requirements: DataFrame, features: DataFrame) -> DataFrame:
    """Required (case_id, evidence_type) pairs that no evidence meets: an anti-join."""
    missing = requirements.join(features.select("case_id", "evidence_type"), ["case_id", "evidence_type"], "left_anti")
    return missing.select("case_id", F.col("evidence_type").alias("missing_evidence_type"), F.lit("missing_required_evidence").alias("reason"))


def evidence_conflicts(features: DataFrame) -> DataFrame:
    """Claims of a case that evidence gives more than one value, with the values and the evidence in order."""
    told = features.where("claim_key <> '' and claim_value <> ''").groupBy("case_id", "claim_key")
    found = told.agg(F.array_sort(F.collect_set("claim_value")).alias("v"), F.array_sort(F.collect_list("record_id")).alias("r")).where(F.size("v") > 1)
    return found.select("case_id", "claim_key", F.size("v").cast("bigint").alias("distinct_values"), F.array_join("v", ", ").alias("claim_values"), F.array_join("r", ", ").alias("evidence_ids"))


def evidence_rollup(features: DataFrame) -> DataFrame:
    """One row a case with evidence: counts, its evidence ``e`` in order of observation, the latest first, the kinds of evidence
    it has, and how many of its claims have evidence of more than one value. One grouping by case: features that are already
    dealt out by case are not sent again, whatever texts they hold."""
    key = F.struct((-F.unix_date("observed_at")).alias("late"), "record_id", "asset_id", F.concat(F.lit("["), "modality", F.lit("/"), "source_system", F.lit("] "), "evidence_title", F.lit(": "), "evidence_text").alias("context"))
    told = F.when(F.expr("claim_key <> '' and claim_value <> ''"), F.struct("claim_key", "claim_value"))
    listed = features.groupBy("case_id").agg(
        F.count("*").alias("evidence_count"), F.count_if(F.col("asset_decision") == "rejected").alias("rejected_asset_count"),
        F.sum("risk_count").cast("bigint").alias("risk_count"), F.sum("blocking_risk_count").cast("bigint").alias("blocking_risk_count"),
        F.array_sort(F.collect_list(key)).alias("e"), F.array_sort(F.collect_set("source_system")).alias("source_systems"), F.array_sort(F.collect_set("modality")).alias("modalities"), F.array_sort(F.collect_set("license_id")).alias("license_ids"),
        F.collect_set("evidence_type").alias("types"), F.collect_set(told).alias("told"),
    )
    keys = F.transform("told", lambda x: x["claim_key"])
    several = F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1)
    sizes = {n: F.size(c).cast("bigint") for n, c in (("source_count", "source_systems"), ("modality_count", "modalities"), ("conflict_count", several))}
    return listed.withColumns(sizes).drop("told")


def agent_context(cases: DataFrame, requirements: DataFrame, features: DataFrame, days: int = FRESHNESS_DAYS) -> DataFrame:
    """Every case with what is known of it and its state: blocked, needs_review or ready.

    Cases, requirements and evidence meet by case alone. A case_id that several cases have gets the evidence of each of them.
    """
    same = Window.partitionBy("case_id")
    named = cases.withColumns({"n": F.when(F.col("case_id").isNotNull(), F.count("*").over(same)), "dues": F.collect_list(F.struct("review_due_at")).over(same)})
    needed = requirements.groupBy("case_id").agg(F.collect_list(F.struct("evidence_type")).alias("needed"))
    rows = named.join(evidence_rollup(features), "case_id", "left").join(needed, "case_id", "left")
    lacks = F.size(F.filter("needed", lambda x: ~F.coalesce(F.array_contains("types", x["evidence_type"]), F.lit(False))))
    stale = F.aggregate("dues", F.lit(0), lambda n, d: n + F.size(F.filter("e", lambda x: F.unix_date(d["review_due_at"]) + x["late"] > days)))
    each = lambda name: F.transform("listed", lambda x: x[name])
    counts = {c: F.col(c) * F.col("n") for c in ("evidence_count", "rejected_asset_count", "risk_count", "blocking_risk_count")}
    counts |= {c: F.col(c) for c in ("source_count", "modality_count", "conflict_count")} | {"stale_evidence_count": F.when(F.col("e").isNotNull(), stale), "missing_evidence_count": F.when(F.col("needed").isNotNull(), lacks)}
    order = ["evidence_count", "source_count", "modality_count", "rejected_asset_count", "risk_count", "blocking_risk_count", "stale_evidence_count"]
    rows = rows.withColumn("listed", F.when(F.col("n") > 1, F.flatten(F.transform("e", lambda x: F.array_repeat(x, F.col("n").cast("int"))))).otherwise(F.col("e")))
    whole = {c: F.coalesce(counts[c], F.lit(0)).cast("bigint") for c in counts}
    texts = {"evidence_ids": each("record_id"), "asset_ids": each("asset_id")} | {c: F.col(c) for c in ("source_systems", "modalities", "license_ids")}
    texts = {c: F.coalesce(x, F.array().cast("array<string>")) for c, x in texts.items()} | {"context_text": F.coalesce(F.array_join(each("context"), "\n"), F.lit(""))}
    names = ["source_systems", "modalities", "license_ids", "evidence_ids", "asset_ids", "context_text"]
    rows = rows.select(*cases.columns, *(whole[c].alias(c) for c in order), *(texts[c].alias(c) for c in names), *(whole[c].alias(c) for c in ("missing_evidence_count", "conflict_count")))
    blocked = (F.col("missing_evidence_count") > 0) | (F.col("conflict_count") > 0) | (F.col("blocking_risk_count") > 0)
    state = F.when(blocked, "blocked").when((F.col("stale_evidence_count") > 0) | (F.col("risk_count") > 0), "needs_review").otherwise("ready")
    return rows.withColumn("context_id", F.concat(F.lit("ctx-"), F.col("case_id").cast("string"))).withColumn("review_state", state)


def queue_place(state: Column) -> Column:
    place = F.lit(len(QUEUE_ORDER))
    for name, at in QUEUE_ORDER.items():
        place = F.when(state == name, at).otherwise(place)
    return place


def review_queue(context: DataFrame) -> DataFrame:
    """Cases that are not ready, in the order in which they are to be reviewed: by ``queue_place``, then by case.

    The order is a sort by ranges; a limit on it keeps the first rows of each task alone.
    """
    return context.where("review_state <> 'ready'").withColumn("queue_place", queue_place(F.col("review_state"))).orderBy("queue_place", context.columns[0])


def status_summary(context: DataFrame) -> DataFrame:
    return context.groupBy("review_state").agg(F.count("*").alias("cases"), F.sum("evidence_count").cast("bigint").alias("evidence_records"))


def _listed(once: DataFrame, names: list[str]) -> DataFrame:
    """(check, violations) of a single row whose columns r0, r1 ... are the counts of ``names``."""
    return once.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(f"r{i}", F.lit(0)).cast("bigint").alias("violations")) for i, name in enumerate(names)))).alias("x")).select("x.*")


def _told(table: DataFrame, rules: dict[str, Column], repeated: str | None = None, *keys: str) -> DataFrame:
    """(check, violations) of rules about single rows and, under the name ``repeated``, of keys that occur twice: one pass."""
    counts = [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    if repeated is None:
        return _listed(table.agg(*counts), list(rules))
    by_key = table.groupBy(*keys).agg(*counts, F.count("*").alias("n"))
    sums = [F.sum(f"r{i}").alias(f"r{i}") for i in range(len(rules))]
    return _listed(by_key.agg(*sums, F.count_if(F.col("n") > 1).alias(f"r{len(rules)}")), [*rules, repeated])


def _met(key: str, **tables: DataFrame) -> DataFrame:
    """Rows of each table by a key that they share, as columns: one exchange of keys, summed up before it."""
    rows = reduce(DataFrame.unionByName, (t.select(F.col(key).alias("key"), F.lit(name).alias("of")) for name, t in tables.items()))
    return rows.groupBy("key").agg(*(F.count_if(F.col("of") == name).alias(name) for name in tables))


def source_integrity(cases: DataFrame, requirements: DataFrame, evidence: DataFrame, assets: DataFrame) -> DataFrame:
    """(check, violations): the eighteen named counts that must all be nought before anything is governed.

    Rules of rows and repeated keys of a table are counted in one pass, references in one exchange of keys for all tables
    that share them. A null key refers to nothing.
    """
    c = F.col
    blank = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    any_blank = lambda *names: reduce(lambda a, b: a | b, map(blank, names))
    by_case, by_asset = _met("case_id", cases=cases, needs=requirements, proofs=evidence), _met("asset_id", media=assets, proofs=evidence)
    unknown = lambda of, n: F.sum(F.when(c("key").isNull() | (c(of) == 0), c(n)).otherwise(0))
    checks = [
        _told(cases, {"empty case field": any_blank("case_id", "account_id", "business_question"), "case with invalid review date": c("review_due_at").isNull()}),
        _told(requirements, {"empty requirement field": any_blank("case_id", "evidence_type"), "unsupported requirement modality": ~c("evidence_type").isin(*MODALITIES)}, "duplicate requirement", "case_id", "evidence_type"),
        _told(evidence, {
            "empty evidence field": any_blank("record_id", "case_id", "asset_id", "source_system", "evidence_title"), "evidence with invalid observation date": c("observed_at").isNull(),
            "evidence with incomplete claim": blank("claim_key") != blank("claim_value"),
        }, "duplicate evidence record_id", "record_id"),
        _told(assets, {"empty asset field": any_blank("asset_id", "modality", "source_uri", "license_id", "mime_type", "expected_sha256"), "invalid asset SHA-256": ~c("expected_sha256").rlike("^[0-9a-fA-F]{64}$")}),
        _listed(
            by_case.agg(F.count_if(c("cases") > 1).alias("r0"), unknown("cases", "needs").alias("r1"), unknown("cases", "proofs").alias("r2"), unknown("needs", "cases").alias("r3")),
            ["duplicate case_id", "requirement with unknown case", "evidence with unknown case", "case without requirement"],
        ),
        _listed(by_asset.agg(F.count_if(c("media") > 1).alias("r0"), unknown("media", "proofs").alias("r1")), ["duplicate asset_id", "evidence with unknown asset"]),
        _listed(evidence.join(cases.select("case_id", "review_due_at"), "case_id").where(c("observed_at") > c("review_due_at")).agg(F.count("*").alias("r0")), ["evidence observed after review date"]),
    ]
    return reduce(DataFrame.unionByName, checks)
