"""Scores of predictions: confusion counts, set overlap, accuracy and macro F1 over a fixed label set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn; null where a denominator is nought."""
    out = counts.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(rows: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn and their rates, of all rows or a group."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    return _rates(rows.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")))


def set_overlap(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Confusion of two sets a row: any common element is a hit; only one side filled is a miss of the other."""
    hit = F.coalesce(F.arrays_overlap(predicted, actual), F.lit(False))
    p, a = F.size(predicted) > 0, F.size(actual) > 0
    return _rates(rows.agg(F.count_if(hit).alias("tp"), F.count_if(~hit & p).alias("fp"), F.count_if(~hit & a).alias("fn"), F.count_if(~p & ~a).alias("tn")))


#: White space as Python's ``\s`` sees it, as a class of Java's patterns.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def macro_scores(
    rows: DataFrame, labels: list[str], predicted: str = "predicted", actual: str = "actual", queues: dict[str, str] | None = None
) -> DataFrame:
    """accuracy, macro_f1 over ``labels``, queue_accuracy and records, as one row; a label that never occurs counts as
    nought, a null prediction as wrong. ``queues`` tells the queue of a label; any other value is a queue of its own.

    Rows are counted by pairs of labels first, values of no label folded into one: what is left is small.
    """
    known = lambda c: F.when(F.col(c).isin(labels), F.col(c))
    of = F.create_map(*(F.lit(x) for pair in (queues or {"": ""}).items() for x in pair))
    queue = lambda c: F.coalesce(F.try_element_at(of, F.col(c)), F.col(c))
    right = lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))
    pairs = rows.groupBy(known(predicted).alias("p"), known(actual).alias("a")).agg(
        F.count("*").alias("n"), F.sum(right(F.col(predicted), F.col(actual))).alias("same"), F.sum(right(queue(predicted), queue(actual))).alias("queued")
    )
    table = pairs.agg(F.collect_list(F.struct(F.coalesce("p", F.lit("")).alias("p"), F.coalesce("a", F.lit("")).alias("a"), "n")).alias("t"), *(F.sum(c).alias(c) for c in ("n", "same", "queued")))
    total = lambda keep: F.aggregate(F.filter("t", keep), F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["n"])

    def f1(label: str) -> Column:
        hit, said, true = total(lambda x: (x["p"] == label) & (x["a"] == label)), total(lambda x: x["p"] == label), total(lambda x: x["a"] == label)
        return F.coalesce(F.try_divide(2 * hit, said + true), F.lit(0.0))

    macro = sum((f1(x) for x in labels), F.lit(0.0)) / len(labels)
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    return table.select(share("same").alias("accuracy"), macro.alias("macro_f1"), share("queued").alias("queue_accuracy"), F.coalesce("n", F.lit(0)).alias("records"))


def keyword_intent(text: Column, keywords: dict[str, list[str]], other: str = "other") -> Column:
    """The intent with the most keywords in the text, white space aside, if one alone has them; native, read once."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _SPACE, "")
    start = F.struct(F.lit(0).alias("n"), F.lit(other).alias("intent"))

    def best(t: Column) -> Column:
        hits = F.array(*(F.struct(sum((t.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(name).alias("intent")) for name, words in keywords.items()))
        tie = lambda top, h: F.struct(top["n"].alias("n"), F.when((h["n"] == top["n"]) & (h["n"] > 0), other).otherwise(top["intent"]).alias("intent"))
        return F.aggregate(hits, start, lambda top, h: F.when(h["n"] > top["n"], h).otherwise(tie(top, h)))["intent"]

    return F.transform(F.array(bare), best)[0]


def transcript_problem(text: Column, segments: Column | None = None, duration_ms: Column | None = None) -> Column:
    """Why a transcript is not to be trusted, else null: it is empty, or something repeats four times in a row, white
    space aside; with ``segments`` (array of structs with start_ms and end_ms), also times outside the recording or
    segments out of order. A missing time or duration counts as outside."""
    bare = F.regexp_replace(text, _SPACE, "")
    found = F.when(F.coalesce(bare, F.lit("")) == "", "empty").when(bare.rlike(r"(.{2,20})\1{3,}"), "repetition")
    if segments is None:
        return found
    duration = F.lit(None).cast("bigint") if duration_ms is None else duration_ms
    inside = lambda w: (w["start_ms"] >= 0) & (w["start_ms"] <= w["end_ms"]) & (w["end_ms"] <= duration)
    starts = F.transform(segments, lambda w: w["start_ms"])
    found = found.when(F.exists(segments, lambda w: ~F.coalesce(inside(w), F.lit(False))), "outside_recording")
    return found.when(starts != F.array_sort(starts), "out_of_order")
