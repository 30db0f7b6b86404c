"""All pairs of a set similarity, exactly, without bands and without a budget: an inverted index over prefixes.

Sets (shingles of texts) that are equal are one class, named after its smallest id, so copies are never paired. The
shingles of a class are put in order of how many classes hold them. Two sets of similarity t or more share one of the
first n - ceil(t n) + 1 shingles of either; so only these enter the index, and of them only those that some other class
holds at all. Rows of the index meet on a shingle, where sizes and places leave room for the similarity; pairs are then
told apart and held against their whole sets, once each.

Every step is a plain join or a partial aggregate that spills: no bucket, class or list of pairs is held by a task, and a
shingle that many classes begin with is a hot key of a join, which adaptive execution splits. Work follows the pairs of the
result and near misses, not all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.storage import store

#: Room for rounding where a bound is computed from a similarity in doubles.
_EPS = 1e-9


def set_digest(prints: DataFrame) -> Column:
    """A digest that texts of equal shingles share; texts without any have their own. That of the fingerprints where it is there."""
    made = F.col("shingles_sha256") if "shingles_sha256" in prints.columns else F.sha2(F.concat_ws(",", F.sort_array("shingles").cast("array<string>")), 256)
    return F.when(F.size("shingles") > 0, made).otherwise(F.concat(F.lit("empty-"), F.col("doc_id").cast("string")))


def classes(prints: DataFrame) -> DataFrame:
    """(doc_id, class): texts of equal shingles have one class, the smallest doc_id of them; texts without any their own."""
    rows = prints.select("doc_id", set_digest(prints).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("class"))
    return rows.join(firsts, "digest").select("doc_id", "class")


def _least_overlap(n: Column, threshold: float) -> Column:
    """How many members of a set of ``n`` the other one must hold."""
    return F.ceil(n * threshold - _EPS)


def prefixes(heads: DataFrame, threshold: float) -> DataFrame:
    """(shingle, id, n, place): the index; places count from 1 in order of frequency."""
    each = heads.select(F.col("doc_id").alias("id"), F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    # Shingles of one class alone come first and meet nothing: they are counted, not sent.
    shared = each.join(common, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("s"))
    alone = F.col("n") - F.size("s")
    room = F.col("n") - _least_overlap(F.col("n"), threshold) + 1 - alone
    rows = shared.where(room > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), room.cast("int"))).alias("k", "x"))
    return rows.select(F.col("x.shingle").alias("shingle"), "id", "n", (F.col("alone") + F.col("k") + 1).alias("place"))


def candidates(index: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id) of rows that meet where the similarity is still possible."""
    side = lambda s: index.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "place")))
    met = side("left").join(side("right"), "shingle").where("left_id < right_id")
    sizes = (F.col("left_n") >= F.col("right_n") * threshold - _EPS) & (F.col("right_n") >= F.col("left_n") * threshold - _EPS)
    left = 1 + F.least(F.col("left_n") - F.col("left_place"), F.col("right_n") - F.col("right_place"))
    needed = F.ceil((F.col("left_n") + F.col("right_n")) * (threshold / (1 + threshold)) - _EPS)
    return met.where(sizes & (left >= needed)).select("left_id", "right_id").distinct()


def similar_pairs(prints: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(left_id, right_id, shingle_jaccard) of all pairs of classes with the similarity, and (doc_id, class).

    ``prints`` has doc_id and shingles (distinct), best in a stored table. Ids that repeat are an error of the caller;
    nulls among them have no pairs. Texts without shingles are in no pair.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0, and 1 at most")
    member = store(classes(prints.where("doc_id is not null")), "pair-classes")
    heads = store(prints.select("doc_id", "shingles").where("size(shingles) > 0").join(member.df.select(F.col("class").alias("doc_id")).distinct(), "doc_id", "left_semi"), "pair-heads")
    index = store(prefixes(heads.df, threshold), "pair-index")
    pairs = store(candidates(index.df, threshold), "pair-candidates")
    index.remove()
    side = lambda s: heads.df.select(F.col("doc_id").alias(f"{s}_id"), F.col("shingles").alias(f"{s}_shingles"))
    both = pairs.df.join(side("left"), "left_id").join(side("right"), "right_id")
    shared = F.size(F.array_intersect("left_shingles", "right_shingles"))
    scored = both.withColumn("shingle_jaccard", shared / (F.size("left_shingles") + F.size("right_shingles") - shared))
    return scored.where(F.col("shingle_jaccard") >= threshold).select("left_id", "right_id", "shingle_jaccard"), member.df
