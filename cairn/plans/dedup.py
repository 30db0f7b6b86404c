"""Queries of near-duplicate web text over ``documents``: source stands for the domain, n_chars for recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import dedup as D
from cairn.operators import pairs as E
from cairn.session import table
from cairn.storage import store


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "source", "n_chars", "text")
    return store(T.fingerprints(docs), "prints").df


def _scored(heads: DataFrame) -> DataFrame:
    return D.scored_pairs(D.candidate_pairs(heads, None), heads)


def _members(prints: DataFrame) -> DataFrame:
    return D.clusters(prints).join(prints.select("doc_id", "source", "n_chars", "token_count"), "doc_id")


def _chosen(members: DataFrame) -> DataFrame:
    falling = lambda c: F.struct(F.col(c).isNull(), -F.col(c))
    return D.representatives(members, F.struct(falling("n_chars"), falling("token_count"), "doc_id"))


def fingerprint_counts(spark, sf_dir):
    return _prints(spark, sf_dir).select("doc_id", "token_count", "unique_tokens", F.size("shingles").cast("bigint").alias("shingle_count"), F.concat_ws(",", "signature").alias("signature"))


def collision_buckets(spark, sf_dir):
    return D.collision_buckets(D.exploded_bands(_prints(spark, sf_dir)))


def candidate_pairs(spark, sf_dir):
    """All pairs of texts that share a band, made of the pairs of classes of equal shingles. Shingles are told by their digest
    and not stored: one stands for whether there are any."""
    prints = T.fingerprints(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))
    prints = prints.select("doc_id", "bands", "shingles_sha256", F.slice("shingles", 1, 1).alias("shingles"))
    member, heads = D.folded(store(prints, "prints").df)
    return D.unfolded(D.candidate_pairs(heads, None), member, D.equal_scores())


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.withColumn("shingle_jaccard", F.round("shingle_jaccard", 6)).withColumn("signature_overlap", F.round("signature_overlap", 6))


def scored_pairs(spark, sf_dir):
    """``candidate_pairs`` with their scores."""
    member, heads = D.folded(_prints(spark, sf_dir))
    return D.unfolded(_rounded(_scored(heads)), member, D.equal_scores())


def clusters(spark, sf_dir):
    return D.clusters(_prints(spark, sf_dir))


def representatives(spark, sf_dir):
    return _chosen(_members(_prints(spark, sf_dir)))


def cluster_inspection(spark, sf_dir):
    prints = _prints(spark, sf_dir)
    members = store(_members(prints), "cluster-members").df
    member, heads = D.folded(prints)
    found = D.cluster_inspection(members, _chosen(members), store(_scored(heads), "scored").df, member)
    return found.withColumn("weakest_shingle_jaccard", F.round("weakest_shingle_jaccard", 6)).withColumn("weakest_signature_overlap", F.round("weakest_signature_overlap", 6))


def candidate_summary(spark, sf_dir):
    prints = _prints(spark, sf_dir)
    member, heads = D.folded(prints)
    return D.candidate_summary(prints, D.candidate_pairs(heads, None), member)


def domain_summary(spark, sf_dir):
    prints = _prints(spark, sf_dir)
    member, heads = D.folded(prints)
    return D.domain_summary(prints.select("doc_id", F.col("source").alias("domain")), _scored(heads), member)


def duplicate_summary(spark, sf_dir):
    prints = _prints(spark, sf_dir)
    record = prints.select("doc_id", F.col("source").alias("record"), F.concat_ws("/", F.col("source"), F.col("n_chars").cast("string")).alias("url"))
    member, heads = D.folded(prints)
    return D.duplicate_summary(_scored(heads), record, member)


def exact_duplicates(spark, sf_dir):
    groups = _prints(spark, sf_dir).groupBy("normalized_sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    return groups.where("copies > 1")


def blake2b_bands(spark, sf_dir):
    """Keyed digests instead of affine permutations, over the benchmark's items: items by band key."""
    prints = T.fingerprints(table(spark, sf_dir, "benchmark", spread=True).select(F.col("item_id").alias("doc_id"), "text"), "blake2b")
    return D.exploded_bands(prints).groupBy("band", "key").agg(F.count("*").alias("items"), F.min("doc_id").alias("first_item"))


_PERM = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(T.permutations()))
_BASE = rf"""with recursive perm(i, a, b) as (values {_PERM}),
norm as materialized (select doc_id, source, n_chars, trim(regexp_replace(lower(strip_accents(text)), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')) as t from documents),
words as materialized (select *, case when t = '' then [] else string_split(t, ' ') end as w from norm),
grams as materialized (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - {T.SHINGLE} + 2, 2)), lambda i: array_to_string(w[i:i + {T.SHINGLE - 1}], ' '))) as x from words where len(w) > 0),
hashed as materialized (select doc_id, ('0x' || left(md5(x), 7))::bigint as h from grams),
sig as materialized (select doc_id, i, min((a * h + b) % {T.PRIME}) as m from hashed, perm group by all),
bands as materialized (select doc_id, (i // {T.PERMUTATIONS // T.BANDS})::int as band, md5(string_agg(m::varchar, ',' order by i)) as key from sig group by doc_id, i // {T.PERMUTATIONS // T.BANDS}),
buckets as (select band, key, count(*) as members, (count(*) * (count(*) - 1) // 2)::bigint as pair_slots from bands group by all having count(*) > 1),
pairs as materialized (select l.doc_id as left_id, r.doc_id as right_id, count(*) as shared_bands from bands l join bands r on l.band = r.band and l.key = r.key and l.doc_id < r.doc_id group by all),
sizes as materialized (select doc_id, count(*) as n from grams group by 1),
common as (select left_id, right_id, shared_bands, count(*) as c from pairs join grams l on l.doc_id = left_id join grams r on r.doc_id = right_id and r.x = l.x group by all),
agree as (select left_id, right_id, count(*) filter (where l.m = r.m) / {T.PERMUTATIONS} as o from pairs join sig l on l.doc_id = left_id join sig r on r.doc_id = right_id and r.i = l.i group by all),
exact as (select p.*, coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)) as j, o from pairs p left join common using (left_id, right_id, shared_bands) join agree using (left_id, right_id) join sizes a on a.doc_id = left_id join sizes b on b.doc_id = right_id),
scored as materialized (select left_id, right_id, shared_bands, j as shingle_jaccard, o as signature_overlap, j >= {D.THRESHOLD} as is_duplicate,
  case when j = 1 then 'exact_shingle_match' when j >= {D.THRESHOLD} then 'jaccard_match' when o >= {D.THRESHOLD} then 'minhash_only_rejected' else 'below_threshold' end as reason from exact),
und as materialized (select left_id as a, right_id as b from scored where is_duplicate union all select right_id, left_id from scored where is_duplicate),
reach(u, l) as (select doc_id, doc_id from documents union select und.b, r.l from reach r join und on und.a = r.u where r.l < und.b),
roots as materialized (select u as doc_id, min(l) as root from reach group by u),
members as materialized (select doc_id, 'cluster-' || root as cluster_id, count(*) over (partition by root) as cluster_size, source, n_chars, len(w)::bigint as token_count from roots join words using (doc_id)),
chosen as (select * exclude (rn) from (select *, row_number() over (partition by cluster_id order by n_chars desc, token_count desc, doc_id) as rn from members) where rn = 1)
"""

def exact_pairs(spark, sf_dir):
    """Every pair of classes of equal texts with the similarity, whatever bands they share, and how many texts each has."""
    pairs, member = E.similar_pairs(_prints(spark, sf_dir), D.THRESHOLD)
    sizes = member.groupBy("class").agg(F.count("*").alias("texts"))
    side = lambda s: sizes.select(F.col("class").alias(f"{s}_id"), F.col("texts").alias(f"{s}_texts"))
    return pairs.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("shingle_jaccard", F.round("shingle_jaccard", 6))


QUERIES = {
    "dedup_exact_pairs": exact_pairs,
    "dedup_fingerprint_counts": fingerprint_counts, "dedup_collision_buckets": collision_buckets, "dedup_candidate_pairs": candidate_pairs, "dedup_scored_pairs": scored_pairs,
    "dedup_clusters": clusters, "dedup_representatives": representatives, "dedup_cluster_inspection": cluster_inspection, "dedup_candidate_summary": candidate_summary,
    "dedup_domain_summary": domain_summary, "dedup_duplicate_summary": duplicate_summary, "dedup_exact_duplicates": exact_duplicates, "dedup_blake2b_bands": blake2b_bands,
}
_R = "round(shingle_jaccard, 6) as shingle_jaccard, round(signature_overlap, 6) as signature_overlap"
ORACLES = {
    "dedup_exact_pairs": _BASE + f""", digests as (select doc_id, md5(string_agg(x, '|' order by x)) as d from grams group by 1),
firsts as (select d, min(doc_id) as id, count(*) as texts from digests group by 1), g as materialized (select id, texts, x from grams join firsts on id = doc_id),
met as (select l.id as left_id, r.id as right_id, l.texts as left_texts, r.texts as right_texts, count(*) as c from g l join g r on l.x = r.x and l.id < r.id group by all)
select left_id, right_id, left_texts, right_texts, round(c / (a.n + b.n - c), 6) as shingle_jaccard from met join sizes a on a.doc_id = left_id join sizes b on b.doc_id = right_id where c / (a.n + b.n - c) >= {D.THRESHOLD}""",
    "dedup_fingerprint_counts": _BASE + f"select doc_id, len(w)::bigint as token_count, len(list_distinct(w))::bigint as unique_tokens, coalesce(n, 0)::bigint as shingle_count, coalesce((select string_agg(m::varchar, ',' order by i) from sig where sig.doc_id = words.doc_id), '{','.join(['0'] * T.PERMUTATIONS)}') as signature from words left join sizes using (doc_id)",
    "dedup_collision_buckets": _BASE + "select * from buckets",
    "dedup_candidate_pairs": _BASE + "select * from pairs",
    "dedup_scored_pairs": _BASE + f"select left_id, right_id, shared_bands, {_R}, is_duplicate, reason from scored",
    "dedup_clusters": _BASE + "select doc_id, cluster_id, cluster_size from members",
    "dedup_representatives": _BASE + "select * from chosen",
    "dedup_cluster_inspection": _BASE
    + """, edges as (select cluster_id, count(*) as duplicate_edge_rows, round(min(shingle_jaccard), 6) as weakest_shingle_jaccard, round(min(signature_overlap), 6) as weakest_signature_overlap from scored join members on doc_id = left_id where is_duplicate group by 1)
select cluster_id, cluster_size, count(distinct m.source) as source_count, string_agg(m.doc_id::varchar, ', ' order by m.doc_id) as member_doc_ids, any_value(c.doc_id) as representative_doc_id, any_value(duplicate_edge_rows) as duplicate_edge_rows,
  any_value(weakest_shingle_jaccard) as weakest_shingle_jaccard, any_value(weakest_signature_overlap) as weakest_signature_overlap
from members m join (select cluster_id, doc_id from chosen) c using (cluster_id) left join edges using (cluster_id) where cluster_size > 1 group by cluster_id, cluster_size""",
    "dedup_candidate_summary": _BASE + "select n as document_rows, (n * (n - 1) // 2)::bigint as possible_pair_rows, c as candidate_pair_rows, round(1 - c / (n * (n - 1) // 2), 4) as candidate_reduction_ratio from (select count(*) as n from documents), (select count(*) as c from pairs)",
    "dedup_domain_summary": _BASE
    + """select domain, document_rows, (document_rows * (document_rows - 1) // 2)::bigint as possible_pair_rows, coalesce(c, 0) as candidate_pair_rows, coalesce(d, 0) as duplicate_pair_rows,
  case when document_rows < 2 then 0.0 else round(1 - coalesce(c, 0) / (document_rows * (document_rows - 1) // 2), 4) end as candidate_reduction_ratio
from (select source as domain, count(*) as document_rows from documents group by 1) left join (select l.source as domain, count(*) as c, count(*) filter (where is_duplicate) as d from scored join documents l on l.doc_id = left_id join documents r on r.doc_id = right_id and r.source = l.source group by 1) using (domain)""",
    "dedup_duplicate_summary": _BASE
    + """select count(*) as duplicate_pair_rows, count(*) filter (where shingle_jaccard = 1) as exact_duplicate_pair_rows, count(*) filter (where shingle_jaccard < 1) as near_duplicate_pair_rows,
  count(*) filter (where l.source = r.source) as within_record_pair_rows, count(*) filter (where l.source <> r.source) as cross_record_pair_rows, count(*) filter (where l.source || '/' || l.n_chars <> r.source || '/' || r.n_chars) as cross_url_pair_rows
from scored join documents l on l.doc_id = left_id join documents r on r.doc_id = right_id where is_duplicate""",
    "dedup_exact_duplicates": _BASE + "select sha256(t) as normalized_sha256, count(*) as copies, min(doc_id) as first_doc_id, max(doc_id) as last_doc_id from norm group by 1 having count(*) > 1",
}
