"""From raw documents to token ids: reject toxic ones, keep one of each near-duplicate group, cut out repeated
passages, mix sources to target weights, encode.

Every stage reads what its predecessor kept, as written Parquet, and its decisions take effect. All but the last return
the columns of ``documents``; the last adds token counts, ids and digests in place of the text. Only the first stage
reads another table (``labels``), and learns from the rows outside the held-out fifth alone.

Defined cases. Null, empty and blank texts: not toxic, near copies of each
other (one of them stays), without passages, of no tokens, taken by the mix where its prefix reaches them, encoded as no
ids. Very long texts are processed whole in every stage. Rows that share a doc_id are judged each by its own text; of
repeated rows the near-dedup stage keeps one. Null lang or source is a node of the mix of its own. An empty
table gives an empty result, and without labels, or with too few for distances to separate, nothing is rejected. Columns besides those of ``documents``, whatever
their names, pass through every stage but the last, which keeps those that do not clash with what it adds.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, mixing, near_copies, substring_dedup, toxicity
from cairn.session import table
from cairn.storage import store

#: Share of the kept tokens that the mix may take, in hundredths; its weights are those of ``mixing.WEIGHTS``.
MIX_PERCENT = 90
#: What the last stage adds.
ENCODED = ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression distances score below 0.5."""
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash trees or by a five-word Jaccard similarity of 0.8 or more."""
    return near_copies.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses all its words stays, with an empty text."""
    kept = substring_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A single pass over the prefixes that the budgets allow."""
    return mixing.kept_once(docs, percent=MIX_PERCENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns besides text, and n_tokens, token_ids, ids_sha256, decoded_sha256."""
    rest = docs.drop(*ENCODED)
    return bpe.encoded_with_digests(rest, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: No SQL: learnt scores, fingerprints and token ids are not expressible in it. tests/llm holds each stage against a
#: plain version of it.
ORACLE_SQL = None


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages on any documents; each one's rows are written and reread, and its input is removed once read."""
    stored = None
    for name, stage in STAGES:
        made = store(stage(spark, docs if stored is None else stored.df, sf_dir), name)
        if stored is not None:
            stored.remove()
        stored = made
    return stored.df


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark, table(spark, sf_dir, "documents", spread=True), sf_dir)
