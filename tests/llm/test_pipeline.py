"""Each stage against a plain version of it, on the smallest tables."""

import hashlib
import os

import public_tokenizers
import pytest
from test_near_copies import brute as brute_groups
from test_substring_dedup import brute

from cairn.llm import bpe, mixing, toxicity
from cairn.llm import pipeline as P
from cairn.storage import store

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    columns = docs.columns
    stages = {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = store(stage(spark, docs, SF), name).df
        stages[name] = before, {r.doc_id: r for r in docs.collect()}
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = stages["toxicity"]
    scores = toxicity.Scorer(model).scores([r.text.encode() for r in before.values()])
    assert set(after) == {d for d, s in zip(before, scores, strict=True) if s < 0.5}
    before, after = stages["simhash_near_dedup"]
    assert set(after) == set(brute_groups([(d, r.text) for d, r in before.items()]).values()) and len(after) < len(before)
    before, after = stages["substring_dedup"]
    assert set(after) == set(before)
    for d, _, removed, kept in brute([(d, r.text) for d, r in before.items()], 50):
        text = after[d].text
        assert hashlib.sha256(" ".join(text.split()).encode()).hexdigest() == kept and after[d].n_chars == len(text)
        assert removed or text == before[d].text
    before, after = stages["mixing"]
    spent = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(list(before.values()), "doc_id bigint, text string, lang string, source string, n_chars bigint"), percent=P.MIX_PERCENT, epochs=1).collect()}
    assert set(after) == set(spent) and 0 < len(after) < len(before)
    before, after = stages["byte_level_bpe"]
    coder = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for d, r in after.items():
        assert r.token_ids == coder.encode_ordinary(before[d].text) and r.decoded_sha256 == hashlib.sha256(before[d].text.encode()).hexdigest()
    assert set(after) == set(before)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n_tokens string, __of int"


def test_defined_cases(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns named as the operators' own."""
    long = " ".join(f"w{i % 7001}x{i % 13}" for i in range(60_000))
    words = [f"plain{i} words{i % 3}" for i in range(60)]
    rows = [
        (1, None, None, None, None, None, None, None), (2, "", "en", "src0", 0, "k", "t", 1), (3, " \t\n", "en", "src0", 3, "k", "t", 1),
        (4, long, "de", "src1", len(long), "k", "t", 2), (5, long + " tail", "de", "src1", len(long) + 5, "k", "t", 2),
        (6, " ".join(words), "en", "src2", 0, "k", "t", 3), (6, " ".join(words), "en", "src2", 0, "k", "t", 3),
        (6, "another text of the same id", "en", "src2", 27, "k", "t", 4), (None, "no id at all here", "fr", "src3", 17, "k", "t", 5),
        (7, " ".join([*words[:58], *(f"other{i}" for i in range(400))]), "en", "src2", 0, "k", "t", 6),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = P.apply(spark, docs, SF).collect()
    assert all(hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in r.token_ids)).hexdigest() == r.ids_sha256 and r.n_tokens == len(r.token_ids) for r in out)
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) + (ids.count(6) == 2) and not {2, 3, 5} & set(ids) and {"key", "__of"} <= set(out[0].asDict())
    kept = {r.doc_id: r for r in P.near_dedup(spark, docs, SF).collect() if r.doc_id != 6}
    assert set(kept) == {1, 4, None, 7} and P.near_dedup(spark, docs, SF).where("doc_id = 6").count() == 2
    cut = {r.doc_id: r for r in P.cut_repeats(spark, docs.where("doc_id in (6, 7)"), SF).collect() if r.doc_id == 7}
    assert cut[7].text.startswith("other0 ") and cut[7].n_chars == len(cut[7].text) and cut[7].key == "k"


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.apply(spark, empty, SF).count() == 0
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a few words", "en", "src0", 11, None, None, None)], SCHEMA)
    assert P.reject_toxic(spark, docs, str(tmp_path)).count() == 1


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
