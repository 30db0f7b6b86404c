"""Encoding and counting against the libraries' own results on whole texts."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import bpe, token_counts

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "\n\n\n", "don't  stop  ", "x" * 3000, " " * 2000 + "end", "été naïve   42,000!!", "日本語のテキスト" * 200, "a b" * 1000, "<|endoftext|> mid <|endoftext|>", "\x85 　z\x1cq\x1d\x1e\x1f r", "🙂🙃 " * 300, "mixed123abc!?  \t\r\n  tail"]


def long_text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["th", "the ", " ", "\n", "é", "12", "!", "  ", "\t", "'s", "日", "ing", " "]) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400), st.integers(1, 9), st.integers(1, 5))
def test_tree_equals_whole(text, leaf, window):
    coder = bpe.Coder(MULTI, leaf, window)
    assert coder.encode(text) == coder.encoding.encode_ordinary(text)


@pytest.mark.parametrize("leaf", [1, 7, 64, 4096])
def test_tree_on_odd_and_long_texts(leaf):
    coder = bpe.Coder(MULTI, leaf, 4)
    for text in [*ODD, *(long_text(s, 3000) for s in range(5))]:
        tokens = coder.encode(text)
        assert tokens == coder.encoding.encode_ordinary(text)
        assert coder.decode(tokens, 10) == text.encode()


def test_digests(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, long_text(9, 40000)])] + [(3, "twice", None), (None, "no id", "y")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string"), MULTI).collect()}
    want = set()
    for i, t, _ in rows:
        ids = bpe.encoding(MULTI).encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_encoded_keeps_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b", 5)], "doc_id bigint, text string, leaf int")
    assert bpe.encoded(frame, MULTI).columns == ["doc_id", "text", "leaf", "token_ids"]
    clash = spark.createDataFrame([(1, "a b", "old", 7, "old")], "doc_id bigint, text string, token_ids string, n_tokens int, ids_sha256 string")
    assert bpe.encoded(clash, MULTI).columns == ["doc_id", "text", "n_tokens", "ids_sha256", "token_ids"]
    row = bpe.encoded_with_digests(clash, MULTI).first()
    assert (row.n_tokens, len(row.token_ids), len(row.ids_sha256)) == (2, 2, 64)
    assert bpe.encoded(frame.limit(0), MULTI).count() == bpe.digests(frame.limit(0), MULTI).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(name):
    path = public_tokenizers.path(name)
    texts = [*ODD, *(long_text(s, 2000) for s in range(8)), long_text(99, 60000)]
    library = Tokenizer.from_file(path)
    assert token_counts.counter(path)(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_long_texts_without_a_safe_place_are_not_slow():
    import time

    coder = bpe.Coder(MULTI)
    for text in ("x" * 200_000, "ab1!" * 50_000, " " * 200_000, "日本語" * 60_000):
        began = time.time()
        whole = coder.encoding.encode_ordinary(text)
        once = time.time() - began
        began = time.time()
        assert coder.encode(text) == whole
        assert time.time() - began < 3 * once + 0.5


def test_only_plain_byte_level_vocabularies_are_counted_by_ranks():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        described = json.load(file)
    ranks = token_counts.as_ranks(described)
    assert len(ranks) == 50256 and ranks[b" the"] and token_counts.BYTE_LEVEL == public_tokenizers.PATTERN
    model, merges = described["model"], described["model"]["merges"]
    for change in (
        {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": described["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": model | {"ignore_merges": True}},
        {"model": model | {"merges": [merges[1], merges[0], *merges[2:]]}}, {"model": model | {"merges": merges[:-1]}}, {"added_tokens": [described["added_tokens"][0] | {"special": False}]},
        *({"added_tokens": [described["added_tokens"][0] | {"content": c}]} for c in ("<|end of text|>", "<|end\u00a0|>", "a\n")),
    ):
        assert token_counts.as_ranks(described | change) is None
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        assert token_counts.as_ranks(json.load(file)) is None


def test_pieces_rejoin_and_are_safe(monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*ODD, long_text(5, 3000), "!?\x1c\x1d" * 50 + " a\x1f b" * 30]:
        parts = list(token_counts.pieces(text, 20))
        assert "".join(parts) == text
        assert sum(len(library.encode(p, add_special_tokens=False)) for p in parts) == len(library.encode(text, add_special_tokens=False))


def test_sentencepiece_counts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.counter(path)(["a b", "", "naïve text"]) == [len(whole.encode(t)) for t in ["a b", "", "naïve text"]]


def test_token_count_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [(1, "word " * 2000), (2, None), (2, ""), (2, "twice"), (None, "é"), (4, "x" * 70_000), (5, "<|endoftext|> in between <|endoftext|>"), (6, "a" + " the" * 1023), (7, "a" + " the" * 1024)]
    frame = spark.createDataFrame([(d, t, None) for d, t in texts], "doc_id bigint, text string, n_bytes string")
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(frame, path).collect())
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    assert got == sorted(((d or -1), len((t or "").encode()), count(t), count(t) > 1024) for d, t in texts)
    assert {n: o for d, _, n, o in got if d in (6, 7)} == {1024: False, 1025: True}
    assert token_counts.token_counts(frame.limit(0), path).count() == 0


def test_special_strings_with_white_space_are_counted_as_the_library_does(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        described = json.load(file)
    described["added_tokens"].append(described["added_tokens"][0] | {"id": 50257, "content": "<|end of text|>"})
    (tmp_path / "spaced.json").write_text(json.dumps(described))
    library = Tokenizer.from_file(str(tmp_path / "spaced.json"))
    text = "some words <|end of text|> and more " * 3000
    assert len(text) > 2 * token_counts.PIECE
    assert token_counts.counter(str(tmp_path / "spaced.json"))([text]) == [len(library.encode(text, add_special_tokens=False))]
