"""Token counts: Arrow batches in, lengths only out.

Rows are regrouped into batches of about BATCH_BYTES, so that a batch's work does not depend on how long its texts
are; a text longer than PIECE code points is cut at safe places, and its pieces' counts are added. A place is safe
where white space follows a character that is not: no match of the splitting pattern crosses it, the pattern never
looks back, and a vocabulary with a special string that holds white space is not cut, so the pieces' tokens are those of
the whole.

A byte-level vocabulary without anything but merges (``as_ranks``) is counted by an encoder that takes its tokens as
ranks and counts about five times as many bytes a second. Whether a .json file is one is read from the file itself, all
of it; special strings in a text count as their token, as is the default for the file. Any other vocabulary is counted
by the library of its kind, whole texts at a time.

Defined cases: null and empty texts have no tokens and no bytes; rows stay as they are; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import SPACE, bounded, slices
from cairn.session import table

PIECE, BATCH_BYTES, LIMIT = 1 << 15, 1 << 20, 1024

_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def pieces(text: str, longest: int = PIECE) -> Iterator[str]:
    """Consecutive parts of about ``longest`` code points, cut at safe places only."""
    at = 0
    while len(text) - at > longest:
        cut = _SAFE.search(text, at + longest)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


#: The splitting pattern of byte-level pre-tokenizers; a fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others,
    in order, for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def as_ranks(described: dict) -> dict[bytes, int] | None:
    """Ranks by token bytes of a described tokenizer, if merging by rank gives its tokens for every text; else None.

    It must split by ``BYTE_LEVEL``, change nothing before, know no added tokens but special ones without white space (a
    text may be cut before any), and list its merges in the order of the ids that they make, one merge for each token
    longer than a byte.
    """
    model, split = described["model"], described.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    splits = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    added = described.get("added_tokens") or []
    if not (plain and splits and described.get("normalizer") is None and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{SPACE}]", t["content"])) for t in added)):
        return None
    byte, special = _byte_of(), {t["content"] for t in added}
    try:
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    except KeyError:
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in pairs]
    singles = {t for t in ranks if len(t) == 1}
    in_order = all(i is not None for i in made) and made == sorted(set(made)) and len(made) + len(singles) == len(ranks)
    below = len(singles) == 256 and (not made or max(ranks[t] for t in singles) < made[0])
    return ranks if in_order and below else None


@functools.cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts by the vocabulary at ``path``; loaded once a worker."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        if (ranks := as_ranks(described)) is not None:
            return _by_ranks(ranks, {t["content"]: t["id"] for t in described.get("added_tokens") or []})
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation(), tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]


def _by_ranks(ranks: dict[bytes, int], special: dict[str, int]) -> Callable[[list[str]], list[int]]:
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
    everything = set(special)

    def count(texts: list[str]) -> list[int]:
        return [sum(len(encoding.encode(p, allowed_special=everything)) for p in pieces(x)) for x in texts]

    return count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(path)
        for batch in batches:
            for part in slices(batch, max_bytes=BATCH_BYTES):
                texts = [x or "" for x in part.column("text").to_pylist()]
                n = count(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
