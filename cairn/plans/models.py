"""Model operators over ``conversations``: judgments asked concurrently, mapped batches, functions of SQL.

The model is a rule that reads the prompt alone, as a service would; it fails at times, as services do: some requests
break off once, some answers are refused once, some always.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cairn.functions import jsonguard as J
from cairn.operators import prompts as M
from cairn.session import table

#: What stands before a prompt that is sent a second time; requests under way at once in a worker.
AGAIN, AT_ONCE = "Answer with the JSON object alone.\n", 4
QUESTIONS = {
    "asks": M.Question("Does the text ask something?"), "tone": M.Question("How is it said?", "choice", ("calm", "loud")),
    "length": M.Question("How long is the text?", "scale", ("short", "middle", "long")),
}


class Reader:
    """Judges a turn by its text."""

    def one(self, prompt: str, system: str | None = None) -> str:
        text = json.loads(prompt.rsplit("\n", 1)[1]).get("said") or ""
        if len(text) % 17 == 0:
            return "{}"
        if not prompt.startswith(AGAIN):
            if len(text) % 11 == 0:
                raise ConnectionError("the connection was lost")
            if len(text) % 13 == 0:
                return "I think that"
        return json.dumps({"asks": "?" in text, "tone": "loud" if "!" in text else "calm", "length": (len(text) >= 40) + (len(text) >= 200)})

    def answer(self, prompts: list[str], system: str | None = None) -> list[str]:
        return [self.one(p, system) for p in prompts]


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "role", "text")


def turn_judgments(spark, sf_dir):
    """Typed answers to three questions about every turn, bound by key, several requests of a worker at once."""
    turns = _turns(spark, sf_dir)
    said = F.when(F.col("text").isNotNull(), F.struct(F.col("text").alias("said")))
    rows = M.judge(turns, Reader, "turn_id", said, QUESTIONS, stricter=AGAIN, concurrency=AT_ONCE, deadline=60.0)
    return rows.select("turn_id", "status", "response.asks", "response.tone", "response.length")


class Lengths:
    """A class that each worker builds once; its instances map batches."""

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(batch.column("text"), "")
        words = pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(text)))
        words = pc.if_else(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0), 0, words)
        return pa.RecordBatch.from_arrays([batch.column("turn_id"), pc.cast(pc.utf8_length(text), pa.int64()), pc.cast(words, pa.int64())], ["turn_id", "n_chars", "n_words"])


def turn_lengths(spark, sf_dir):
    """Batches mapped by an instance that its worker keeps."""
    return M.map_batches(_turns(spark, sf_dir).select("turn_id", "text"), Lengths, "turn_id string, n_chars bigint, n_words bigint", batch_size=256)


def questions_only(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Fewer rows out than in: those that ask something."""
    return batch.filter(pc.fill_null(pc.match_substring(batch.column("text"), "?"), False)).select(["turn_id", "role"])


def turn_questions(spark, sf_dir):
    """Batches mapped by a plain function that leaves rows out."""
    return M.map_batches(_turns(spark, sf_dir), questions_only, "turn_id string, role string")


class Tagger:
    """A stateful scalar: what it needs is made once, in its worker."""

    def __init__(self):
        self.names = {"user": "asked", "assistant": "answered"}

    def __call__(self, role: str, text: str | None) -> str:
        return f"{self.names.get(role, role)}:{'empty' if not (text or '').strip() else 'said'}"


def turn_tags(spark, sf_dir):
    """A class attached to SQL as a scalar function, called from a query over a frame."""
    M.register_function(spark, "cairn_turn_tag", Tagger, "string")
    return spark.sql("select cairn_turn_tag(role, text) as tag, count(*) as turns from {turns} group by all", turns=_turns(spark, sf_dir))


def turn_error_budget(spark, sf_dir):
    """Counts by status, held against a budget of all turns: what failed is told, not dropped."""
    answers = turn_judgments(spark, sf_dir)
    counts = M.enforce_budget(answers, most=1 << 40)
    return spark.createDataFrame(list(counts.items()), "status string, turns bigint")


def salvaged_answers(spark, sf_dir):
    """Answers with text around their JSON, plain ones, and some that hold none, about every turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    told = F.to_json(F.struct(F.col("turn").alias("place"), "role", F.col("conv_id").alias("call")))
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure, here it is: "), told, F.lit(" - anything else?"))).when(F.col("turn") % 3 == 1, told).otherwise(F.concat(F.lit("{no answer about "), "role"))
    return turns.select("conv_id", "turn", J.salvage(raw).alias("answer"))


_TURNS = "with t as (select conv_id || '-' || turn as turn_id, role, text, length(text) as n from conversations) "
_JUDGED = _TURNS + ", j as (select *, case when text is null then 'skipped' when n % 17 = 0 then 'invalid_response' else 'success' end as status from t) "
QUERIES = {
    "turn_judgments": turn_judgments, "turn_lengths": turn_lengths, "turn_questions": turn_questions, "turn_tags": turn_tags, "turn_error_budget": turn_error_budget,
    "salvaged_answers": salvaged_answers,
}
ORACLES = {
    "turn_judgments": _JUDGED + "select turn_id, status, case when status = 'success' then contains(text, '?') end as asks, case when status = 'success' then case when contains(text, '!') then 'loud' else 'calm' end end as tone, case when status = 'success' then (n >= 40)::bigint + (n >= 200)::bigint end as length from j",
    "salvaged_answers": """select conv_id, turn, case when turn % 3 < 2 then '{"call":' || conv_id || ',"place":' || turn || ',"role":"' || role || '"}' end as answer from conversations""",
    "turn_lengths": _TURNS + "select turn_id, coalesce(n, 0)::bigint as n_chars, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::bigint as n_words from t",
    "turn_questions": _TURNS + "select turn_id, role from t where contains(text, '?')",
    "turn_tags": "select case role when 'user' then 'asked' when 'assistant' then 'answered' else role end || ':' || case when trim(coalesce(text, '')) = '' then 'empty' else 'said' end as tag, count(*) as turns from conversations group by 1",
    "turn_error_budget": _JUDGED + "select status, count(*) as turns from j group by 1",
}
