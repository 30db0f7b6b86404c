"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns (equal role and text, in order) is rendered once as the prompt; what follows it in
either conversation is rendered as its completion, with the spans in which a loss would count: texts of assistant
turns with their end mark. Only DataFrame and SQL functions are used. The one shuffle is by pair: a pair's turns come
together because they leave as one row; no other key is grouped, so turns shared by many conversations gather nowhere.

Defined cases: null roles and texts count as empty; turns of one number are ordered by role, then text, and repeated
rows stay; rows of no pair are left out; a pair with one side only has an empty prompt and an empty other completion;
if one conversation is a prefix of the other its completion is empty; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import table

#: Marks around a turn's text, and the role whose texts are learnt; fixed values of the format.
OPEN, OPENED, CLOSE, LEARNT = "<|", "|>\n", "<|end|>\n", "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(OPENED))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """``start-end`` spans in code points of the rendered turns, separated by commas."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        a = state["at"] + F.char_length(_head(turn))
        b = a + F.char_length(turn["text"]) + len(CLOSE)
        span = F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
        return F.struct(b.alias("at"), F.when(turn["role"] == LEARNT, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def formatted(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row a pair, from (conv_id, turn, role, text) rows; ``pair`` names a row's pair, ``chosen`` tells its side.

    Columns: pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("first"), "conv_id", turn.alias("t")).where("pair_id is not null and first is not null")
    side = lambda first: F.array_sort(F.collect_list(F.when(F.col("first") == first, F.col("t"))))
    name = lambda first: F.min(F.when(F.col("first") == first, F.col("conv_id")))
    pairs = rows.groupBy("pair_id").agg(name(True).alias("chosen_id"), name(False).alias("rejected_id"), side(True).alias("a"), side(False).alias("b"))
    both = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, both), F.slice("b", 1, both), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, False)
    pairs = pairs.withColumn("n", F.when(differs > 0, differs - 1).otherwise(both).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    pairs = pairs.select("pair_id", "chosen_id", "rejected_id", F.col("n").alias("prompt_turns"), F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return pairs.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("a")).alias("chosen"), _rendered(F.col("b")).alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"))


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k+1 as chosen and rejected: the table has no preferences of its own."""
    return formatted(table(spark, sf_dir, "conversations"), F.expr("conv_id div 2"), F.expr("conv_id % 2 = 0"))


_ORACLE = f"""with t as (select conv_id // 2 as pair_id, conv_id % 2 = 0 as first, conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as rn from conversations where conv_id is not null),
m as (select a.pair_id, a.rn, a.role = b.role and a.text = b.text as same from t a join t b on a.pair_id = b.pair_id and a.rn = b.rn and a.first and not b.first),
s as (select pair_id, min(conv_id) filter (where first) as chosen_id, min(conv_id) filter (where not first) as rejected_id from t group by 1),
p as (select s.*, coalesce((select min(rn) - 1 from m where m.pair_id = s.pair_id and not same), (select count(*) from m where m.pair_id = s.pair_id))::int as prompt_turns from s),
r as (select t.*, p.prompt_turns, rn <= prompt_turns as shared, '{OPEN}' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as tail from t join p using (pair_id)),
l as (select *, coalesce(sum(length(head || tail)) over (partition by pair_id, first, shared order by rn rows between unbounded preceding and 1 preceding), 0)::bigint + length(head) as a from r),
q as (select *, a::varchar || '-' || (a + length(tail))::varchar as span from l)
select p.pair_id, p.chosen_id, p.rejected_id, p.prompt_turns,
  coalesce(string_agg(head || tail, '' order by rn) filter (where q.first and shared), '') as prompt,
  coalesce(string_agg(head || tail, '' order by rn) filter (where q.first and not shared), '') as chosen,
  coalesce(string_agg(head || tail, '' order by rn) filter (where not q.first and not shared), '') as rejected,
  coalesce(string_agg(span, ',' order by rn) filter (where q.first and not shared and role = '{LEARNT}'), '') as chosen_mask,
  coalesce(string_agg(span, ',' order by rn) filter (where not q.first and not shared and role = '{LEARNT}'), '') as rejected_mask
from p join q using (pair_id) group by p.pair_id, p.chosen_id, p.rejected_id, p.prompt_turns"""

QUERIES = {"op3_preference_formatting": op3_preference_formatting}
ORACLES = {"op3_preference_formatting": _ORACLE}
