"""Mixing sources to target weights, by hierarchical budgeting.

Documents are the leaves of a domain-language-source tree. A budget of tokens goes down the tree level by level: each
node's share is split among its children by their weights, none above what its documents can give in the allowed
passes; what a child cannot take goes to its siblings in proportion to their weights, and only what no sibling can
take is left for the nodes above, whose own split saw the whole subtree's capacity. Then each leaf takes a prefix of
its seeded epochs: in epoch e its documents are ordered by the hash of seed, epoch, doc_id and text, an epoch begins when
the one before is used up, and documents are taken while their tokens end within the budget.

Only DataFrame and SQL functions are used. A leaf's running sum is never computed in one task: ranges of hashes are
summed by partial aggregation, the one in which a leaf's budget ends is found digit by digit from sixteen sums at a
time, each time among the rows of the range found before, and rows are only ordered within the last range, some
RANGE_ROWS of them. Rows that are equal in all that matters here are one row with a count, so copies do not pile up
in one range. What is joined to the documents has one row a leaf. The children of one node are filled by windows over
one task each: a node may have millions of children, not more (README has figures).

Tokens are words between ASCII white space. Defined cases: documents without any word have no tokens and are taken
where the prefix reaches them; null domain, lang or source is a node named ``(none)``; a null text has no words;
weights not given are 1, and a weight of nought leaves a node out; rows that share a doc_id have places of their own
by their texts; of equal rows as many are taken as fit; rows without a doc_id come as if it were empty; very long texts
are only counted and hashed; an empty table gives an empty result; other columns are ignored by ``mix`` and kept by
``kept_once``, which keeps all of equal rows or none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import fresh
from cairn.session import table
from cairn.storage import Stored, broadcast_if_small, store

#: Levels of the tree.
LEVELS = ("domain", "lang", "source")
#: Target weights of the production mix by level and name; others weigh 1.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"web": 5, "books": 2, "code": 2, "forum": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
#: Share of all single-pass tokens that the production mix may take, in hundredths; passes over a leaf; seed.
PERCENT, EPOCHS, SEED = 80, 2, 2026
#: Rows that a range of a leaf should hold on average if leaves were even.
RANGE_ROWS = 256

_WORD = r"[^ \t\n\x0B\f\r]+"


def domain_of(source: Column) -> Column:
    """The production tree's domain of a source: by the number at the end of its name."""
    number = F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.when(number % 4 == 0, "web").when(number % 4 == 1, "books").when(number % 4 == 2, "code").otherwise("forum")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("bigint")


def budgets(capacity: DataFrame, total: int, weights: dict[str, dict[str, int]], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(levels, budget) from (levels, cap): each parent's budget fills its children evenly by weight.

    Children are sorted by capacity over weight. As long as a child's even share of what is left is no less than its
    capacity, it gets its capacity; the others share the rest by weight, rounded down. Products of tokens and weights are
    decimals of 38 digits, since 1e13 tokens times the weights of a million children exceed a bigint.
    """
    at: DataFrame | None = None
    parents: list[str] = []
    for level in levels:
        keys = [*parents, level]
        nodes = capacity.groupBy(*keys).agg(F.sum("cap").cast("bigint").alias("cap")).withColumn("w", _weight(level, weights)).where("w > 0")
        nodes = nodes.withColumn("budget", F.lit(total).cast("bigint")) if at is None else nodes.join(at, parents)
        whole = Window.partitionBy(*parents)
        sorted_ = whole.orderBy(F.col("cap").cast("double") / F.col("w"), level)
        ahead = sorted_.rowsBetween(Window.unboundedPreceding, -1)  # sums that grow row by row; one to the end would start anew
        nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(ahead), F.lit(0)))
        nodes = nodes.withColumn("still", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(ahead), F.lit(0)))
        nodes = nodes.withColumn("full", F.expr("cast(cap as decimal(19,0)) * still <= cast(greatest(budget - before, 0) as decimal(19,0)) * w"))
        nodes = nodes.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
        nodes = nodes.withColumn("rest", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole))
        at = nodes.select(*keys, F.expr("if(full, cap, cast(greatest(budget - spent, 0) as decimal(19,0)) * w div rest)").cast("bigint").alias("budget"))
        parents = keys
    return at


#: Equal rows that are listed at once.
COPIES = 1 << 16


def with_tree(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """doc_id, the levels, tokens, a hash of the text, and ``n``: how many rows are equal in these."""
    name = lambda c: F.coalesce(c, F.lit("(none)"))
    domain = domain_of(F.col("source")) if domain is None else domain
    tokens = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(
        "doc_id", name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"),
        tokens.alias("tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def _listed(rows: DataFrame) -> DataFrame:
    """Each row ``n`` times, without ``n``; runs of COPIES, so that no list is long."""
    runs = rows.where("n > 0").withColumn("run", F.explode(F.expr(f"sequence(0, (n - 1) div {COPIES})")))
    return runs.withColumn("copy", F.explode(F.expr(f"sequence(1, least({COPIES}, n - run * {COPIES}))"))).drop("n", "run", "copy")


def mix(
    docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None
) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, tie, epoch, budget): a row for each time that a document is taken."""
    leaf = list(LEVELS)
    tree = store(with_tree(docs, domain), "tree")
    rows = tree.df.count()
    levels = max(1, math.ceil(math.log(max(1, rows) / RANGE_ROWS, 16)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tie"))
    passes = tree.df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("rank", key)
    capacity = store(tree.df.groupBy(*leaf).agg((F.sum(F.col("tokens") * F.col("n")) * epochs).cast("bigint").alias("cap")), "capacity")
    single = (capacity.df.agg(F.sum("cap")).first()[0] or 0) // epochs
    chosen = store(budgets(capacity.df, single * percent // 100, weights), "leaf-budgets")
    ends = _ends(passes, chosen, leaf, levels)
    taken = passes.join(_small(ends), leaf)
    at, head = F.col("end.epoch"), F.substring("rank", 1, levels)
    keep = ["doc_id", *leaf, "tokens", "tie", "epoch", "budget", "n"]
    inside = taken.where(F.col("end").isNull() | (F.col("epoch") < at) | ((F.col("epoch") == at) & (head < F.col("end.range")))).select(*keep)
    order = Window.partitionBy(*leaf).orderBy("rank", F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    last = taken.where((F.col("epoch") == at) & (head == F.col("end.range")))
    last = last.withColumn("left", F.col("budget") - F.col("end.before") - F.coalesce(F.sum(F.col("tokens") * F.col("n")).over(order), F.lit(0)))
    fits = F.when(F.col("left") < 0, 0).when(F.col("tokens") == 0, F.col("n")).otherwise(F.least("n", F.expr("left div greatest(tokens, 1)")))
    return _listed(inside.unionByName(last.withColumn("n", fits.cast("bigint")).select(*keep)))


def _small(leaves: Stored) -> DataFrame:
    """One row a leaf, broadcast while there are few enough."""
    return broadcast_if_small(leaves.df, leaves.df.count() * 200)


def _ends(passes: DataFrame, chosen: Stored, leaf: list[str], levels: int) -> Stored:
    """(leaf, budget, end struct<epoch, range, before>): the epoch and range of hashes in which each leaf's budget ends.

    The range is found digit by digit: each level sums the sixteen parts of the range found so far, and only these
    sums, sixteen a leaf (and epoch, at first), are accumulated. The second level keeps the rows of its ranges, a
    sixteenth or less, for the next, and so on. ``end`` is null where everything fits.
    """
    empty = F.lit(None).cast("struct<epoch:int,range:string,before:bigint>").alias("end")
    ends = store(chosen.df.select(*leaf, "budget", empty), "ends")
    along = Window.partitionBy(*leaf).orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    rows, kept = passes.select(*leaf, "epoch", "rank", (F.col("tokens") * F.col("n")).alias("tokens")), None
    for level in range(1, levels + 1):
        part = rows.join(_small(ends), leaf)
        if level > 1:
            part = part.where((F.col("epoch") == F.col("end.epoch")) & (F.substring("rank", 1, level - 1) == F.col("end.range")))
            if level < levels:
                before, kept = kept, store(part.select(*rows.columns), "within")
                rows, part = kept.df, kept.df.join(_small(ends), leaf)
                if before is not None:
                    before.remove()
        range_ = F.substring("rank", 1, level).alias("range")
        sums = part.groupBy(*leaf, "epoch", range_).agg(F.sum("tokens").cast("bigint").alias("n"), F.first("budget").alias("budget"), F.first("end.before").alias("base"))
        sums = store(sums, "ranges")
        places = sums.df.withColumn("before", F.coalesce("base", F.lit(0)) + F.coalesce(F.sum("n").over(along), F.lit(0)))
        end = places.where("before + n > budget").groupBy(*leaf).agg(F.min(F.struct("epoch", "range", "before")).alias("end"))
        ends = store(chosen.df.select(*leaf, "budget").join(end, leaf, "left"), "ends")
    if kept is not None:
        kept.remove()
    return ends


def kept_once(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The documents that a single pass takes, with all their columns."""
    of, tie = fresh(docs, "__of", "__tie")
    taken = store(mix(docs, weights, percent, 1, seed).select(F.col("doc_id").alias(of), F.col("tie").alias(tie)).distinct(), "taken").df
    taken = broadcast_if_small(taken, taken.count() * 56)
    same = docs["doc_id"].eqNullSafe(taken[of]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == taken[tie])
    return docs.join(taken, same, "left_semi")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "epoch", "budget")


def _oracle() -> str:
    """The same rows in SQL: plain running sums over whole leaves."""
    cases = {k: "case " + " ".join(f"when {k} = '{n}' then {w}" for n, w in WEIGHTS[k].items()) + " else 1 end" if k in WEIGHTS else "1" for k in LEVELS}
    number = "coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') as int), 0)"
    sql = f"""with tree as (select doc_id, case {number} % 4 when 0 then 'web' when 1 then 'books' when 2 then 'code' else 'forum' end as domain,
  coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::bigint as tokens, md5(coalesce(text, '')) as tie from documents),
capacity as (select domain, lang, source, (sum(tokens) * {EPOCHS})::bigint as cap from tree group by all),
b0 as (select ((sum(cap) // {EPOCHS}) * {PERCENT} // 100)::bigint as budget from capacity)"""
    parents: list[str] = []
    for i, level in enumerate(LEVELS):
        keys = [*parents, level]
        part = f"partition by {', '.join(parents)}" if parents else ""
        using = f"join b{i} using ({', '.join(parents)})" if parents else ", b0"
        sql += f""",
n{i} as (select *, {cases[level]} as w from (select {", ".join(keys)}, sum(cap)::bigint as cap from capacity group by all) {using}),
f{i} as (select *, cap * still <= greatest(budget - prior, 0) * w as is_full from (select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as prior,
  (sum(w) over (o rows between current row and unbounded following))::bigint as still from n{i} window o as ({part} order by cap::double / w, {level}))),
b{i + 1} as (select {", ".join(keys)}, (case when is_full then cap else greatest(budget - spent, 0) * w // rest end)::bigint as budget from (select *,
  coalesce(sum(cap) filter (where is_full) over (p), 0)::bigint as spent, coalesce(sum(w) filter (where not is_full) over (p), 1)::bigint as rest from f{i} window p as ({part})))"""
        parents = keys
    return (
        sql
        + f""",
passes as (select *, md5(concat_ws('|', '{SEED}', epoch, coalesce(doc_id::varchar, ''), tie)) as rank from tree, range({EPOCHS}) as e(epoch)),
placed as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by epoch, rank, doc_id nulls first, tie rows between unbounded preceding and 1 preceding), 0) as place from passes)
select doc_id, domain, lang, source, tokens, epoch::int as epoch, budget from placed join b3 using (domain, lang, source) where place + tokens <= budget"""
    )


QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": _oracle()}
