"""Near copies of five-word shingles: SimHash trees, completed to all pairs of a Jaccard similarity of 0.8 or more.

Texts are linked where their SimHash fingerprints (of the same shingles) differ by RADIUS bits at most, found by the
vantage-point trees of ``simhash``; and, since a similarity of 0.8 lies some ten bits apart, where no tree of 64-bit
fingerprints can prune (README has figures), also where the sets of shingles have that similarity. One text of each
linked group stays.

Shingles stand as 64-bit hashes. Equal sets are folded first. Shingles are put in one order for all texts: those that
are not known as frequent by hash, then the others, rare ones first. Two sets of the wanted similarity share one of
the first fifth of their shingles, whatever the order is (the prefix filter). Where three fifths or more of a set are
not frequent, only the first FIRST are taken: at most a third of these can be missing in a set of the wanted
similarity, so that none of the first 40 by hash is shared has a chance below 3 to the power -40 for each side, less
than that of equal hashes. Texts that share one, and whose sets' sizes allow the similarity, are joined into rough
groups by links to the least of them, never as pairs; the groups hold all pairs that are sought. Each group is searched exactly
in memory, breadth first: what has been reached leaves the index, so a family of near copies is not compared pair by
pair. A group beyond TASK_ROWS or TASK_SHINGLES is first parted anew: chance grows it with the data, through passages that
few texts share. Half of all hashes (COUNTED) are counted over its texts, and those of one text alone come first in its
order, as they meet nothing: most texts then have no shingle left to meet on. What is still beyond is dealt into
blocks, every two of which meet in one task.

The order comes from document frequencies in a bounded sample; it only decides how large the rough groups are.

Words are those of ``simhash.fingerprint``: A-Z count as a-z, words end at ASCII white space. Defined cases: a shorter
text is one shingle; null, empty and blank texts have no shingles and are copies of each other; rows that share a
doc_id are judged each by its own text; which row of a group stays is stated in ``simhash.without_copies``; an empty
table gives an empty one; other columns, whatever their names, pass through ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import simhash
from cairn.llm.common import bounded, slices, utf8
from cairn.operators.graph import connected_components
from cairn.operators.similar import search
from cairn.storage import Stored, broadcast_if_small, store, stored_bytes

#: Words of a shingle, and the similarity in hundredths from which two texts are near copies.
SHINGLE, PERCENT = 5, 80
#: Bits in which fingerprints that the trees link differ at most.
RADIUS = 2
#: Shingles taken from a set that is mostly not frequent, and the share of it from which this holds, in hundredths.
FIRST, RARE_PERCENT = 40, 60
#: About so many shingles are counted for the order, and so many of the most frequent are sent to all tasks (6 MB).
SAMPLE, FREQUENT = 1 << 23, 1 << 19
#: A task searches about twice so many texts and shingles at most, but one text at least.
TASK_ROWS, TASK_SHINGLES = 1 << 14, 1 << 22

#: One of so many hashes is counted in groups that are parted anew.
COUNTED = 2


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 hashes of one UTF-8 text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    total = len(words) - k + 1
    of = xxhash.xxh64_intdigest
    places = zip(starts[:total].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((of(joined[a:b], 42) for a, b in places), np.uint64, total)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, in ascending order."""
    return np.unique(shingle_hashes(text, shingle))


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest shingles of a set, as many as every set of the wanted similarity must share one of."""
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, counts[at], 0)
    enough = n - -(-percent * n // 100) + 1
    if percent >= 80 and 100 * np.count_nonzero(rank == 0) >= RARE_PERCENT * n:
        enough = min(enough, FIRST)
    return found[np.argsort(rank, kind="stable")[:enough]]


def _frequencies(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one text of the sample, ascending, and the number of their texts."""
    words = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE / max(1, words // 6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(x, shingle) for x in utf8(part)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    rows = bounded(some).mapInArrow(run, "h bigint").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), F.xxhash64("h")).limit(FREQUENT).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows.column("count").to_numpy()[order]


def later_prefix(found: np.ndarray, alone: int, frequent: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """``prefix`` in an order that begins with counted hashes of one text alone, of which this set has ``alone``.

    They meet nothing and are left out. The hashes that are not counted come next, rare ones first; where they are too
    few, the whole set is taken, which is more than a prefix needs.
    """
    n = len(found)
    room = n - -(-percent * n // 100) + 1 - alone
    if room <= 0:
        return found[:0]
    rest = found[found % np.uint64(COUNTED) != 0]
    if len(rest) < room:
        return found
    rank = np.zeros(len(rest), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, rest), len(frequent) - 1)
        rank = np.where(frequent[at] == rest, counts[at], 0)
    return rest[np.argsort(rank, kind="stable")[:room]]


def _prints(docs: DataFrame, shingle: int, percent: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, key, code, n, fp, prefix), a row a document: hashes of the text and of its set, the set's size, the
    fingerprint and the prefix."""
    frequent, counts = known or _frequencies(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, prints = [], []
                for x in utf8(part):
                    hashes = shingle_hashes(x, shingle)
                    prints.append(simhash.majority(hashes))
                    sets.append(np.unique(hashes))
                codes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
                firsts = pa.array([prefix(s, frequent, counts, percent).view(np.int64) for s in sets], pa.list_(pa.int64()))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                columns = [part.column("doc_id"), part.column("key"), pa.array(codes), sizes, pa.array(prints, pa.int64()), firsts]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "code", "n", "fp", "prefix"])

    rows = bounded(docs.select("doc_id", F.xxhash64("text").alias("key"), "text"))
    return rows.mapInArrow(run, "doc_id bigint, key bigint, code bigint, n bigint, fp bigint, prefix array<bigint>")


def _task_links(percent: int):
    def run(data: pa.Table) -> pa.Table:
        codes, first = np.unique(data.column("code").to_numpy(), return_index=True)
        column = data.column("found").combine_chunks()
        values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        found = search([values[ends[i] : ends[i + 1]] for i in first], percent / 100) if len(first) > 1 else []
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": codes[a], "b": codes[b]})

    return run


def _rough(firsts: DataFrame, percent: int) -> DataFrame:
    """(node, component) of (code, n, prefix): sets that share a shingle of their prefixes and may be similar by size."""
    # Sizes of two such sets differ by one step of 100 / percent at most: a set is filed under its own step and the next.
    step = F.floor(F.log(100 / percent * 1.0000001, F.greatest("n", F.lit(1))))
    firsts = firsts.select("code", step.alias("step"), F.explode("prefix").alias("h"))
    firsts = firsts.select("code", F.explode(F.array(F.xxhash64("h", "step"), F.xxhash64("h", F.col("step") + 1))).alias("h"))
    met = store(firsts.groupBy("h").agg(F.min("code").alias("least"), F.max("code").alias("most")).where("least < most").select("h", "least"), "met")
    shared = firsts.join(broadcast_if_small(met.df, stored_bytes(firsts.sparkSession, met.path)), "h").where("code <> least")
    rough = connected_components(shared.select(F.col("code").alias("a"), F.col("least").alias("b")).distinct())
    met.remove()
    return rough


def _full(sets: DataFrame, rows: int, shingles: int) -> DataFrame:
    """(component, n, s): rows and shingles of the rough groups that are more than one task's."""
    return sets.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.size("found")).alias("s")).where(f"n > {rows} or s > {shingles}")


def parted(sets: DataFrame, wide: DataFrame, known: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> Stored:
    """``sets`` (component, code, found) with the groups of ``wide`` (component) parted anew; sets that meet nothing leave."""
    frequent, counts = known
    large = store(sets.join(wide.select("component"), "component", "left_semi").select("code", "found"), "large-groups")
    counted = large.df.select("code", F.explode("found").alias("h")).where(F.col("h").bitwiseAND(COUNTED - 1) == 0)
    single = counted.groupBy("h").agg(F.min("code").alias("code"), F.max("code").alias("most")).where("code = most")
    alone = single.groupBy("code").agg(F.count("*").alias("alone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("found")
            values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            found = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            firsts = [later_prefix(x, k, frequent, counts, percent).view(np.int64) for x, k in zip(found, batch.column("alone").to_pylist(), strict=True)]
            columns = [batch.column("code"), pa.array([len(x) for x in found], pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["code", "n", "prefix"])

    told = large.df.join(alone, "code", "left").select("code", "found", F.coalesce("alone", F.lit(0)).alias("alone"))
    firsts = store(bounded(told).mapInArrow(run, "code bigint, n bigint, prefix array<bigint>"), "later-prefixes")
    rough = _rough(firsts.df, percent)
    again = large.df.join(rough.withColumnRenamed("node", "code"), "code").select("component", "code", "found")
    out = store(sets.join(wide.select("component"), "component", "left_anti").select("component", "code", "found").unionByName(again), "sets")
    large.remove(), firsts.remove()
    return out


def links(spark: SparkSession, docs: DataFrame, prints: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = TASK_ROWS, shingles: int = TASK_SHINGLES, known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(a, b): links between codes that span the components of all pairs of sets of the wanted similarity.

    ``known``: the frequent shingles, ascending, and their counts, which only order the shingles.
    """
    rough = _rough(prints, percent)
    chosen = prints.groupBy("code").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one"))
    chosen = store(chosen.join(rough.withColumnRenamed("node", "code"), "code").select("code", "component", F.col("one.doc_id").alias("id"), F.col("one.key").alias("k")), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = pa.array([shingle_set(x, shingle).view(np.int64) for x in utf8(part)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("component"), part.column("code"), sets], ["component", "code", "found"])

    small = broadcast_if_small(chosen.df, stored_bytes(spark, chosen.path))
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(small, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    sets = store(bounded(texts.select("component", "code", "text")).mapInArrow(run, "component bigint, code bigint, found array<bigint>"), "sets")
    wide = store(_full(sets.df, rows, shingles), "wide")
    if wide.df.limit(1).count():
        whole, sets = sets, parted(sets.df, wide.df, known or (np.zeros(0, np.uint64), np.zeros(0, np.int64)), percent)
        whole.remove()
    wide.remove()
    full = _full(sets.df, rows, shingles)
    wide = store(full.select("component", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("s") / shingles)).cast("int").alias("blocks")), "wide")
    dealt = sets.df.join(broadcast_if_small(wide.df, stored_bytes(spark, wide.path)), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    tasks = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != block), lambda j: F.struct(F.least(j, block).alias("x"), F.greatest(j, block).alias("y")))
    )
    dealt = dealt.select("component", F.explode(tasks).alias("t"), "code", "found").select("component", "t.x", "t.y", "code", "found")
    found = store(dealt.groupBy("component", "x", "y").applyInArrow(_task_links(percent), "a bigint, b bigint"), "links")
    for old in (chosen, sets, wide):
        old.remove()
    return found.df


def tree_links(spark: SparkSession, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between codes that span the components of all fingerprints within ``radius``."""
    groups = store(prints.groupBy("fp").agg(F.min("code").alias("least")), "groups")
    near = simhash.links(spark, groups.df, groups.df.count(), radius)
    named = lambda side: groups.df.select(F.col("fp").alias(side), F.col("least").alias(f"code_{side}"))
    across = near.join(named("a"), "a").join(named("b"), "b").select(F.col("code_a").alias("a"), F.col("code_b").alias("b"))
    same = prints.select("fp", "code").distinct().join(groups.df, "fp").where("code <> least")
    return across.unionByName(same.select(F.col("code").alias("a"), F.col("least").alias("b")))


def near_copies(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = TASK_ROWS, shingles: int = TASK_SHINGLES
) -> DataFrame:
    """(doc_id, key, component_id, group), one row a document; component_id is the smallest doc_id that links reach,
    group names the component also where no row of it has a doc_id."""
    spark = docs.sparkSession
    known = _frequencies(docs, shingle)
    prints = store(_prints(docs, shingle, percent, known), "prints").df
    found = links(spark, docs, prints, shingle, percent, rows, shingles, known).unionByName(tree_links(spark, prints))
    parts = connected_components(found)
    sets = prints.groupBy("code").agg(F.min("doc_id").alias("least_id")).join(parts.withColumnRenamed("node", "code"), "code", "left")
    sets = store(sets.select("code", "least_id", F.coalesce("component", "code").alias("component")), "sets").df
    least = sets.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = sets.join(least, "component").select("code", "component_id", F.col("component").alias("group"))
    return prints.join(named, "code").select("doc_id", "key", "component_id", "group")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each linked group; all columns as they are."""
    return simhash.without_copies(docs, near_copies(docs, shingle, percent))
