"""SimHash near-duplicates through vantage-point trees.

A fingerprint is the 64-bit majority vote of the XXH64 hashes (seed 42) of a document's word shingles. Equal
fingerprints are grouped first, so that copies cost one row. Distinct fingerprints are then partitioned by a
vantage-point tree over the Hamming distance: its nodes hold a vantage point and a radius, fitted on a bounded
sample; the triangle inequality tells which fingerprints can have a partner on the other side of a radius, and only
those are also sent, as queries, into the shards beyond. A shard descends further by the same rule in memory and
compares what is left exactly, so every link is found whatever the sample was. Each shard returns a spanning forest
of its links, never all pairs, and a distributed component search joins the forests.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer words than a
shingle form one shingle; rows with equal or null ids stay rows of their own (a null id is never a component's
name unless all ids of the component are null); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded, fresh, slices, utf8
from cairn.operators.graph import connected_components
from cairn.session import table
from cairn.storage import Stored, broadcast_if_small, store, stored_bytes

#: Fingerprints a shard should hold, and what one task compares at most: a fuller shard is dealt out in blocks.
SHARD, TASK = 2048, 16384
#: Shards at most; the tree is sent to all tasks, 24 bytes a shard. Beyond it shards grow and are dealt out in blocks.
MAX_SHARDS = 1 << 16
#: Below this many points a shard is compared without descending further.
LEAF = 384


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one UTF-8 text; A-Z count as a-z, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    of, total = xxhash.xxh64_intdigest, len(words) - k + 1
    places = zip(starts[:total].tolist(), ends[k - 1 :].tolist(), strict=True)
    return majority(np.fromiter((of(joined[a:b], seed) for a, b in places), "<u8", total))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit value of the bits set in over half the hashes; 0 for none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp): one row for each row of ``docs``; ``key`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([fingerprint(x, shingle) for x in utf8(part)], pa.int64())], ["doc_id", "key", "fp"])

    return bounded(docs.select("doc_id", F.xxhash64("text").alias("key"), "text")).mapInArrow(run, "doc_id bigint, key bigint, fp bigint")


# --- the tree: parallel arrays; a child below zero is shard -1-child --------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def split(sample: np.ndarray, radius: int, tries: int = 6) -> tuple[np.uint64, int] | None:
    """A vantage point of the sample and the distance that halves it with the fewest points near the boundary."""
    best = None
    for v in sample[np.linspace(0, len(sample) - 1, tries).astype(int)]:
        d = distance(sample, v)
        counts = np.bincount(d, minlength=65)
        inside = np.cumsum(counts)
        for mu in np.flatnonzero((inside >= 0.35 * len(sample)) & (inside <= 0.65 * len(sample))):
            near = counts[max(0, mu - radius + 1) : mu + radius + 1].sum()
            if best is None or near < best[0]:
                best = near, v, int(mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int, radius: int) -> dict[str, np.ndarray]:
    vantage, mu, inner, outer = [], [], [], []
    leaves = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        found = split(points, radius) if want > 1 and len(points) >= 8 else None
        if found is None:
            leaves += 1
            return -leaves
        at = len(vantage)
        vantage.append(found[0]), mu.append(found[1]), inner.append(0), outer.append(0)
        near = distance(points, found[0]) <= found[1]
        inner[at] = grow(points[near], want // 2)
        outer[at] = grow(points[~near], want - want // 2)
        return at

    root = grow(sample, shards)
    return {"vantage": np.array(vantage, np.uint64), "mu": np.array(mu, np.int16), "inner": np.array(inner, np.int64), "outer": np.array(outer, np.int64), "root": np.array([root])}


def route(tree: dict[str, np.ndarray], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, role, index) of the points: role 0 at home, role 1 as queries of shards that overlap their ball.

    At a node only points inside the radius cross over: a pair parted there meets where its outer point is at home.
    """
    shard, role, index = [], [], []
    stack = [(int(tree["root"][0]), np.arange(len(points)), np.arange(0))]
    while stack:
        at, home, query = stack.pop()
        if not len(home) and not len(query):
            continue
        if at < 0:
            for kind, who in ((0, home), (1, query)):
                shard.append(np.full(len(who), -1 - at)), role.append(np.full(len(who), kind)), index.append(who)
            continue
        v, mu = tree["vantage"][at], tree["mu"][at]
        dh, dq = distance(points[home], v), distance(points[query], v)
        stack.append((int(tree["inner"][at]), home[dh <= mu], query[dq - radius <= mu]))
        stack.append((int(tree["outer"][at]), home[dh > mu], np.concatenate((home[(dh <= mu) & (dh + radius > mu)], query[dq + radius > mu]))))
    return np.concatenate(shard), np.concatenate(role), np.concatenate(index)


# --- in one shard ------------------------------------------------------------------------------------------------


class Forest:
    """Disjoint sets over 0..n-1, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while len(i):
            a, b = p[i], p[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(i):
                break
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while (q := p[p]).tobytes() != p.tobytes():
                p[:] = q


def compare(points: np.ndarray, home: np.ndarray, query: np.ndarray, radius: int, forest: Forest, among: bool = True) -> None:
    """Joins every pair within ``radius`` of two home points (if ``among``), or of a query and a home point."""
    stack = [(home, query, among)]
    while stack:
        h, q, own = stack.pop()
        if not len(h) or not (own or len(q)):
            continue
        found = split(points[h], radius) if len(h) > LEAF else None
        if found is None:
            _exact(points, h, q, radius, forest, own)
            continue
        v, mu = found
        dh, dq = distance(points[h], v), distance(points[q], v)
        inner = dh <= mu
        stack.append((h[inner], q[dq - radius <= mu], own))
        if own:
            stack.append((h[~inner], np.concatenate((q[dq + radius > mu], h[inner & (dh + radius > mu)])), True))
        else:
            stack.append((h[~inner], q[dq + radius > mu], False))


def _exact(points: np.ndarray, h: np.ndarray, q: np.ndarray, radius: int, forest: Forest, own: bool) -> None:
    with_ = np.concatenate((h, q)) if own else q
    rows = max(1, (1 << 20) // max(1, len(h)))
    for at in range(0, len(with_), rows):
        part = with_[at : at + rows]
        i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[h][None, :]) <= radius)
        i, j = part[i], h[j]
        keep = i != j
        if keep.any():
            forest.join(i[keep], j[keep])


def _shard_links(radius: int):
    """For a group of (task key, kind, part, fp): links of each point to the first of its set within the group."""

    def run(data: pa.Table) -> pa.Table:
        points = data.column("fp").to_numpy().view(np.uint64)
        part = data.column("part").to_numpy()
        kind = data.column("kind")[0].as_py()
        forest = Forest(len(points))
        left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        compare(points, left, right, radius, forest, among=kind == 0)
        order = np.lexsort((points, forest.parent))
        root = forest.parent[order]
        first = np.concatenate(([True], root[1:] != root[:-1])) if len(root) else np.zeros(0, bool)
        name = points[order][np.maximum.accumulate(np.where(first, np.arange(len(root)), 0))] if len(root) else points
        linked = name != points[order]
        return pa.table({"a": points[order][linked].view(np.int64), "b": name[linked].view(np.int64)})

    return run


def links(spark: SparkSession, prints: DataFrame, count: int, radius: int = 2, shard: int = SHARD, task: int = TASK) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs of ``prints.fp`` within ``radius``.

    ``prints`` has distinct fingerprints, ``count`` of them. The tree is fitted on a bounded sample by hash (24 a
    shard, at most 24 x MAX_SHARDS, 13 MB); it only decides how evenly points are dealt, not which links are found.
    """
    shards = 1
    while shards * shard < count and shards < MAX_SHARDS:
        shards *= 2
    sample = np.zeros(0, np.uint64)
    if shards > 1:
        share = min(1.0, 24 * shards / count)
        rows = prints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toArrow()
        sample = np.sort(rows.column("fp").to_numpy().view(np.uint64))
        sample = sample[np.argsort(sample * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
    tree = build_tree(sample, shards, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                points = batch.column("fp").slice(at, 1 << 14).to_numpy().view(np.uint64)
                if len(points):
                    s, r, i = route(tree, points, radius)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(r, pa.int32()), pa.array(points[i].view(np.int64))], ["shard", "role", "fp"])

    dealt = store(prints.select("fp").mapInArrow(deal, "shard bigint, role int, fp bigint"), "shards")
    full = dealt.df.groupBy("shard").agg(F.count_if(F.col("role") == 0).alias("h"), F.count_if(F.col("role") == 1).alias("q")).where(f"h > {task} or q > {task}")
    sizes = {r.shard: (max(1, -(-r.h // task)), -(-r.q // task)) for r in full.collect()}  # MAX_SHARDS rows at most
    tasks = _in_blocks(dealt.df, sizes)
    found = store(tasks.groupBy("shard", "kind", "x", "y").applyInArrow(_shard_links(radius), "a bigint, b bigint"), "links")
    dealt.remove()
    return found.df


def _in_blocks(dealt: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Adds the task (kind, x, y) and the side (part) of each row.

    A shard within the bound is one task: home points are part 0, queries part 1, kind 0 also compares part 0 with
    itself. A fuller one, such as a large family of near copies, is dealt into blocks: every two of its home
    blocks meet in one task, and every block of queries meets every home block.
    """
    usual = dealt.select("shard", F.lit(0).alias("kind"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("role").alias("part"), "fp")
    if not sizes:
        return usual
    spark = dealt.sparkSession
    wide = F.broadcast(spark.createDataFrame([(s, h, q) for s, (h, q) in sizes.items()], "shard bigint, h int, q int"))  # MAX_SHARDS rows of 16 bytes at most
    usual = usual.join(wide, "shard", "left_anti")
    hot = dealt.join(wide, "shard").withColumn("b", F.pmod(F.xxhash64("fp"), F.when(F.col("role") == 0, F.col("h")).otherwise(F.col("q"))).cast("int"))
    own = F.col("role") == 0
    among = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(F.when(j == F.col("b"), 0).otherwise(1).alias("kind"), F.least(j, F.col("b")).alias("x"), F.greatest(j, F.col("b")).alias("y"), F.when(F.col("b") <= j, 0).otherwise(1).alias("part")))
    asked = F.when(F.col("q") > 0, F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: F.struct(F.lit(2).alias("kind"), j.alias("x"), F.col("b").alias("y"), F.lit(0).alias("part")))).otherwise(F.array().cast("array<struct<kind:int,x:int,y:int,part:int>>"))
    asks = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(F.lit(2).alias("kind"), F.col("b").alias("x"), j.alias("y"), F.lit(1).alias("part")))
    kind = "array<struct<kind:int,x:int,y:int,part:int>>"
    hot = hot.select("shard", F.explode(F.when(own, F.concat(among.cast(kind), asked.cast(kind))).otherwise(asks.cast(kind))).alias("t"), "fp")
    return usual.unionByName(hot.select("shard", "t.kind", "t.x", "t.y", "t.part", "fp"))


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = 2, shingle: int = 3, shard: int = SHARD, task: int = TASK) -> DataFrame:
    """(doc_id, key, fp, component_id, group), one row a document; component_id is the smallest doc_id that links reach,
    group a fingerprint that names the component also where no row of it has a doc_id."""
    prints = store(fingerprints(docs, shingle), "fingerprints")
    groups = store(prints.df.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "groups")
    found = links(spark, groups.df, groups.df.count(), radius, shard, task)
    parts = connected_components(found)
    named = groups.df.join(parts.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = store(named.select("fp", "component").join(least, "component").select("fp", "component", "component_id"), "components")
    whole = groups.df.join(named.df, "fp", "left")
    whole = whole.select("fp", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("component", "fp").alias("group"))
    whole: Stored = store(whole, "named")
    for old in (groups, named):
        old.remove()
    return prints.df.join(whole.df, "fp").select("doc_id", "key", "fp", "component_id", "group")


def without_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``found`` (doc_id, key, group): that of the smallest doc_id, rows without
    one last, then of the smallest hash of the text, and of rows equal in both that of the smallest hash of all columns.
    """
    of, key, stay = fresh(docs, "__of", "__key", "__stays")
    rows = store(found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("n")), "rows-of-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    several = rows.df.groupBy("group").agg(first, F.sum("n").alias("size")).where("size > 1").select("group", "one")
    several = store(several, "firsts")  # its own exchange on both sides of the join, which adaptive execution can split
    stays = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("key") == F.col("one.key"))
    few = broadcast_if_small(several.df, stored_bytes(found.sparkSession, several.path) * 4)
    marks = rows.df.join(few, "group").withColumn("stays", stays).where("n > 1 or not stays")
    marks = marks.select(F.col("doc_id").alias(of), F.col("key").alias(key), F.col("stays").alias(stay))
    marks = store(marks, "copies")
    rows.remove(), several.remove()
    counts = {r[0]: r[1] for r in marks.df.groupBy(stay).count().collect()}
    same = docs["doc_id"].eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"]) == F.col(key))
    gone, repeated = (broadcast_if_small(marks.df.where(F.col(stay) == s), 32 * counts.get(s, 0)) for s in (False, True))
    kept = docs.join(gone, same, "left_anti")
    if not counts.get(True):
        return kept
    columns = [docs[f"`{c}`"] for c in docs.columns]
    one = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")
    folded = kept.join(repeated, same).groupBy(of, key).agg(one).select("row.*")
    return kept.join(repeated, same, "left_anti").unionByName(folded)


def keep_first(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The documents with one row of each group of near copies, as ``without_copies`` chooses it.

    Rows that share a doc_id are judged each by its own text. Columns of any other name pass through.
    """
    return without_copies(docs, near_duplicates(docs.sparkSession, docs, radius, shingle))


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents", spread=True))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLES: dict[str, str] = {}
