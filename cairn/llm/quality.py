"""Quality by Bradley-Terry ranking.

Each preference pair is a document of label 1 and one of label 0. A document's strength is a weighted sum of
features of its text; the weights minimise the mean logistic loss of the pairs' feature differences. The threshold is
the quantile that parts the labels best, of strengths by weights that were learnt on other folds: strengths by weights
learnt on the same rows part further than those of new rows, most of all with few bad ones. It lies midway between
the rows on its sides. A score is the logistic of the strength, shifted so that the threshold is ACCEPT.

Fitting takes every labelled row outside the held-out fifth and every pair of a good and a bad one. Pairs are not listed: a
row's loss is a smooth function of its strength alone, which the driver makes of sums over cells of strengths. Newton's
method takes two passes over the stored features a step, for the model and those of all folds at once; what goes to the
driver are sums, whose number follows the spread of the strengths, not the rows. Steps use the second derivatives at the
middles of the cells, which changes the way to the minimum and not the minimum. Weights are rounded to 1e-6 of a
standard deviation, so that the order in which rows are summed does not show.

Features are computed once for every whole text. Defined cases: null and
empty texts have all features nought, the weakest words and lines can be, and the score that those have under the fit; without labels of both classes every score is 1 if no
row is labelled 0, else 0; contradicting labels are as in ``labelled.usable``, and of several texts of one doc_id the one
of the smallest features is learnt from; documents of equal
strength have equal scores; rows stay as they are; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial import polynomial
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import bounded, slices, utf8
from cairn.llm.labelled import held_out, usable
from cairn.session import table
from cairn.storage import store

#: Folds whose strengths choose the threshold; rows of a class that are dealt out to them in one window, about.
FOLDS, DEALT = 5, 256
#: Width of a cell of strengths, and terms of the series within it: with them a pair's loss is right to about 1e-11.
CELL, TERMS = 0.25, 10
#: Weight of the squares of the weights beside the mean loss of the pairs; Newton steps at most, and the last one's size.
RIDGE, STEPS, SMALL = 1e-3, 60, 1e-9
#: Rows that a kernel takes at once (10 MB of features); strengths that the driver sorts (9 bytes each), at most.
KERNEL_ROWS, SORTED = 65_536, 500_000
#: The score from which a document counts as good.
ACCEPT = 0.3

_KIND = np.zeros(256, np.int64)  # lower case, upper case, digit, white space, stop, other ASCII, beyond ASCII
_KIND[:] = 5
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:?"]] = 4
_KIND[128:] = 6
_MARKS = b"!#$%&*|<>@{}[]=_~^\\/+\"'()-"
FEATURES = 18


def features(text: bytes) -> np.ndarray:
    """Shares of kinds of bytes, and how words and lines repeat."""
    out = np.zeros(FEATURES)
    words = text.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:7] = np.bincount(_KIND, counts, 7) / len(text)
    marks = counts[list(_MARKS)]
    out[7], out[8] = marks.max() / len(words), np.log1p(marks.sum()) / np.log1p(len(text))
    distinct = len(set(words))
    out[9] = distinct / len(words)
    out[10] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
    out[11] = np.log1p(len(words))
    out[12] = len(text) / len(words) / 10
    out[13] = max(map(len, words)) / 100
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[14] = len(set(lines)) / len(lines)
    out[15] = np.log1p(len(words) / len(lines))
    out[16] = sum(x.rstrip()[-1:] in b".!?:" for x in lines) / len(lines)
    out[17] = np.log(distinct / len(words))
    return out


@dataclass
class Model:
    weights: tuple[float, ...]
    shift: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.scores_of(np.stack([features(t) for t in texts]) if texts else np.zeros((0, FEATURES)))

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(strengths(x, np.array(self.weights)) + self.shift, -60, 60)))


def strengths(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows are equally strong wherever they lie."""
    return (np.ascontiguousarray(x) * w).sum(axis=1)


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights under which good beats bad, pair by pair, by Newton's method on the logistic loss of the differences."""
    d = good - bad
    w, penalty = np.zeros(d.shape[1]), ridge * len(d) * np.eye(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + penalty, d.T @ (p - 1) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) of each row: the features of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.stack([features(t) for t in utf8(part)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), lists], ["doc_id", "held_out", "x"])

    return bounded(docs.select("doc_id", held_out().alias("held_out"), "text")).mapInArrow(run, "doc_id bigint, held_out boolean, x array<double>")


def learnt_rows(rows: DataFrame, told: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(y, fold, x) of every labelled row of ``featured``; the folds of a class differ by one row in each window."""
    found = rows.where("not held_out").join(told, "doc_id").groupBy("doc_id", F.col("label").alias("y")).agg(F.min("x").alias("x"))
    windows = F.when(F.col("y") == 1, counts.get(1, 0) // DEALT + 1).otherwise(counts.get(0, 0) // DEALT + 1)
    at = F.xxhash64("doc_id", F.lit(11))
    place = F.row_number().over(Window.partitionBy("y", F.pmod(at, windows)).orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id"))
    return found.select("y", (place % FOLDS).alias("fold"), "x")


def _summed(rows: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[tuple[int, int], np.ndarray]]) -> dict[tuple[int, int], np.ndarray]:
    """The sums of what ``kernel`` makes of (x, y, fold) of some rows at a time, by its keys (two numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(held: list[pa.RecordBatch]) -> None:
            x = np.concatenate([b.column("x").flatten().to_numpy() for b in held]).reshape(-1, FEATURES)
            y, fold = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("y", "fold"))
            for key, v in kernel(x, y, fold).items():
                sums[key] = sums[key] + v if key in sums else v

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
            if n >= KERNEL_ROWS:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sums[k] for k in keys], pa.list_(pa.float64()))], ["a", "b", "v"])

    got = rows.mapInArrow(run, "a bigint, b bigint, v array<double>").toArrow().combine_chunks()
    if not got.num_rows:
        return {}
    keys, at = np.unique(np.stack([got.column(c).to_numpy() for c in ("a", "b")], axis=1), axis=0, return_inverse=True)
    values = got.column("v").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    out = np.zeros((len(keys), values.shape[1]))
    np.add.at(out, at.ravel(), values)
    return {(int(a), int(b)): v for (a, b), v in zip(keys, out, strict=True)}


def _shape(x: np.ndarray, y: np.ndarray, fold: np.ndarray, middle: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """By class and fold: number of rows, sums and sums of squares of the features' distances from ``middle``."""
    out = {}
    for k, f in {*zip(y.tolist(), fold.tolist(), strict=True)}:
        d = x[(y == k) & (fold == f)] - middle
        out[k, f] = np.concatenate(([len(d)], d.sum(axis=0), (d * d).sum(axis=0)))
    return out


def _placed(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of strengths and the powers, over factorials, of their distances from the cells' middles."""
    cell = np.floor(s / CELL).astype(np.int64)
    e = s - (cell + 0.5) * CELL
    powers = np.ones((len(s), TERMS))
    for p in range(1, TERMS):
        powers[:, p] = powers[:, p - 1] * e / p
    return cell, powers


def _cells(x, y, fold, models: dict[int, np.ndarray], middle: np.ndarray, scale: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """By model and 2 cell + class: the sums of the powers and of the features."""
    z, out = (x - middle) / scale, {}
    for m, w in models.items():
        rows = fold != m
        cell, powers = _placed(strengths(z[rows], w))
        key = 2 * cell + y[rows]
        order = np.argsort(key, kind="stable")
        if len(order):
            starts = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
            sums = np.add.reduceat(np.hstack((powers, z[rows]))[order], starts)
            out |= {(m, int(k)): v for k, v in zip(key[order[starts]], sums, strict=True)}
    return out


def _slopes(x, y, fold, models: dict[int, np.ndarray], tables: dict[int, list], middle: np.ndarray, scale: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """By model: the slope of the summed loss and the rows' own part of its second derivatives."""
    z, out = (x - middle) / scale, {}
    for m, w in models.items():
        for k, sign in ((0, 1.0), (1, -1.0)):
            rows = (fold != m) & (y == k)
            cells, series, bend = tables[m][k]
            cell, powers = _placed(strengths(z[rows], w))
            at, d = np.searchsorted(cells, cell), z[rows]
            slope = sign * ((powers * series[at]).sum(axis=1) @ d)
            out[m, k] = np.concatenate((slope, ((d * bend[at][:, None]).T @ d).ravel()))
    return out


def _derivatives() -> list[np.ndarray]:
    """The logistic function and its derivatives as polynomials of its value."""
    out = [np.array([0.0, 1.0])]
    for _ in range(2 * TERMS - 2):
        out.append(polynomial.polymul(polynomial.polyder(out[-1]), [0.0, 1.0, -1.0]))
    return out


def _met(bad: np.ndarray, m0: np.ndarray, good: np.ndarray, m1: np.ndarray) -> tuple[list, np.ndarray]:
    """What rows of each class meet in the other one, as series in the cells (``_slopes``), and the mixed part of the
    second derivatives. ``m0`` and ``m1`` are the sums of ``_cells`` of the cells ``bad`` and ``good``."""
    series0, series1 = np.zeros((len(bad), TERMS)), np.zeros((len(good), TERMS))
    bend0, bend1, mixed = np.zeros(len(bad)), np.zeros(len(good)), np.zeros((FEATURES, FEATURES))
    odd = (-1.0) ** np.arange(TERMS)
    for a in range(0, len(good), 256):
        b = slice(a, a + 256)
        far = np.clip((bad[None, :] - good[b, None]) * CELL, -700, 700)
        value = 1 / (1 + np.exp(-far))
        for n, p in enumerate(_derivatives()):
            d = polynomial.polyval(value, p)
            for q in range(max(0, n - TERMS + 1), min(n, TERMS - 1) + 1):  # q of the good row's powers, n - q of the bad one's
                series1[b, q] += odd[q] * (d @ m0[:, n - q])
                series0[:, n - q] += odd[q] * (m1[b, q] @ d)
            if n == 1:
                bend1[b] = d @ m0[:, 0]
                bend0 += m1[b, 0] @ d
                mixed += m1[b, TERMS:].T @ d @ m0[:, TERMS:]
    return [(bad, series0, bend0), (good, series1, bend1)], mixed


def all_pairs_weights(rows: DataFrame, sizes: dict[int, tuple[int, int]], middle: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """The weights, in units of ``scale``, of each model of ``sizes``: by the fold it is not learnt on (-1: none), its
    numbers of bad and good rows. Newton's method on the mean logistic loss of all pairs; a step after which the slope is
    steeper is halved."""
    at = {m: np.zeros(FEATURES) for m in sizes}
    left, before = dict(at), {}
    for _ in range(STEPS):
        sums = _summed(rows, lambda x, y, fold, now=dict(left): _cells(x, y, fold, now, middle, scale))
        tables, mixed = {}, {}
        for m in left:
            cells = {k: np.array(sorted(c >> 1 for a, c in sums if a == m and c & 1 == k)) for k in (0, 1)}
            told = {k: np.stack([sums[m, 2 * int(c) + k] for c in cells[k]]) for k in (0, 1)}
            tables[m], mixed[m] = _met(cells[0], told[0], cells[1], told[1])
        sums = _summed(rows, lambda x, y, fold, now=dict(left), tables=tables: _slopes(x, y, fold, now, tables, middle, scale))
        for m, w in list(left.items()):
            both, pairs = sums[m, 0] + sums[m, 1], sizes[m][0] * sizes[m][1]
            slope = both[:FEATURES] / pairs + RIDGE * w
            bend = (both[FEATURES:].reshape(FEATURES, FEATURES) - mixed[m] - mixed[m].T) / pairs + RIDGE * np.eye(FEATURES)
            steep = np.abs(slope).max()
            if m in before and steep > before[m][2] and steep > 1e-12:
                start, step, was = before[m]
                before[m] = (start, step / 2, was)
            else:
                before[m] = (w, -np.linalg.solve(bend, slope), steep)
            at[m] = left[m] = before[m][0] + before[m][1]
            if np.abs(before[m][1]).max() < SMALL:
                del left[m]
        if not left:
            break
    return {m: np.round(w, 6) for m, w in at.items()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Weights and threshold from all labelled rows outside the held-out fifth."""
    return fit_features(featured(docs), labels, label)


def fit_features(features: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """``fit`` on rows of ``featured``."""
    told = usable(labels, label, [0, 1])
    counts = {r.label: r.n for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    stored = store(learnt_rows(features, told, counts), "learnt")
    rows, nought = stored.df, np.zeros(FEATURES)
    shape = _summed(rows, lambda x, y, fold: _shape(x, y, fold, nought))
    n = {k: sum(int(v[0]) for (c, _), v in shape.items() if c == k) for k in (0, 1)}
    if not n[0] or not n[1]:
        stored.remove()
        return Model((0.0,) * FEATURES, -60.0 if counts.get(0) else 60.0)
    middle = sum(v[1 : FEATURES + 1] for v in shape.values()) / sum(n.values())
    shape = _summed(rows, lambda x, y, fold: _shape(x, y, fold, middle))  # squares about the mean: constant features have none
    spread = np.sqrt(sum(v[FEATURES + 1 :] for v in shape.values()) / sum(n.values()))
    scale = np.array([float(f"{s:.9g}") if s > 1e-9 else 1.0 for s in spread])
    both = all(any(c == k and f != m for c, f in shape) for k in (0, 1) for m in range(FOLDS))
    models = [-1, *(range(FOLDS) if both and min(n.values()) >= FOLDS else ())]  # of fewer rows there is nothing to spare
    sums = {m: [sum(v[: FEATURES + 1] for (c, f), v in shape.items() if c == k and f != m) for k in (0, 1)] for m in models}
    weights = {m: w / scale for m, w in all_pairs_weights(rows, {m: (int(s[0][0]), int(s[1][0])) for m, s in sums.items()}, middle, scale).items()}
    means = {m: [float(weights[m] @ (s[k][1:] / s[k][0] + middle)) for k in (0, 1)] for m, s in sums.items()}
    low, high = _parted(_apart(rows, weights, means), sum(n.values()))
    stored.remove()
    threshold = means[-1][0] + (low + high) / 2 * (means[-1][1] - means[-1][0])
    return Model(tuple(weights[-1].tolist()), round(float(np.log(ACCEPT / (1 - ACCEPT)) - threshold), 9))


def _apart(rows: DataFrame, weights: dict[int, np.ndarray], means: dict[int, list[float]]) -> DataFrame:
    """(y, s): each row's strength by weights learnt without it, in units of the distance between the classes' means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES), batch.column("fold").to_numpy()
            s = np.zeros(len(fold))
            for m, w in weights.items():
                here = fold == m if len(weights) > 1 else np.ones(len(fold), bool)
                s[here] = (strengths(x[here], w) - means[m][0]) / ((means[m][1] - means[m][0]) or 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(s)], ["y", "s"])

    return rows.mapInArrow(run, "y int, s double")


def _parted(told: DataFrame, n: int, most: int = SORTED) -> tuple[float, float]:
    """``parting`` of the rows (y, s), each of weight one: of more than ``most`` rows by ranges of strengths."""
    if n <= most:
        rows = told.toArrow()
        y = rows.column("y").to_numpy()
        return parting(rows.column("s").to_numpy(), y, np.ones(len(y)))
    stored = store(told.groupBy("s").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")), "strengths")
    k = max(2, -(-2 * n // most))
    edges = sorted(set(stored.df.approxQuantile("s", [i / k for i in range(1, k)], 0.1 / k)))
    ranged = stored.df.withColumn("range", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("s"))))
    ends = ranged.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("range").collect()
    good, bad, starts = 0, sum(r.b for r in ends), []
    for i, r in enumerate(ends):  # a row a range: wrong labels at its start, and the strength before it
        starts.append((r.range, good + bad, ends[i - 1].high if i else None))
        good, bad = good + r.g, bad - r.b
    before = Window.partitionBy("range").orderBy("s")
    change = F.coalesce(F.sum(F.col("good") - F.col("bad")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = ranged.join(F.broadcast(told.sparkSession.createDataFrame(starts, "range int, start bigint, last double")), "range")
    places = store(places.select("s", (F.col("start") + change).alias("wrong"), F.coalesce(F.lag("s").over(before), "last").alias("below")), "places")
    fewest = min(places.df.agg(F.min("wrong")).first()[0], good)  # beyond the last one all are rejected
    best = places.df.where(F.col("wrong") == fewest)
    found = best.count()
    beyond = (ends[-1].high - ends[0].low) / n or 1.0
    if (found + (good == fewest)) // 2 == found:
        out = (ends[-1].high, ends[-1].high + beyond)
    else:
        r = best.orderBy("s").offset((found + (good == fewest)) // 2).limit(1).first()
        out = (ends[0].low - beyond if r.below is None else r.below, r.s)
    stored.remove()
    places.remove()
    return out


def parting(strength: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The ends of the quantile interval that parts the labels best: of the weakest accepted and the strongest rejected
    row, over all places where the fewest labels (by weight) are on the wrong side."""
    order = np.argsort(strength, kind="stable")
    s, good, bad = strength[order], np.where(y[order] == 1, weight[order], 0), np.where(y[order] == 0, weight[order], 0)
    wrong = np.concatenate(([0.0], np.cumsum(good))) + np.concatenate((np.cumsum(bad[::-1])[::-1], [0.0]))
    apart = np.concatenate(([True], s[1:] > s[:-1], [True]))  # rows of equal strength are on one side
    places = np.flatnonzero(apart & (wrong <= wrong[apart].min() + 1e-9))
    at = int(places[len(places) // 2])
    beyond = float(s[-1] - s[0]) / len(s) or 1.0  # where all rows are on one side
    return float(s[at - 1]) if at else float(s[0]) - beyond, float(s[at]) if at < len(s) else float(s[-1]) + beyond


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    return scored_features(featured(docs), model)


def scored_features(rows: DataFrame, model: Model) -> DataFrame:
    """``scored`` of rows of ``featured``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores_of(batch.column("x").flatten().to_numpy().reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= ACCEPT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(featured(table(spark, sf_dir, "documents", spread=True)), "features").df
    return scored_features(rows, fit_features(rows, table(spark, sf_dir, "labels")))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
