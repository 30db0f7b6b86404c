"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, and a document's windows are compressed
with each. A window's distance is how many bytes shorter the toxic dictionary compresses it; a document's features
come from its windows' distances alone, and thresholds on them are calibrated by a logistic regression.

Both dictionaries end in the same part, trained on whole ordinary documents (BASE_BYTES): it explains what any text
of these languages shares, so that the two differ by CLASS_BYTES each, and ordinary text costs much the same with
either. The parts of their own are trained on windows of toxic and of other ordinary documents. Most windows of a
toxic document are ordinary, so it is not known which of them are toxic; they are sought as in learning from bags:

1. at first, windows of either class that the shared part alone compresses worst (beyond the NOVEL quantile of
   ordinary windows);
2. then, REFINE times, the windows of toxic documents whose distance is beyond the CHANCE quantile of ordinary ones,
   measured by dictionaries that were trained on the other folds, never on the document itself.

Equal windows are trained on once, so that copies of a document weigh no more than one. The calibration sees
out-of-fold distances only. Words are lower-cased (A-Z) and end at ASCII white space.

Fitting uses a bounded sample of labelled rows (ROWS a class, ``labelled.SAMPLE_BYTES`` of text a class); scoring reads
every whole text. Defined cases: null and empty texts have no window and get the score of features nought; without
labels of both classes every score is the share of toxic labels (0 without any); where out-of-fold distances do not tell
the classes apart (SEPARATES), scores stand but ``keep_ordinary`` rejects nothing; where samples are too few for
zstandard's trainer, a dictionary is the samples themselves, so the distances are then those of plain text; repeated
doc_ids and contradicting labels are as in ``labelled.sample``; rows stay as they are, ties are impossible; columns
besides doc_id and text are ignored by ``scored`` and kept by ``keep_ordinary``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import bounded, slices, utf8
from cairn.llm.labelled import held_out, sample
from cairn.session import table

#: Words of a window; compression level.
WINDOW, LEVEL = 16, 9
#: Labelled rows of a class that the model is fitted on, at most.
ROWS = {1: 2000, 0: 4000}
#: Bytes of the part that both dictionaries share, and of each one's own part.
BASE_BYTES, CLASS_BYTES = 200_000, 4096
#: Length of the trainer's segments and of the strings it counts, for the shared and for the own parts.
BASE_PIECES, CLASS_PIECES = (64, 8), (16, 8)
#: Distinct windows that a dictionary is trained on, at most, and the bits of the table in which the trainer counts
#: their strings (its default of 20 bits is too small for so much text).
TRAIN_WINDOWS, TABLE_BITS = 20_000, 22
#: Folds; rounds in which toxic windows are chosen anew; the quantiles that choose windows.
FOLDS, REFINE, NOVEL, CHANCE = 8, 2, 0.8, 0.98
#: Standard deviations by which out-of-fold distances must tell the classes apart before documents are rejected.
SEPARATES = 3.0
#: A document's distances are summed beyond each of so many bytes.
BEYOND = (1, 2, 3, 4, 6, 8)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] | None
    prior: float
    #: Whether distances that were measured apart from learning tell the classes from each other.
    separates: bool = True


@dataclass
class Windows:
    """The windows of some texts, side by side in one buffer."""

    buffer: bytes
    start: np.ndarray
    size: np.ndarray
    owner: np.ndarray

    def __getitem__(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.start[i] + self.size[i]]

    def lengths(self, compressor: zstandard.ZstdCompressor, which: np.ndarray | None = None) -> np.ndarray:
        """Compressed bytes of each window (of those in ``which``)."""
        start, size = (self.start, self.size) if which is None else (self.start[which], self.size[which])
        if not len(start):
            return np.zeros(0, np.int64)
        segments = np.stack((start, size), axis=1).astype(np.uint64)
        parts = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(self.buffer, segments.tobytes()), threads=1)
        return np.fromiter(map(len, parts), np.int64, len(start))


def windows(texts: list[bytes]) -> Windows:
    """Runs of WINDOW words with a space before, between and after them; the last of a text may be shorter."""
    buffers, starts, sizes, owners, at = [], [], [], [], 0
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
        first = np.arange(0, len(words), WINDOW)
        a, b = edges[first], edges[np.minimum(first + WINDOW, len(words))] + 1
        starts.append(a + at), sizes.append(b - a), owners.append(np.full(len(first), i))
        buffers.append(b" " + b" ".join(words) + b" ")
        at += len(buffers[-1])
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Windows(b"".join(buffers), whole(starts), whole(sizes), whole(owners))


def trained(n_bytes: int, samples: list[bytes], pieces: tuple[int, int]) -> bytes:
    """A dictionary of ``n_bytes`` by zstandard's trainer; the samples themselves where they are too few for it."""
    if sum(map(len, samples)) > n_bytes:
        try:
            return zstandard.train_dictionary(n_bytes, samples, k=pieces[0], d=pieces[1], f=TABLE_BITS).as_bytes()
        except zstandard.ZstdError:  # fewer or shorter samples than the trainer accepts
            pass
    return b"".join(samples)[-n_bytes:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Frames without any header field that would add the same bytes to each window."""
    made = zstandard.ZstdCompressionDict(dictionary or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def document_features(distance: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row a document: largest distance, logarithms of the sums beyond each of BEYOND, and of its windows."""
    out = np.zeros((n, len(BEYOND) + 2))
    np.maximum.at(out[:, 0], owner, distance)
    for k, least in enumerate(BEYOND, 1):
        np.add.at(out[:, k], owner, np.maximum(0, distance - least))
    out[:, -1] = np.bincount(owner, minlength=n)
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.ordinary, self.toxic = (compressor(model.ordinary), compressor(model.toxic)) if model.weights else (None, None)

    def features(self, texts: list[bytes]) -> np.ndarray:
        found = windows(texts)
        return document_features(found.lengths(self.ordinary) - found.lengths(self.toxic), found.owner, len(texts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.model.weights is None:
            return np.full(len(texts), self.model.prior)
        w = np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[1:] + w[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression with intercept, by Newton's method."""
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * len(x)
        step = np.linalg.solve(curvature, x.T @ (weight * (p - y)) + penalty @ w * len(x))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class _Bags:
    """Windows of labelled documents, folds of the documents, and dictionaries trained on some of the windows."""

    def __init__(self, texts: list[bytes], y: np.ndarray, rng: np.random.Generator):
        self.y, self.rng, self.all = y, rng, windows(texts)
        ordinary = rng.permutation(np.flatnonzero(y == 0))
        self.spare = np.ones(len(y), bool)  # documents that the shared part does not hold
        self.spare[ordinary[: len(ordinary) // 2]] = False
        self.fold = rng.permutation(len(y)) % FOLDS
        self.of = lambda documents: documents[self.all.owner]
        self.base = self.train(~self.of(self.spare), BASE_BYTES, BASE_PIECES)

    def train(self, mask: np.ndarray, n_bytes: int, pieces: tuple[int, int]) -> bytes:
        some = dict.fromkeys(self.all[i] for i in self.rng.permutation(np.flatnonzero(mask)))
        return trained(n_bytes, list(some)[:TRAIN_WINDOWS], pieces)

    def pair(self, ordinary: np.ndarray, toxic: np.ndarray) -> tuple[bytes, bytes]:
        """The two dictionaries: own part first, shared part last, where matches lie nearest."""
        return tuple(self.train(mask, CLASS_BYTES, CLASS_PIECES) + self.base for mask in (ordinary, toxic))

    def fit(self) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
        """Both dictionaries, the documents to calibrate on, and their out-of-fold features."""
        is_toxic, spare = self.of(self.y == 1), self.of(self.spare)
        ratio = self.all.lengths(compressor(self.base)) / self.all.size
        novel = spare & (ratio > _quantile(ratio[spare & ~is_toxic], NOVEL))
        ordinary, toxic = novel & ~is_toxic, novel & is_toxic
        distance = self._across(ordinary, toxic)
        for _ in range(REFINE):
            beyond = is_toxic & (distance > _quantile(distance[spare & ~is_toxic], CHANCE))
            toxic = beyond if beyond.any() else toxic
            distance = self._across(ordinary, toxic)
        features = document_features(distance, self.all.owner, len(self.y))
        return *self.pair(ordinary, toxic), np.flatnonzero(self.spare), features[self.spare]

    def _across(self, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Distances of the spare documents' windows by dictionaries of the other folds."""
        out, fold = np.zeros(len(self.all.owner), np.int64), self.of(self.fold)
        for f in np.unique(self.fold):
            mine = np.flatnonzero((fold == f) & self.of(self.spare))
            others = fold != f
            a, b = (compressor(d) for d in self.pair(ordinary & others, toxic & others))
            out[mine] = self.all.lengths(a, mine) - self.all.lengths(b, mine)
        return out


def _quantile(values: np.ndarray, q: float) -> float:
    return float(np.quantile(values, q)) if len(values) else 0.0


def learn(texts: list[bytes], y: np.ndarray, prior: float, seed: int = 17) -> Model:
    """The model of labelled texts; ``prior`` is the share of toxic rows that the calibration assumes."""
    if not (y == 0).any() or not (y == 1).any():
        return Model(b"", b"", None, prior, False)
    ordinary, toxic, who, x = _Bags(texts, y, np.random.default_rng(seed)).fit()
    y = y[who]
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    return Model(ordinary, toxic, tuple(logistic(x, y, weight).tolist()), prior, separation(x[:, 1:-1].sum(axis=1), y) > SEPARATES)


def separation(values: np.ndarray, y: np.ndarray) -> float:
    """How many standard deviations the rank sum of class 1 lies above that of values without any meaning."""
    ones, noughts = int((y == 1).sum()), int((y == 0).sum())
    if not ones or not noughts:
        return 0.0
    _, which, size = np.unique(values, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - (size - 1) / 2)[which]  # ties share their mean rank
    n, ties = ones + noughts, float((size**3 - size).sum())
    spread = ones * noughts / 12 * ((n + 1) - ties / (n * (n - 1)))
    return float((rank[y == 1].sum() - ones * (n + 1) / 2) / np.sqrt(spread)) if spread > 0 else 0.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Dictionaries and calibration from a bounded sample outside the held-out fifth."""
    texts, y, counts = sample(docs, labels, label, ROWS)
    total = sum(counts.values())
    return learn(texts, y, counts.get(1, 0) / total if total else 0.0)


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                score = scorer.scores(utf8(part))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64())]
                predicted = pa.array((score >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*columns, predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = bounded(docs.select("doc_id", held_out().alias("held_out"), "text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns as they are.

    Nothing is rejected by a model that does not separate: with a handful of labels scores are near the share of toxic
    ones, whatever a text says.
    """
    if not model.separates:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(scorer.scores(utf8(part)) < threshold))

    return bounded(docs).mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
