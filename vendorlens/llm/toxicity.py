"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy is trained from confirmed toxic texts (P) and texts of which no label
is known (U), by the class-prior-corrected risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

whose second part is kept from going negative: when it would, the step goes the other way.
Labels of 0 are not learned from; they serve for the class prior and, at the end, for the scale on which scores are frequencies.
Features are the distinct words of a text and the first five bytes of its words, by whether they occur once, twice or
three times at least, all hashed; score and training see whole texts. Training is on bounded samples (MAX_POSITIVE, MAX_UNLABELLED and, for the scale, MAX_SCALE rows,
chosen by a hash of the id); scoring is a map over all texts. What features tell P from U is counted on the executors,
and the driver gets those features only.

Defined cases: a null or empty text has no feature and scores as the bias says; repeated rows are
scored each by itself; labels that are null are not used; without any confirmed toxic text every
score is 0; if all documents have labels, U is the labelled ones with their labels forgotten; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import saved
from vendorlens.llm.words import Block, blocks, mix

BITS = 18
SIZE = 4 << BITS
PREFIX = 5
#: Times from which a repeated beginning is a feature of its own.
REPEATS = (1, 2, 3)
#: Most documents that are trained on, by their part in it.
MAX_POSITIVE, MAX_UNLABELLED, MAX_SCALE = 6_000, 14_000, 6_000
#: Texts in which a feature must be to have a weight.
LEAST_TEXTS = 3
SIGNIFICANCE = 5.0


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each row of a block."""
    row = block.row
    word = (block.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    long = np.flatnonzero(block.ends - block.starts > PREFIX)
    cut = Block(0, 0, block.data, block.starts[long], block.starts[long] + PREFIX, np.zeros(1, np.int64))
    head = (mix(cut.hashes() + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    begins, times = np.unique(row[long] * SIZE + head, return_counts=True)
    key = np.unique(np.concatenate([row * SIZE + word, *(begins[times >= n] + (k << BITS) for k, n in enumerate(REPEATS))]))
    return key // SIZE, key % SIZE


@dataclass
class Model:
    """score(x) = sigmoid(scale * (sum of the weights of x's features + bias) + shift)."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def raw(self, block: Block) -> np.ndarray:
        row, feature = features(block)
        return np.bincount(row, weights=self.weights[feature], minlength=block.hi - block.lo) + self.bias

    def scores(self, block: Block) -> np.ndarray:
        return sigmoid(self.scale * self.raw(block) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.feature = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(p) for p in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.feature], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, weights=g[self.row], minlength=size)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], k: int, prior: float, *, steps: int = 120, rate: float = 0.1, penalty: float = 3e-4) -> tuple[np.ndarray, float]:
    """(weights of k features, bias) that minimise the non-negative risk by Adam, all rows at once."""
    p, u = _Rows(positive), _Rows(unlabelled)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        sp, su = sigmoid(p.times(w) + b), sigmoid(u.times(w) + b)
        # losses: log(1 + exp(-z)) for the toxic class, log(1 + exp(z)) for the other
        negative = -np.log1p(-np.clip(su, 0, 1 - 1e-9)).mean() + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-9)).mean()
        g_pos, g_u, g_neg = prior * (sp - 1) / p.n, su / u.n, -prior * sp / p.n
        gp, gu = (g_pos + g_neg, g_u) if negative >= 0 else (-g_neg, -g_u)
        grad = np.append(p.back(gp, k) + u.back(gu, k) + penalty * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def calibrated(z: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Scale and shift for scores that are frequencies of label 1, from labelled training rows."""
    spread = float(z.std()) or 1.0
    x = (z - z.mean()) / spread
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + c)
        d, s = weight * (p - label), weight * (p * (1 - p) + 1e-6)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        da, dc = np.linalg.solve(h, [(d * x).sum(), d.sum()])
        a, c = max(0.05, a - 0.5 * da), c - 0.5 * dc
    return a / spread, c - a * float(z.mean()) / spread


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, part, label, features). Rows: place, part, label, text."""
    for batch in batches:
        for block in blocks(batch.column(3), "ascii", True):
            row, feature = features(block)
            cuts = np.searchsorted(row, np.arange(block.hi - block.lo + 1)).astype(np.int32)
            packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(block.lo, block.hi - block.lo) for k in range(3)), pa.array(packed, pa.binary())], names=["place", "part", "label", "features"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, part, texts) of a batch of rows (part, features)."""
    for batch in batches:
        part = batch.column(0).to_numpy(zero_copy_only=False)
        rows = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
        for k in np.unique(part):
            found, n = np.unique(np.concatenate([r for r, own in zip(rows, part, strict=True) if own == k]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), k), pa.int32()), pa.array(n, pa.int64())], names=["feature", "part", "texts"])


#: The parts of training texts.
_P, _U, _SCALE = 1, 2, 3


def _some(rows: DataFrame, most: int, part: int) -> DataFrame:
    """At most so many of the rows (_id, _label), chosen by a hash of the id, with their part."""
    place = F.xxhash64("_id", F.lit(5))
    n = rows.count()
    if n > 2 * most:  # so that no task and not the driver sorts all of them
        rows = rows.where(F.pmod(place, F.lit(1 << 20)) <= int(1.25 * most / n * (1 << 20)) + 64)
    return rows.select("_id", place.alias("_place"), F.lit(part).alias("_part"), "_label").orderBy("_place", "_id").limit(most)


def trained(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> Model | None:
    """A model from the labelled documents for whose id (``_id``) ``usable`` holds (all, if not given), and from such
    documents without a label.

    None if no confirmed toxic text is among them.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    texts = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    usable = F.lit(True) if usable is None else usable
    known = known.where(usable).groupBy("_id").agg(F.max("_label").alias("_label"))
    total = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if not total.get(1):
        return None
    prior = min(0.9, max(0.001, total[1] / sum(total.values())))
    other = texts.select("_id").where(usable).distinct().join(labels.select(F.col(id_col).alias("_id")), "_id", "left_anti").withColumn("_label", F.lit(0))
    # at most MAX_POSITIVE + MAX_UNLABELLED + MAX_SCALE rows of four numbers
    parts = [_some(known.where("_label = 1"), MAX_POSITIVE, _P), _some(known, MAX_SCALE, _SCALE), _some(known if other.isEmpty() else other, MAX_UNLABELLED, _U)]
    chosen = saved(parts[0].unionByName(parts[1]).unionByName(parts[2]), "toxicity-chosen")
    rows = texts.join(F.broadcast(chosen), "_id").select("_place", "_part", "_label", "_text").mapInArrow(_featured, "place long, part int, label int, features binary")
    rows = saved(rows, "toxicity-features")
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    if not sizes.get(_P) or not sizes.get(_U):
        return None
    counts = rows.where(f"part <> {_SCALE}").select("part", "features").mapInArrow(_counted, "feature int, part int, texts long")
    own = lambda k: F.coalesce(F.sum(F.when(F.col("part") == k, F.col("texts"))), F.lit(0))
    counts = counts.groupBy("feature").agg(own(_P).alias("p"), own(_U).alias("u"))
    # in LEAST_TEXTS texts or more, with a share among the toxic that is SIGNIFICANCE standard deviations from that
    # among all of them; the rest would only let the model learn texts by heart
    share = (F.col("p") + F.col("u") + 0.5) / (sizes[_P] + sizes[_U] + 1)
    z = (F.col("p") / sizes[_P] - share) / F.sqrt(share * (1 - share) / sizes[_P])
    telling = counts.where((F.abs(z) >= SIGNIFICANCE) & (F.col("p") + F.col("u") >= LEAST_TEXTS)).select("feature").collect()
    telling = np.sort(np.array([r.feature for r in telling], np.int64))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(telling, np.intersect1d(np.frombuffer(x, np.int32), telling)).astype(np.int32).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["place", "part", "label", "features"])

    found = rows.mapInArrow(reduced, "place long, part int, label int, features binary").collect()
    found.sort(key=lambda r: (r.part, r.place, r.features))
    x = {k: [np.frombuffer(r.features, np.int32) for r in found if r.part == k] for k in (_P, _U, _SCALE)}
    weights, bias = fit(x[_P], x[_U], len(telling), prior)
    scale, shift = 1.0, 0.0
    if x[_SCALE]:
        y = np.array([r.label for r in found if r.part == _SCALE], float)
        scale, shift = calibrated(_Rows(x[_SCALE]).times(weights) + bias, y, np.ones(len(y)))
    full = np.zeros(SIZE)
    full[telling] = weights
    return Model(full, bias, scale, shift)


def scored(documents: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, by a map over whole texts."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return source.select("id", F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), "ascii", True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), pa.array(shared.value.scores(block))], names=["id", "score"])

    return source.mapInArrow(scan, f"id {documents.schema[id_col].dataType.simpleString()}, score double")


def acceptable(documents: DataFrame, model: Model | None, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at), "ascii", True):
                yield batch.slice(block.lo, block.hi - block.lo).filter(pa.array(shared.value.scores(block) < threshold))

    return documents.mapInArrow(scan, documents.schema)
