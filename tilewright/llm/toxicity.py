"""Toxicity as an ordinal severity: a cumulative-link model over sparse text features.

The model has one weight per hashed word and ordered thresholds that all grades share the weights
with: P(severity > k) = sigmoid(w.x - threshold_k). It is fitted on a bounded sample of labelled
rows; every document is then scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Number of hashed word features.
FEATURES = 1 << 19
#: Lengths of the word beginnings that are features too, for inflected and compound words.
PREFIXES = (3, 5)
#: A document is toxic from this P(severity > 0) on.
CUT = 0.35
_MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_"


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[int, float]
    thresholds: tuple[float, ...]


def word_features(word: str) -> tuple[int, ...]:
    """Features of a word without outer punctuation and case: itself and its first letters."""
    core = word.strip(_MARKS).lower()
    if not core:
        return ()
    parts = [core] + [f"{core[:n]}-" for n in PREFIXES if len(core) > n]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % FEATURES for p in parts)


class FeatureReader:
    """Distinct features of a text with their counts; words seen before are looked up."""

    def __init__(self, keep: int = 300_000) -> None:
        self._known: dict[str, tuple[int, ...]] = {}
        self._keep = keep

    def _learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        if len(self._known) > self._keep:
            self._known.clear()
        for w in words:
            if w not in self._known:
                self._known[w] = word_features(w)
        return self._known

    def present(self, text: str) -> set[int]:
        words = set(text.split())
        known = self._learn(words)
        return set().union(*[known[w] for w in words])

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = Counter(text.split())
        known = self._learn(words)
        out: Counter = Counter()
        for w, n in words.items():
            for f in known[w]:
                out[f] += n
        names = np.array(sorted(out), dtype=np.int32)
        return names, np.array([out[f] for f in names], dtype=np.int32)


class Scorer:
    """Sum of the weights of a text's features; the weights of a word are looked up at once."""

    def __init__(self, model: OrdinalModel, keep: int = 300_000) -> None:
        self._weights, self._keep = model.weights, keep
        self._known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> float:
        words, known, weights = set(text.split()), self._known, self._weights
        if len(known) > self._keep:
            known.clear()
        found: set[int] = set()
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(x for x in word_features(w) if x in weights)
            if f:
                found.update(f)
        return sum(weights[f] for f in sorted(found))


def _training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Labels, features, counts and weights of a fixed sample of at most ``per_class`` labelled rows per label.

    A document labelled more than once counts with its highest label. A row's weight is the number of
    labelled documents it stands for, so labels keep the shares that they have in the data.
    """
    graded = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {r.y: r.n for r in graded.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").limit(16).collect()}
    chosen = None
    for y in totals:
        part = graded.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return np.zeros(0, dtype=np.int64), [], [], np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FeatureReader()
        for batch in batches:
            keep = [reader.counted(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in keep], pa.list_(pa.int32())),
                 pa.array([c for _, c in keep], pa.list_(pa.int32()))], names=["doc_id", "y", "features", "counts"])

    # At most 16 x per_class rows of two numbers: small enough to be sent to every task.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    found = joined.mapInArrow(run, "doc_id long, y int, features array<int>, counts array<int>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    pa.default_memory_pool().release_unused()

    def lists(name: str) -> list[np.ndarray]:
        column = found.column(name).combine_chunks()
        flat, cuts = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]

    y = found.column("y").to_numpy().astype(np.int64)
    stands_for = np.array([totals[k] / min(per_class, totals[k]) for k in y.tolist()])
    return y, lists("features"), lists("counts"), stands_for


def severity_grades(y: np.ndarray, features: list[np.ndarray], counts: list[np.ndarray], grades: int = 3) -> np.ndarray:
    """Ordered grades of the sample.

    Labels with more than two values are grades already. Of 0/1 labels the positives are split into
    ``grades`` levels by the share of their words whose smoothed log-odds mark the positive class.
    """
    if len(np.unique(y)) > 2:
        return np.searchsorted(np.unique(y), y)
    bad = np.zeros(FEATURES)
    good = np.zeros(FEATURES)
    for f, label in zip(features, y):
        (bad if label else good)[f] += 1
    n_bad, n_good = max(1, int(y.sum())), max(1, int((y == 0).sum()))
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    marked = (odds > np.log(8)) & (bad >= max(3, 0.02 * n_bad))
    share = np.array([c[marked[f]].sum() / max(1, c.sum()) for f, c in zip(features, counts)])
    out = np.zeros(len(y), dtype=np.int64)
    positive = np.flatnonzero(y > 0)
    if len(positive):
        cuts = np.quantile(share[positive], np.arange(1, grades) / grades)
        out[positive] = 1 + np.searchsorted(cuts, share[positive], side="left")
    return out


def _slices(at: np.ndarray, of: np.ndarray, size: int, together: int = 1 << 17) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted places ``at`` below ``size`` with their ``of``, cut between places: how many places, which, and of what."""
    cuts = np.searchsorted(at, np.unique(np.append(at[::together], [0, size])))
    places = [0, *at[cuts[1:-1]].tolist(), size]
    return [(hi - lo, at[i:j] - np.int32(lo), of[i:j]) for lo, hi, i, j in zip(places, places[1:], cuts, cuts[1:])]


def _summed(slices: list[tuple[int, np.ndarray, np.ndarray]], values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by place; only a slice of them is copied at a time."""
    return np.concatenate([np.bincount(at, weights=values[of], minlength=n) for n, at, of in slices])


def fit_cumulative_link(
    features: list[np.ndarray], y: np.ndarray, steps: int = 400, l1: float = 0.09, min_docs: int = 3, max_share: float = 0.2,
    stands_for: np.ndarray | None = None,
) -> OrdinalModel:
    """Penalised maximum likelihood of the cumulative-link model by accelerated proximal gradient steps.

    Features are presences. ``l1``, over the root of the sample's size, keeps the weights sparse; a feature of fewer than ``min_docs``
    documents, or of more than ``max_share`` of them, is left out. ``stands_for`` weights the rows in
    the likelihood and in shares, one each if unset; the size is then that of equally many equal rows.
    """
    top = int(y.max()) if len(y) else 0
    if top == 0:
        return OrdinalModel({}, ())
    weight = np.ones(len(y)) if stands_for is None else stands_for / stands_for.mean()
    seen, weighted = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES)
    for f, w in zip(features, weight):  # those of a row are distinct
        seen[f] += 1
        weighted[f] += w
    names = np.flatnonzero((seen >= min_docs) & (weighted <= max(min_docs, max_share * len(y)) + 1e-9))
    place = np.full(FEATURES, -1, dtype=np.int32)
    place[names] = np.arange(len(names))
    kept = [(p := place[f])[p >= 0] for f in features]
    rows = np.repeat(np.arange(len(y), dtype=np.int32), [len(p) for p in kept])
    cols = np.concatenate(kept)
    del kept
    by_feature = np.argsort(cols, kind="stable")
    by_row, by_feature = _slices(rows, cols, len(y)), _slices(cols[by_feature], rows[by_feature], len(names))
    weight = weight / len(y)
    n, size = len(y), len(names)
    l1 = l1 * math.sqrt(np.sum(weight**2))

    def times(w: np.ndarray) -> np.ndarray:
        return _summed(by_row, w)

    def back(r: np.ndarray) -> np.ndarray:
        return _summed(by_feature, r)

    def cuts_of(theta: np.ndarray) -> np.ndarray:
        """Gaps keep the thresholds ordered: each is the one before plus exp(gap)."""
        return theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])

    def gradient(x: np.ndarray) -> np.ndarray:
        theta = x[size:]
        p = 1 / (1 + np.exp(-np.clip(times(x[:size])[:, None] - cuts_of(theta)[None, :], -30, 30)))
        edge, none = np.ones((n, 1)), np.zeros((n, 1))
        at = np.arange(n), y
        mass = np.maximum(np.hstack([edge, p])[at] - np.hstack([p, none])[at], 1e-9)
        slope = p * (1 - p)
        dz = -weight * (np.hstack([none, slope])[at] - np.hstack([slope, none])[at]) / mass
        # A cut bounds its grade from below and the grade under it from above.
        dcut = np.array([np.sum(weight * slope[:, k] * ((y == k + 1).astype(float) - (y == k)) / mass) for k in range(top)])
        tail = np.cumsum(dcut[::-1])[::-1]
        return np.concatenate([back(dz), tail[:1], tail[1:] * np.exp(theta[1:])])

    v = np.ones(size)
    for _ in range(20):
        v = back(weight * times(v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.3 * (v @ back(weight * times(v)) if size else 0.0) + 0.5)
    x = np.concatenate([np.zeros(size), [1.0], np.full(top - 1, -1.0)])
    ahead, pace = x, 1.0
    for _ in range(steps):
        new = ahead - step * gradient(ahead)
        new[:size] = np.sign(new[:size]) * np.maximum(np.abs(new[:size]) - step * l1, 0)
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, x, pace = new + (pace - 1) / after * (new - x), new, after
    w, cuts = x[:size], cuts_of(x[size:])
    return OrdinalModel({int(n): float(x) for n, x in zip(names, w) if x}, tuple(float(c) for c in cuts))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, grades: int = 3) -> OrdinalModel:
    """Fit on a sample of at most ``per_class`` labelled documents per label value, weighted by all labels.

    Rows with a null label or id are not used. Without positives the model has no thresholds and
    gives every document severity zero.
    """
    y, features, counts, stands_for = _training_rows(docs, labels, label, per_class)
    if not len(y):
        return OrdinalModel({}, ())
    grade = severity_grades(y, features, counts, grades)
    del counts
    model = fit_cumulative_link(features, grade, stands_for=stands_for)
    # Else Arrow keeps the memory of the sample, and the driver is that much larger from here on.
    del features
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, expected_severity, grade, p_toxic, toxic`` of every row.

    ``expected_severity`` is the sum of P(severity > k), ``grade`` the most probable grade,
    ``p_toxic`` P(severity > 0), and ``toxic`` says whether that is at least ``CUT``. Whole texts
    are read; a null or empty text has no features. Repeated rows and null ids keep their rows.
    """
    cuts = np.array(model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = Scorer(model)
        for batch in batches:
            z = np.array([value(t.as_py() or "") for t in batch.column(1)])
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -30, 30)))
            mass = np.hstack([np.ones((len(z), 1)), p]) - np.hstack([p, np.zeros((len(z), 1))])
            first = p[:, 0] if len(cuts) else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.round(p.sum(axis=1), 6)), pa.array(mass.argmax(axis=1).astype(np.int32)),
                 pa.array(np.round(first, 6)), pa.array(first >= CUT)],
                names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` without the rows whose text the model calls toxic; all columns stay as they are."""
    cut = model.thresholds[0] + math.log(CUT / (1 - CUT)) if model.thresholds else float("inf")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = Scorer(model)
        for batch in batches:
            keep = [value(t.as_py() or "") < cut for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
