"""Document quality by hierarchical empirical Bayes.

A logistic model over the form of a text gives each document's evidence. Hosts and paths within hosts
get posteriors by grouped aggregation: the mean of a sparse path shrinks towards its host and that of
a sparse host towards the global mean, with strengths estimated from the spread between groups. A
document's quality combines its evidence with the posterior of its site, itself left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tilewright.session import materialise

_SYMBOLS = set("%#*&$|<>{}[]\\^~=_")


@dataclass(frozen=True)
class FormModel:
    """Standardised logistic model; ``base`` is the log-odds of all labels it was fitted for."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    base: float


def form(text: str) -> list[float]:
    """Features of a text's form: sizes, repetition, symbols and case."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), max(1, len(text))
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        math.log1p(n), len(text) / max(1, n), math.log1p(n / max(1, len(lines))), len(counts) / max(1, n) ** 0.7,
        top / max(1, n), repeats / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), letters / chars,
        upper / max(1, letters), sum(map(_SYMBOLS.__contains__, text)) / chars, text.count("!") / max(1, n),
        text.count("|") / max(1, n), sum(map(str.isdigit, text)) / chars, float(n < 8)]


FORM_SIZE = len(form(""))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000) -> FormModel:
    """Fit on at most ``per_class`` labelled documents per label value, chosen by a hash of the id.

    A row's weight is the number of labelled documents it stands for, so labels keep their shares.
    Rows with a null label or id are not used; without both label values the model gives no evidence.
    """
    graded = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    totals = {r.y: r.n for r in graded.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = graded.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([form(t.as_py() or "") for t in batch.column(2)], pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"])

    # Two numbers for at most 2 x per_class rows.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    y = np.array([r.y for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return FormModel((0.0,) * FORM_SIZE, (1.0,) * FORM_SIZE, (0.0,) * (FORM_SIZE + 1), 0.0)
    x = np.array([r.x for r in rows])
    stands_for = np.array([totals[r.y] / min(per_class, totals[r.y]) for r in rows])
    stands_for /= stands_for.mean()
    share = float(np.average(y, weights=stands_for))
    mean = np.average(x, axis=0, weights=stands_for)
    scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=stands_for)), 1e-6)
    design = np.hstack([np.clip((x - mean) / scale, -5, 5), np.ones((len(y), 1))])
    w = np.zeros(design.shape[1])
    penalty = np.append(np.ones(FORM_SIZE), 0.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (stands_for * (y - p)) - penalty * w
        hess = (design * (stands_for * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return FormModel(tuple(mean), tuple(scale), tuple(w), float(np.log(share / (1 - share))))


def evidence(docs: DataFrame, model: FormModel, host: Column, path: Column) -> DataFrame:
    """``doc_id, host, path, evidence`` per row: how many times likelier (log) the form is in good documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        for batch in batches:
            x = np.array([form(t.as_py() or "") for t in batch.column(3)]).reshape(-1, FORM_SIZE)
            z = np.clip((x - mean) / scale, -5, 5) @ w[:-1] + w[-1] - model.base
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.round(np.clip(z, -12, 12), 6))], names=["doc_id", "host", "path", "evidence"])

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _strength(groups: DataFrame, parent_mean: Column) -> float:
    """Pseudo-documents that a parent's mean is worth, by moments of the spread between groups."""
    gap = F.col("s") / F.col("n") - parent_mean
    within = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    r = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("s").alias("s"), F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum(within).alias("within"), F.count(F.lit(1)).alias("groups")).first()
    if not r.n or r.groups < 2 or r.n <= r.groups:
        return 10.0
    noise = r.within / (r.n - r.groups)
    spread = (r.between - (r.groups - 1) * noise) / max(r.n - r.nn / r.n, 1e-9)
    mean = r.s / r.n
    return float(min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1.0), 10_000.0))


def classify(docs: DataFrame, model: FormModel, host: Column, path: Column, cut: float = 0.5) -> DataFrame:
    """``doc_id, quality, keep, p_form, p_host, p_path`` of every row of ``docs``.

    ``p_form`` uses the document alone with the global mean, ``p_host`` and ``p_path`` are the site's
    shrunk means without the document, ``quality`` combines evidence and ``p_path``, and ``keep`` says
    whether it reaches ``cut``. A null host or path counts as an empty one, a null text as empty;
    repeated rows and null ids keep their rows. The evidence is stored once in the shared folder.
    """
    logit = lambda p: F.log(p / (1 - p))
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    known = materialise(evidence(docs, model, host, path), "evidence")
    soft = sigmoid(F.col("evidence") + F.lit(model.base))
    paths = materialise(known.withColumn("r", soft).groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n, 1e-4), 1 - 1e-4) if total.n else 0.5
    k_host = _strength(hosts, F.lit(mean))
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    k_path = _strength(sites, (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host))
    own = F.col("r")
    joined = known.withColumn("r", soft).join(sites.drop("ss"), ["host", "path"])
    p_host = (F.col("host_s") - own + k_host * mean) / (F.col("host_n") - 1 + k_host)
    p_path = (F.col("s") - own + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path)
    bounded = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    out = joined.withColumn("p_host", bounded(p_host)).withColumn("p_path", bounded(p_path))
    out = out.withColumn("quality", F.round(sigmoid(F.col("evidence") + logit(F.col("p_path"))), 6))
    return out.select(
        "doc_id", "quality", (F.col("quality") >= cut).alias("keep"), F.round(sigmoid(F.col("evidence") + math.log(mean / (1 - mean))), 6).alias("p_form"),
        F.round("p_host", 6).alias("p_host"), F.round("p_path", 6).alias("p_path"))
