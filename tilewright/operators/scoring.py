"""User models: batch scoring and feature extraction.

A factory, not a model, is shipped to the executors; it runs once per task, so the weights are
loaded once per task and never travel with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tilewright.functions import vectors

Model = Callable[[np.ndarray], np.ndarray]


def score_tiles(
    tiles: DataFrame, factory: Callable[[], Model], classes: list[str], feature: str = "features"
) -> DataFrame:
    """Logits of any model per Arrow batch, then a softmax; one probability column per class."""
    keep = [f for f in tiles.schema.fields if f.name != feature]
    schema = T.StructType(keep + [T.StructField(c, T.DoubleType()) for c in classes])
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            if batch.empty:
                continue
            logits = np.asarray(model(np.stack(batch[feature].to_numpy()).astype(np.float64)), dtype=np.float64)
            powers = np.exp(logits - logits.max(axis=1, keepdims=True))
            probs = powers / powers.sum(axis=1, keepdims=True)
            yield pd.concat(
                [batch[names].reset_index(drop=True), pd.DataFrame(probs, columns=classes)], axis=1)

    return tiles.mapInPandas(run, schema)


def linear_scores(
    tiles: DataFrame, weights: list[list[float]], classes: list[str], feature: str = "features"
) -> DataFrame:
    """The built-in scorer: a dense layer and a softmax as plain columns."""
    rest = [c for c in tiles.columns if c != feature]
    probs = vectors.softmax(vectors.linear_head(F.col(feature), weights))
    scored = tiles.select(*rest, probs.alias("__p"))
    return scored.select(*rest, *[F.get("__p", F.lit(i)).alias(c) for i, c in enumerate(classes)])


def extract_features(
    tiles: DataFrame, factory: Callable[[], Model], payload: str = "features", done: DataFrame | None = None,
    key: str = "tile_id", label: str = "label",
) -> DataFrame:
    """``key, label, features`` for tiles without a stored vector."""
    todo = tiles if done is None else tiles.join(done.select(key), key, "left_anti")
    schema = T.StructType([
        tiles.schema[key], tiles.schema[label], T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            if batch.empty:
                continue
            out = np.asarray(model(np.stack(batch[payload].to_numpy()).astype(np.float64)), dtype=np.float32)
            yield pd.DataFrame({key: batch[key], label: batch[label], "features": list(out)})

    return todo.select(key, label, payload).mapInPandas(run, schema)
