"""Per-row arithmetic on class and channel arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return array_total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``, so that it is not computed again at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    def shifted(z: Column) -> Column:
        return let(F.array_max(z), lambda peak: F.transform(z, lambda v: F.exp(v - peak)))

    def scaled(powers: Column) -> Column:
        return let(array_total(powers), lambda total: F.transform(powers, lambda p: p / total))

    return let(let(logits, shifted), scaled)


def argmax(values: Column) -> Column:
    """Zero-based index of the first maximum."""
    return let(values, lambda v: F.array_position(v, F.array_max(v)) - 1)


def one_hot(label: Column, n_classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: F.when(i == label, 1).otherwise(0)
    )


def scale_and_normalise(channels: Column, means: Column, stds: Column) -> Column:
    """Bytes to [0, 1], then (v - mean) / std per channel."""
    centred = F.zip_with(channels, means, lambda v, m: v.cast("double") / 255.0 - m)
    return F.zip_with(centred, stds, lambda v, s: v / s)


def linear_head(features: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """Logits of a dense layer; the weights are plan literals, so keep them small."""
    bias = bias or [0.0] * len(weights)
    return F.array(*[
        dot(features, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b))
        for row, b in zip(weights, bias)
    ])
