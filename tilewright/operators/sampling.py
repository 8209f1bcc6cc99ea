"""Percentiles, ranked picks and seeded samples of tiles.

Samples are drawn in the order of an md5 of seed and key: repeatable on any cluster, without
replacement, and cut to the sample size on every partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.operators.ordering import average_rank, join_null_safe, running_totals, top_rows


def seeded_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def percentiles(scored: DataFrame, score: str = "score", keys: list[str] | None = None, name: str = "percentile") -> DataFrame:
    """Average rank over the scored rows of the group, times 100; null where the score is null."""
    ranked = average_rank(scored, keys or ["slide_id"], score)
    return ranked.withColumn(name, F.col("avg_rank") / F.col("n_rows") * 100).drop("avg_rank", "n_rows")


def quantiles(scored: DataFrame, score: str, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, from counts per distinct value."""
    counts = scored.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("__ties"))
    upto = running_totals(counts, keys, [F.col(score)], {"__upto": F.col("__ties")})
    sizes = upto.groupBy(*keys).agg(F.max("__upto").alias("__n"))
    placed = join_null_safe(upto, sizes, keys)
    first, last = F.col("__upto") - F.col("__ties"), F.col("__upto") - 1

    def at(index: Column) -> Column:
        return F.max(F.when(index.between(first, last), F.col(score)))

    ends = []
    for name, q in probs.items():
        position = (F.col("__n") - 1) * q
        ends += [
            at(F.floor(position)).alias(f"{name}_lo"), at(F.ceil(position)).alias(f"{name}_hi"),
            F.first(position - F.floor(position)).alias(f"{name}_w"),
        ]
    grouped = placed.groupBy(*keys).agg(*ends)
    return grouped.select(*keys, *[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_w")).alias(n) for n in probs])


def top_k(scored: DataFrame, k: int, score: str = "score", invert: bool = False, keys: list[str] | None = None, ties: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """The ``k`` highest (or, inverted, lowest) scores per group."""
    first = F.col(score).asc() if invert else F.col(score).desc()
    return top_rows(scored, keys or ["slide_id"], [first, *[F.col(t) for t in ties]], k)


def window_sample(
    scored: DataFrame, k: int, start: float = 0.48, end: float = 0.52, score: str = "score",
    as_quantiles: bool = False, seed: int = 1, keys: list[str] | None = None, ident: str = "tile_id",
) -> DataFrame:
    """At most ``k`` rows per group with a score in ``[start, end]``; groups without one drop out."""
    keys = keys or ["slide_id"]
    if as_quantiles:
        limits = quantiles(scored, score, keys, {"__lo": start, "__hi": end})
        inside = join_null_safe(scored, limits, keys).filter(F.col(score).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    else:
        inside = scored.filter(F.col(score).between(start, end))
    return top_rows(inside, keys, [seeded_order(seed, *keys, ident), F.col(ident)], k)


def screen_coords(tiles: DataFrame, top_left: tuple[int, int], bottom_right: tuple[int, int], x: str = "x_min", y: str = "y_min") -> DataFrame:
    """Corners inside the box, edges included."""
    return tiles.filter(F.col(x).between(top_left[0], bottom_right[0]) & F.col(y).between(top_left[1], bottom_right[1]))


def sample_rois(
    scored: DataFrame, k: int = 5, mode: str = "range_sample", score: str = "score", seed: int = 1,
    score_start: float = 0.45, score_end: float = 0.55,
    top_left: tuple[int, int] | None = None, bottom_right: tuple[int, int] | None = None,
) -> DataFrame:
    """Percentiles over the whole slide, then the screen, then the pick."""
    ranked = percentiles(scored, score)
    if top_left is not None and bottom_right is not None:
        ranked = screen_coords(ranked, top_left, bottom_right)
    if mode == "range_sample":
        return window_sample(ranked, k, score_start, score_end, "percentile", seed=seed)
    if mode in ("topk", "reverse_topk"):
        return top_k(ranked, k, "percentile", invert=mode == "reverse_topk")
    raise NotImplementedError(mode)


def sample_patches(tiles: DataFrame, n: int = 100, seed: int = 1, keys: list[str] | None = None, ident: tuple[str, ...] = ("x_min", "y_min", "tile_id")) -> DataFrame:
    """At most ``n`` random tiles per slide."""
    keys = keys or ["slide_id"]
    return top_rows(tiles, keys, [seeded_order(seed, *keys, *ident), *[F.col(i) for i in ident]], n)
