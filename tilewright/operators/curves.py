"""ROC and precision-recall curves of a score against a binary label.

Rows are first reduced to one row per distinct score; the cumulative counts then come from the
range-partitioned prefix sums, so neither a long curve nor a heavily repeated score gathers in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.operators.ordering import running_totals


def _group_totals(run: DataFrame, keys: list[str]) -> DataFrame:
    """The last running sums of each group."""
    return run.groupBy(*keys).agg(F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"))


def _attach(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Join totals by key; without keys there is exactly one row, attached as a scalar."""
    if keys:
        return df.join(totals, keys)
    whole = totals.select(F.struct(*totals.columns).alias("s")).scalar()
    return df.withColumn("__t", whole).select(*df.columns, *[F.col(f"__t.{c}").alias(c) for c in totals.columns])


def curve_points(scored: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Per distinct score, highest first: ``pos, neg, tp, fp, n_pos, n_neg``."""
    keys = keys or []
    points = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return running_points(points, score, keys)


def running_points(points: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """``curve_points`` from counts ``keys, score, pos, neg`` with one row per distinct score."""
    run = running_totals(points, keys, [F.col(score).desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    return _attach(run, _group_totals(run, keys), keys)


def _safe(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def roc_curve(scored: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """One (fpr, tpr) point per distinct score; collinear points are kept."""
    pts = curve_points(scored, score, label, keys)
    return pts.select(
        *(keys or []), score, _safe(F.col("fp"), F.col("n_neg")).alias("fpr"), _safe(F.col("tp"), F.col("n_pos")).alias("tpr")
    )


def pr_curve(scored: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    pts = curve_points(scored, score, label, keys)
    tp, fp = F.col("tp"), F.col("fp")
    return pts.select(
        *(keys or []), score, _safe(tp, tp + fp).alias("precision"), _safe(tp, F.col("n_pos")).alias("recall")
    )


def roc_auc(scored: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Area with ties counted one half; null where only one class is present."""
    return area_under(curve_points(scored, score, label, keys), keys or [])


def area_under(pts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, auc`` of curve points."""
    # A negative is beaten by every positive above it, and half of those at its own score.
    wins = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return pts.groupBy(*keys).agg(
        F.sum(wins).alias("wins"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg")
    ).select(*keys, _safe(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def average_precision(scored: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Sum of recall steps times precision; a step's height is its own share of the positives."""
    keys = keys or []
    pts = curve_points(scored, score, label, keys)
    step = _safe(F.col("pos"), F.col("n_pos")) * _safe(F.col("tp"), F.col("tp") + F.col("fp"))
    return pts.groupBy(*keys).agg(F.sum(step).alias("average_precision"))
