"""Model evaluation tables: class-wise areas, accuracies, losses and early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.functions import vectors
from tilewright.operators import curves


def per_class(predictions: DataFrame, probs: str = "p", label: str = "label") -> DataFrame:
    """One row per prediction and class: ``class_idx, prob, hit``."""
    return predictions.select(
        F.col(label).alias("__label"), F.posexplode(probs).alias("class_idx", "prob")
    ).select("class_idx", "prob", F.when(F.col("__label") == F.col("class_idx"), 1).otherwise(0).alias("hit"))


def one_vs_rest_auc(predictions: DataFrame, probs: str = "p", label: str = "label") -> DataFrame:
    """AUC per class; null for a class without examples."""
    return curves.roc_auc(per_class(predictions, probs, label), "prob", "hit", ["class_idx"])


def macro_auc(predictions: DataFrame, probs: str = "p", label: str = "label") -> DataFrame:
    """Mean over the classes that are present."""
    return one_vs_rest_auc(predictions, probs, label).agg(F.avg("auc").alias("auc"))


def micro_auc(predictions: DataFrame, probs: str = "p", label: str = "label") -> DataFrame:
    """One curve over every (prediction, class) pair of a row."""
    return curves.roc_auc(per_class(predictions, probs, label), "prob", "hit")


def guarded_auc(scored: DataFrame, score: str, label: str, keys: list[str], guard: float | None = -1.0) -> DataFrame:
    """Binary AUC that is ``guard`` where only one label occurs."""
    auc = curves.roc_auc(scored, score, label, keys)
    return auc if guard is None else auc.withColumn("auc", F.coalesce(F.col("auc"), F.lit(guard)))


def evaluation_counts(predictions: DataFrame, probs: str = "p", y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """What every table of an evaluation is read off, in one scan: ``y, y_hat, class_idx, prob, pos, neg``.

    Rows with a ``class_idx`` count the predictions that give a class a probability, by whether it is the true
    one; the others count pairs of true and predicted class in ``pos``.
    """
    def part(y_: Column, y_hat_: Column, class_: Column, prob: Column, hit: Column) -> Column:
        return F.struct(
            y_.cast("int").alias("y"), y_hat_.cast("int").alias("y_hat"), class_.cast("int").alias("class_idx"),
            prob.cast("double").alias("prob"), hit.cast("int").alias("hit"))

    none = F.lit(None)
    one = F.array(part(F.col(y), F.col(y_hat), none, none, F.lit(1)))
    each = F.transform(probs, lambda p, i: part(none, none, i, p, F.coalesce(F.col(y) == i, F.lit(False))))
    parts = predictions.select(F.inline(F.concat(one, F.coalesce(each, F.filter(one, lambda _: F.lit(False))))))
    return parts.groupBy("y", "y_hat", "class_idx", "prob").agg(
        F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))


def evaluation_tables(counts: DataFrame, n_classes: int) -> dict[str, DataFrame]:
    """AUC per class, their mean, the AUC over all classes, accuracy per class and the error rate."""
    scores = counts.filter(F.col("class_idx").isNotNull() & F.col("prob").isNotNull())
    per_class = curves.area_under(curves.running_points(scores.select("class_idx", "prob", "pos", "neg"), "prob", ["class_idx"]), ["class_idx"])
    pooled = scores.groupBy("prob").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pairs = counts.filter(F.col("class_idx").isNull())
    right = F.sum(F.when(F.col("y") == F.col("y_hat"), F.col("pos")).otherwise(0))
    classes = pairs.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("y"))
    accuracy = classes.join(pairs.groupBy("y").agg(F.sum("pos").alias("count"), right.alias("correct")), "y", "left").fillna(0, ["count", "correct"])
    return {
        "class_auc": per_class,
        "macro_auc": per_class.agg(F.avg("auc").alias("auc")),
        "micro_auc": curves.area_under(curves.running_points(pooled, "prob", []), []),
        "class_accuracy": accuracy.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("count").cast("double"))),
        "error": pairs.agg((1 - F.try_divide(right.cast("double"), F.sum("pos").cast("double"))).alias("error")),
    }


def class_accuracy(predictions: DataFrame, n_classes: int, y: str = "y", y_hat: str = "y_hat", keys: list[str] | None = None) -> DataFrame:
    """Count, correct and ratio per true class; a class without examples has a null ratio."""
    keys = keys or []
    counted = predictions.groupBy(*keys, y).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col(y) == F.col(y_hat)).alias("correct"))
    classes = F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias(y)
    if keys:
        spine = counted.select(*keys).distinct().select(*keys, classes)
    else:
        spine = predictions.sparkSession.range(1).select(classes)
    full = spine.join(counted, [*keys, y], "left").fillna(0, ["count", "correct"])
    return full.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("count").cast("double")))


def epoch_means(log: DataFrame, keys: tuple[str, ...] = ("split", "epoch")) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.avg("loss").alias("loss"), F.avg("instance_loss").alias("instance_loss"),
        F.avg(F.when(F.col("y") == F.col("y_hat"), 0.0).otherwise(1.0)).alias("error"))


def weighted_loss(loss: Column, instance_loss: Column, bag_weight: float) -> Column:
    return loss * bag_weight + instance_loss * (1 - bag_weight)


def early_stopping(
    losses: DataFrame, patience: int = 20, stop_epoch: int = 50, keys: tuple[str, ...] = ("fold",), loss: str = "loss"
) -> DataFrame:
    """``stopped_at`` (null if never) and the epoch of the last saved checkpoint, per fold.

    A loss at or below the best so far saves a checkpoint and resets the counter; any other epoch
    adds one. A fold has one row per epoch, so windows over a fold stay small.
    """
    by_epoch = W.partitionBy(*keys).orderBy("epoch")
    best = F.min(loss).over(by_epoch.rowsBetween(W.unboundedPreceding, -1))
    saved = losses.withColumn("saved", best.isNull() | (F.col(loss) <= best))
    grouped = saved.withColumn("run", F.sum(F.col("saved").cast("int")).over(by_epoch))
    counted = grouped.withColumn(
        "counter", F.row_number().over(W.partitionBy(*keys, "run").orderBy("epoch")) - 1)
    stop = counted.groupBy(*keys).agg(
        F.min(F.when((F.col("counter") >= patience) & (F.col("epoch") > stop_epoch), F.col("epoch"))).alias("stopped_at"))
    joined = counted.join(stop, list(keys))
    seen = F.col("stopped_at").isNull() | (F.col("epoch") <= F.col("stopped_at"))
    return joined.groupBy(*keys).agg(
        F.first("stopped_at").alias("stopped_at"),
        F.max(F.when(seen & F.col("saved"), F.col("epoch"))).alias("checkpoint_epoch"),
        F.min(F.when(seen & F.col("saved"), F.col(loss))).alias("best_loss"))


def prediction_table(predictions: DataFrame, n_classes: int, probs: str = "p", label: str = "label", slide: str = "slide_id") -> DataFrame:
    """``slide, Y, Y_hat, p_0 .. p_k``."""
    p = F.col(probs)
    return predictions.select(
        slide, F.col(label).alias("Y"), vectors.argmax(p).alias("Y_hat"),
        *[F.get(p, F.lit(k)).alias(f"p_{k}") for k in range(n_classes)])
