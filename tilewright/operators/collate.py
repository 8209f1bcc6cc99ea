"""Collation of the four stain results against participant lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

SAMPLE = "sample_id"

# Result column names of each stain in the collated table.
RENAMES = {
    "qc": {
        "slide_filename": "h_e_slide_filename",
        "positive_tiles": "he_numb_gastric_tile_alg",
        "algorithm_result": "h_e_qc_result_alg",
        "tile_mapping": "qc_tile_mapping",
        "algorithm_version": "qc_algorithm_version",
    },
    "he": {
        "slide_filename": "h_e_slide_filename",
        "positive_tiles": "atypia_positive_tiles",
        "algorithm_result": "atypia_algorithm_result",
        "tile_mapping": "atypia_tile_mapping",
        "algorithm_version": "atypia_algorithm_version",
    },
    "p53": {
        "slide_filename": "p53_slide_filename",
        "positive_tiles": "p53_positive_tiles",
        "algorithm_result": "p53_algorithm_result",
        "tile_mapping": "p53_tile_mapping",
        "algorithm_version": "p53_algorithm_version",
    },
    "tff3": {
        "slide_filename": "tff3_slide_filename",
        "positive_tiles": "tff3_positive_tiles",
        "algorithm_result": "tff3_algorithm_result",
        "tile_mapping": "tff3_tile_mapping",
        "algorithm_version": "tff3_algorithm_version",
    },
}
# Constant export columns.
EVENT_NAME = "unscheduled_arm_1"
INSTRUMENT = "machine_learning_pathology_results"


def rename_for_stain(results: DataFrame, stain: str) -> DataFrame:
    return results.withColumnsRenamed(RENAMES[stain])


def outer_on(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on ``key``; null keys meet each other and duplicates multiply."""
    other = right.withColumnRenamed(key, "__key")
    joined = left.join(other, F.col(key).eqNullSafe(F.col("__key")), "full_outer")
    return joined.withColumn(key, F.coalesce(F.col(key), F.col("__key"))).drop("__key")


def merge_he(qc: DataFrame, he: DataFrame, key: str = SAMPLE, fill: bool = False) -> DataFrame:
    """Join the two H&E results; columns both sides have keep the left value.

    With ``fill`` a value missing on the left is taken from the right instead of staying null.
    """
    shared = [c for c in he.columns if c in qc.columns and c != key]
    if not fill:
        return outer_on(qc, he.drop(*shared), key)
    marked = he.withColumnsRenamed({c: f"__right_{c}" for c in shared})
    joined = outer_on(qc, marked, key)
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__right_{c}")) for c in shared}).drop(
        *[f"__right_{c}" for c in shared]
    )


def collate(results: dict[str, DataFrame], key: str = SAMPLE, fill: bool = False) -> DataFrame:
    renamed = {s: rename_for_stain(df, s) for s, df in results.items()}
    first = merge_he(renamed["qc"], renamed["he"], key, fill)
    return reduce(lambda a, b: outer_on(a, b, key), [renamed["p53"], renamed["tff3"]], first)


def participant_map(listed: DataFrame, lab: str = "lab_number", participant: str = "participant_id", order: str = "file_order") -> DataFrame:
    """One row per non-null lab number; the last row in file order wins."""
    return listed.filter(F.col(lab).isNotNull()).groupBy(lab).agg(
        F.max_by(participant, order).alias(participant), F.min(order).alias("first_seen")
    )


def lookup_ids(collated: DataFrame, primary: DataFrame, repeat: DataFrame, key: str = SAMPLE) -> DataFrame:
    """``record_id`` and instance 1 from the primary list, else instance 2 from the repeat list."""
    first = participant_map(primary).select(
        F.col("lab_number").alias("__lab1"), F.col("participant_id").alias("__id1"))
    second = participant_map(repeat).select(
        F.col("lab_number").alias("__lab2"), F.col("participant_id").alias("__id2"))
    joined = collated.join(first, F.col(key) == F.col("__lab1"), "left").join(
        second, F.col(key) == F.col("__lab2"), "left"
    )
    hit1, hit2 = F.col("__lab1").isNotNull(), F.col("__lab2").isNotNull()
    return joined.withColumns({
        "record_id": F.when(hit1, F.col("__id1")).when(hit2, F.col("__id2")),
        "redcap_repeat_instance": F.when(hit1, 1).when(hit2, 2),
    }).drop("__lab1", "__lab2", "__id1", "__id2")


def unmatched(collated: DataFrame, primary: DataFrame, repeat: DataFrame, key: str = SAMPLE) -> DataFrame:
    """Collated rows whose sample is on neither list."""
    known = primary.select("lab_number").union(repeat.select("lab_number")).filter(F.col("lab_number").isNotNull())
    return collated.select(key).join(known, F.col(key) == F.col("lab_number"), "left_anti")


def export_columns(looked_up: DataFrame, key: str = SAMPLE) -> DataFrame:
    """Leading export columns first, rows by participant and instance with nulls last."""
    lead = ["record_id", "redcap_event_name", "redcap_repeat_instrument", "redcap_repeat_instance"]
    full = looked_up.withColumns({
        "redcap_event_name": F.lit(EVENT_NAME), "redcap_repeat_instrument": F.lit(INSTRUMENT)
    })
    rest = [c for c in full.columns if c not in lead]
    return full.select(*lead, *rest).orderBy(
        F.col("record_id").asc_nulls_last(), F.col("redcap_repeat_instance").asc_nulls_last()
    )


def missing_participants(primary: DataFrame, repeat: DataFrame, produced: DataFrame) -> DataFrame:
    """Expected ``id-1`` and ``id-2`` without a package, with the last lab number listed for each."""

    def expected(listed: DataFrame, suffix: str) -> DataFrame:
        return participant_map(listed).select(
            F.concat_ws("-", F.col("participant_id"), F.lit(suffix)).alias("instance"), "lab_number", "first_seen"
        )

    both = expected(primary, "1").unionByName(expected(repeat, "2"))
    one = both.groupBy("instance").agg(F.max_by("lab_number", "first_seen").alias("lab_number"))
    return one.join(produced.select("instance"), "instance", "left_anti")


def prefix_match(samples: DataFrame, files: DataFrame, sample: str = SAMPLE, file: str = "file_name") -> DataFrame:
    """The first file, by name, that starts with each sample id; samples without one drop out.

    Every file offers its own prefixes, from the shortest id length to the longest, so the join
    is an equality on the whole id.
    """
    span = samples.agg(
        F.struct(F.min(F.length(sample)).alias("lo"), F.max(F.length(sample)).alias("hi")).alias("s")
    ).scalar()
    ranged = files.withColumn("__span", span)
    lo, hi = F.col("__span.lo"), F.least(F.col("__span.hi"), F.length(file))
    lengths = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    offered = ranged.select(file, F.explode(lengths).alias("__n")).select(
        F.col(file), F.expr(f"substring({file}, 1, __n)").alias("__prefix")
    )
    hits = offered.join(samples.select(sample).distinct(), F.col("__prefix") == F.col(sample))
    return hits.groupBy(sample).agg(F.min(file).alias(file))


def label_join(scored: DataFrame, labels: DataFrame, key: str = "slide_id") -> DataFrame:
    """Only slides with both a prediction and a label stay."""
    return scored.join(labels, key)
