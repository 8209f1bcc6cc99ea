"""Stain settings, class sets and default parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Classes in model output order, score cut-off, low and high count cut-offs,
# label codes and channel statistics of each stain.
STAINS = {
    "he": {
        "classes": [
            "artifact", "atypia", "background", "gastric_cardia", "immune_cells",
            "intestinal_metaplasia", "respiratory_mucosa", "squamous_mucosa",
        ],
        "ranked_class": "atypia",
        "threshold": 0.99993,
        "lcp": 0,
        "hcp": 10,
        "label_map": {"Y": 1, "N": 0},
    },
    "qc": {
        "classes": [
            "Background", "Gastric-type columnar epithelium", "Intestinal Metaplasia",
            "Respiratory-type columnar epithelium",
        ],
        "ranked_class": "Gastric-type columnar epithelium",
        "threshold": 0.99,
        "lcp": 0,
        "hcp": 95,
        "label_map": {
            "Adequate for pathological review": 1,
            "Scant columnar cells": 1,
            "Squamous cells only": 0,
            "Insufficient cellular material": 0,
            "Food material": 0,
        },
    },
    "p53": {
        "classes": [
            "aberrant_positive_columnar", "artifact", "background", "immune_cells",
            "squamous_mucosa", "wild_type_columnar",
        ],
        "ranked_class": "aberrant_positive_columnar",
        "threshold": 0.99,
        "lcp": 0,
        "hcp": 2,
        "label_map": {"Y": 1, "N": 0},
    },
    "tff3": {
        "classes": ["Equivocal", "Negative", "Positive"],
        "ranked_class": "Positive",
        "threshold": 0.93,
        "lcp": 3,
        "hcp": 40,
        "label_map": {"Y": 1, "N": 0},
    },
}
# Channel means and standard deviations.
TISSUE_STATS = (
    [0.7747305964175918, 0.7421753839460998, 0.7307385516144509],
    [0.2105364799974944, 0.2123423033814637, 0.20617556948731974],
)
PHOTO_STATS = ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
CHANNEL_STATS = {"he": TISSUE_STATS, "p53": TISSUE_STATS, "tff3": PHOTO_STATS, "qc": PHOTO_STATS}

# Display names by class index.
DISPLAY_NAMES = {
    "he": [
        "Artifact", "Atypia", "Background", "Gastric cardia", "Immune cells",
        "Intestinal metaplasia", "Respiratory mucosa", "Squamous mucosa",
    ],
    "p53": [
        "Aberrant P53 columnar epithelium", "Artifact", "Background", "Immune cells",
        "Squamous mucosa", "Wild type columnar epithelium",
    ],
}
# Label codes of the slide-level sweep.
P53_LABELS = {"N": 0, "EQV": 0, "WT": 1, "Y": 1}
ATYPIA_LABELS = {"N": 0, "To Clarify": 0, "Y": 1}

# Parameter defaults of a new slide list.
SLIDE_DEFAULTS = {
    "seg_level": -1,
    "based_on": "hed",
    "contrast": 1,
    "keep_ids": "none",
    "exclude_ids": "none",
    "min_pixel_count": 25.0,
    "a_t": 20.0,
    "a_h": 16.0,
    "max_n_holes": 2,
    "max_dist": 250,
    "vis_level": -1,
    "line_thickness": 250,
    "use_padding": True,
    "contour_fn": "four_pt",
}
SLIDE_TYPES = {
    "seg_level": "int", "based_on": "string", "contrast": "int", "keep_ids": "string",
    "exclude_ids": "string", "min_pixel_count": "float", "a_t": "float", "a_h": "float",
    "max_n_holes": "bigint", "max_dist": "bigint", "vis_level": "int",
    "line_thickness": "bigint", "use_padding": "boolean", "contour_fn": "string",
}

STAIN_SCHEMA = T.StructType([
    T.StructField("stain", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("ranked_class", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("lcp", T.IntegerType()),
    T.StructField("hcp", T.IntegerType()),
    T.StructField("label_map", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("channel_means", T.ArrayType(T.DoubleType())),
    T.StructField("channel_stds", T.ArrayType(T.DoubleType())),
])


def stain_table(spark: SparkSession) -> DataFrame:
    """Four rows, one per stain: always safe to broadcast."""
    rows = [
        (name, s["classes"], s["ranked_class"], s["threshold"], s["lcp"], s["hcp"],
         s["label_map"], CHANNEL_STATS[name][0], CHANNEL_STATS[name][1])
        for name, s in STAINS.items()
    ]
    return spark.createDataFrame(rows, STAIN_SCHEMA)


def settings(stain: str) -> dict:
    if stain not in STAINS:
        raise ValueError(f"stain must be one of {sorted(STAINS)}, not {stain!r}")
    return STAINS[stain]


def with_stain_config(
    df: DataFrame,
    ranked_class: Column | None = None,
    lcp: Column | None = None,
    hcp: Column | None = None,
    stain_col: str = "stain",
) -> DataFrame:
    """Attach the stain settings; the three optional columns override them row by row.

    A stain outside the table raises when the row is evaluated. The class ranked for ``tff3``
    cannot be overridden.
    """
    table = stain_table(df.sparkSession).withColumnRenamed("stain", "__stain")
    joined = df.join(F.broadcast(table), F.col(stain_col) == F.col("__stain"), "left")
    known = F.when(
        F.col("__stain").isNull(),
        F.raise_error(F.concat(F.lit("unknown stain: "), F.coalesce(F.col(stain_col), F.lit("null")))).cast("string"),
    )
    pick = F.col("ranked_class")
    if ranked_class is not None:
        pick = F.when(F.col("__stain") == "tff3", pick).otherwise(F.coalesce(ranked_class, pick))
    return joined.withColumns({
        "ranked_class": F.coalesce(known, pick),
        "lcp": F.coalesce(lcp.cast("int"), F.col("lcp")) if lcp is not None else F.col("lcp"),
        "hcp": F.coalesce(hcp.cast("int"), F.col("hcp")) if hcp is not None else F.col("hcp"),
    }).drop("__stain")


def class_set(
    stain: Column,
    merge_atypia: Column,
    merge_dysplasia: Column,
    merge_respiratory: Column,
    merge_gastric: Column,
    merge_p53: Column,
) -> Column:
    """Sorted class names chosen by the merge flags (all boolean columns)."""

    def names(*values: str) -> Column:
        return F.array(*[F.lit(v) for v in values])

    none = F.array().cast("array<string>")

    def given(flag: Column, *values: str) -> Column:
        return F.when(flag, names(*values)).otherwise(none)

    shared = names("artifact", "background", "immune_cells", "squamous_mucosa")
    dysplasia_kept = F.concat(
        names("atypia_of_uncertain_significance", "dysplasia", "other"),
        given(~merge_respiratory, "respiratory_mucosa_cilia"),
        given(~merge_gastric, "tickled_up_columnar"),
    )
    dysplasia_merged = F.concat(
        names("other"),
        given(~merge_respiratory, "respiratory_mucosa_cilia"),
        given(~merge_gastric, "tickled_up_columnar"),
        given(~(merge_respiratory & merge_gastric), "atypia"),
    )
    he = F.concat(
        names("gastric_cardia", "intestinal_metaplasia", "respiratory_mucosa"),
        F.when(merge_atypia, names("atypia"))
        .when(merge_dysplasia, dysplasia_merged)
        .otherwise(dysplasia_kept),
    )
    p53 = F.concat(
        names("aberrant_positive_columnar", "wild_type_columnar"),
        given(~merge_p53, "equivocal_columnar", "nonspecific_background", "oral_bacteria", "respiratory_mucosa"),
    )
    return F.array_sort(F.concat(shared, F.when(stain == "he", he).otherwise(p53)))
