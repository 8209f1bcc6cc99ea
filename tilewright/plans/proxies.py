"""Stand-in domain tables derived from the star-schema test tables.

Each function has an independent SQL twin in ``proxy_sql``. All of them grow with their source
table and none uses a window, so a hot key costs nothing extra here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tilewright import config
from tilewright.session import shuffle_width

LATTICE = 40
TILE = 400
IMG_W, IMG_H = 32, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, tile_id, x_min, y_min, x_max, y_max, score`` from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    u = (
        (F.col("l_orderkey") * 48271 + F.col("l_linenumber") * 7919 + F.col("l_partkey") * 69621) % 1000003
    ).cast("double") / F.lit(1000003.0)
    one = F.lit(1.0)
    x = ((F.col("l_orderkey") % LATTICE) * TILE).cast("bigint")
    y = ((F.col("l_partkey") % LATTICE) * TILE).cast("bigint")
    return li.select(
        F.col("l_suppkey").alias("slide_id"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("tile_id"),
        x.alias("x_min"),
        y.alias("y_min"),
        (x + TILE).alias("x_max"),
        (y + TILE).alias("y_max"),
        ((one - u) * (one - F.lit(0.004) * (F.col("l_suppkey") % 5).cast("double"))).alias("score"),
    )


def tile_predictions(spark: SparkSession, sf_dir: str, stain: str = "he") -> DataFrame:
    """The wide form: one probability column per class of ``stain``."""
    setting = config.settings(stain)
    others = [c for c in setting["classes"] if c != setting["ranked_class"]]
    weight = {c: float(i + 1) for i, c in enumerate(others)}
    whole = float(sum(weight.values()))
    tiles = tile_scores(spark, sf_dir)
    rest = F.lit(1.0) - F.col("score")
    return tiles.select(
        "slide_id", "tile_id", "x_min", "y_min", "x_max", "y_max",
        *[
            (F.col("score") if c == setting["ranked_class"] else rest * weight[c] / whole).alias(c)
            for c in setting["classes"]
        ],
    )


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, slide_name, nation`` from supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("slide_id"),
        F.concat(
            F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit(" P "),
            F.col("s_nationkey").cast("string"), F.lit(".ndpi"),
        ).alias("slide_name"),
        F.col("s_nationkey").cast("bigint").alias("nation"),
    )


def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, slide_name, levels, properties``; every tenth slide has a single level."""
    s = slides(spark, sf_dir)
    sid = F.col("slide_id")
    w0 = F.lit(16000).cast("bigint") + (sid % 7) * 64
    h0 = F.lit(12000).cast("bigint") + (sid % 5) * 64
    top = F.when(sid % 10 == 9, 0).otherwise(3)
    levels = F.transform(
        F.sequence(F.lit(0), top),
        lambda l: F.struct(
            F.floor(w0 / F.pow(F.lit(4.0), l)).cast("bigint").alias("w"),
            F.floor(h0 / F.pow(F.lit(4.0), l)).cast("bigint").alias("h"),
            F.pow(F.lit(4.0), l).alias("downsample"),
        ),
    )
    properties = F.create_map(
        F.lit("openslide.mpp-x"), F.lit("0.25"),
        F.lit("openslide.mpp-y"), F.lit("0.5"),
        F.lit("hamamatsu.XOffsetFromSlideCentre"), (sid * 11 - 500).cast("string"),
        F.lit("hamamatsu.YOffsetFromSlideCentre"), (F.lit(300) - sid * 7).cast("string"),
    )
    return s.select("slide_id", "slide_name", levels.alias("levels"), properties.alias("properties"))


def _points(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[
        F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")) for x, y in pairs
    ])


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangle, concave L and triangle per slide: ``slide_id, cont_idx, points``."""
    o = (F.col("slide_id") % 100) * 16

    def at(*pairs: tuple[int, int]) -> Column:
        return _points(*[(o + x, o + y) for x, y in pairs])

    shapes = F.array(
        at((1000, 1000), (3000, 1000), (3000, 2400), (1000, 2400)),
        at((4000, 1000), (7000, 1000), (7000, 2000), (5000, 2000), (5000, 4000), (4000, 4000)),
        at((1000, 5000), (4001, 5000), (2500, 8000)),
    )
    return slides(spark, sf_dir).select(
        "slide_id", F.posexplode(shapes).alias("cont_idx", "points")
    ).withColumn("cont_idx", F.col("cont_idx").cast("bigint"))


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hole in contour 0 and three in contour 1: ``slide_id, cont_idx, hole_idx, points``."""
    o = (F.col("slide_id") % 100) * 16

    def box(x: int, y: int, w: int, h: int) -> Column:
        return _points((o + x, o + y), (o + x + w, o + y), (o + x + w, o + y + h), (o + x, o + y + h))

    def hole(cont: int, idx: int, points: Column) -> Column:
        return F.struct(
            F.lit(cont).cast("bigint").alias("cont_idx"), F.lit(idx).cast("bigint").alias("hole_idx"),
            points.alias("points"),
        )

    listed = F.array(
        hole(0, 0, box(1500, 1200, 600, 500)),
        hole(1, 0, box(4200, 1100, 300, 200)),
        hole(1, 1, box(5200, 1200, 500, 400)),
        hole(1, 2, box(4200, 3000, 50, 40)),
    )
    return slides(spark, sf_dir).select("slide_id", F.inline(listed))


def truth_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, code`` with the codes of the slide-level label map."""
    sid = F.col("slide_id")
    base = F.when(sid % 5 < 2, 1).otherwise(0)
    flipped = F.when(sid % 7 == 0, 1 - base).otherwise(base)
    code = (
        F.when(sid % 11 == 3, "EQV").when(sid % 13 == 5, "WT")
        .when(flipped == 1, "Y").otherwise("N")
    )
    return slides(spark, sf_dir).select("slide_id", code.alias("code"))


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, score, label``: document length against the quality label."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label")
    )


N_CLASSES = 10
HEAD = [[((k * 7 + j * 3) % 11 - 5) / 10.0 for j in range(64)] for k in range(N_CLASSES)]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tile_id"), "label", F.col("embedding").alias("features")
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split, epoch, batch, loss, instance_loss, y, y_hat`` from the event stream."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.when(F.col("event_id") % 4 == 0, "val").otherwise("train").alias("split"),
        F.dayofmonth("ts").cast("bigint").alias("epoch"),
        F.col("event_id").alias("batch"),
        (F.col("value") / 100.0).alias("loss"),
        ((F.col("event_id") % 100).cast("double") / 50.0).alias("instance_loss"),
        (F.col("user_id") % 3).cast("bigint").alias("y"),
        ((F.col("user_id") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)) % 3).cast("bigint").alias("y_hat"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 32 x 24 image per slide: ``slide_id, row, col, r, g, b``."""
    grid = (
        slides(spark, sf_dir)
        .select("slide_id")
        .repartition(shuffle_width(spark), "slide_id")
        .select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(IMG_H - 1))).alias("row"))
        .select("slide_id", "row", F.explode(F.sequence(F.lit(0), F.lit(IMG_W - 1))).alias("col"))
        .select("slide_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))
    )
    sid, row, col = F.col("slide_id"), F.col("row"), F.col("col")
    h = F.col("h")
    d1 = (row - 8) * (row - 8) + (col - 8 - sid % 5) * (col - 8 - sid % 5)
    d2 = (row - 15) * (row - 15) + (col - 20 - sid % 4) * (col - 20 - sid % 4)
    small = sid % 10 == 9
    tissue = ((d1 <= F.when(small, 2).otherwise(25)) & ~(d1 <= F.when(small, -1).otherwise(2))) | (
        d2 <= F.when(small, 1).otherwise(16)
    ) | (h < 2)
    pen = (col >= 28) & (col <= 30) & (row >= 4) & (row <= 18) & (sid % 3 == 0)

    def channel(tissue_value: Column, pens: tuple[int, int, int, int], back: Column) -> Column:
        ink = F.when(sid % 4 == 0, pens[0]).when(sid % 4 == 1, pens[1]).when(sid % 4 == 2, pens[2]).otherwise(pens[3])
        return F.when(pen, ink).when(tissue, tissue_value).otherwise(back).cast("bigint")

    return grid.withColumn("h", (row * 7919 + col * 104729 + sid * 48271) % 97).select(
        "slide_id", "row", "col",
        # A generator keeps the colour formulas out of the expressions of later steps, as a
        # stored pixel table would.
        F.inline(F.array(F.struct(
            channel(150 - h % 20, (20, 30, 30, 200), 240 - h % 6).alias("r"),
            channel(80 + h % 15, (20, 40, 140, 30), 238 - h % 4).alias("g"),
            channel(140 - h % 10, (25, 180, 60, 40), 242 - h % 5).alias("b"),
        ))),
    )
