"""Catalogue entries: workflows from end to end, and neighbours by cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilewright import config
from tilewright.operators import embeddings, scoring
from tilewright.plans import proxies, workflows
from tilewright.plans.proxy_sql import sql
from tilewright.plans.queries_geometry import HOLE_TEST, PATCH, STEP
from tilewright.plans.queries_models import CLASS_AUC
from tilewright.plans.registry import Registry
from tilewright.sources import ledger, tables

query = Registry()


@query("w1_tile_run", sql("""
select slide_id, 'processed' as status, 2 as runs, n as tiles, sx, sy from (
  select slide_id, count(*) as n, sum(x)::bigint as sx, sum(y)::bigint as sy from (
    select *, count(*) over (partition by slide_id, cont_idx) as m from outside) where m > 1 group by slide_id)
where slide_id % 4 <> 1
union all select slide_id, 'processed', 1, n, sx, sy from (
  select slide_id, count(*) as n, sum(x)::bigint as sx, sum(y)::bigint as sy from (
    select *, count(*) over (partition by slide_id, cont_idx) as m from outside) where m > 1 group by slide_id)
where slide_id % 4 = 1""", "edges", "hole_edges", extra=HOLE_TEST))
def w1(spark: SparkSession, sf: str) -> DataFrame:
    """Three quarters of the slides are tiled first, then all; ``runs`` counts how often a slide was in a list."""
    store, book = tables.scratch_path(spark, "tiles"), tables.scratch_path(spark, "ledger")
    every = proxies.slides(spark, sf).select("slide_id")
    lists = []
    for part in (every.filter(F.col("slide_id") % 4 != 1), every):
        lists.append(workflows.tile_run(
            proxies.contours(spark, sf), proxies.pyramid(spark, sf), part, store, book, PATCH, STEP, test="center", holes=proxies.holes(spark, sf)))
    listed = lists[0].unionByName(lists[1]).groupBy("slide_id").agg(F.count(F.lit(1)).cast("int").alias("runs"))
    done = ledger.latest(spark, book, "tile").select(F.col("slide_id").cast("bigint").alias("slide_id"), "status")
    found = tables.read_coords(spark, store).groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return done.join(found, "slide_id").join(listed, "slide_id")


SCORED = {
    "p53": """select vec_id, k, exp(z - m) / sum(exp(z - m)) over (partition by vec_id) as p
from (select vec_id, k, z * 6.0::double as z, max(z * 6.0::double) over (partition by vec_id) as m from logits where k < 6)""",
    "hits": "select vec_id % 40 as slide_id, count(*) filter (where p > 0.75) as n from p53 where k = 0 group by all",
}


@query("w2_score_run", sql("""
select slide_id::varchar as sample_id, n as positive_tiles, case when n >= 2 then 3 when n > 0 then 2 else 1 end as algorithm_result, 'v1' as algorithm_version
from hits""", "logits", extra=SCORED))
def w2(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as tiles of forty slides: scored, stored and triaged in two runs, of which the second adds slides."""
    head = proxies.HEAD[:len(config.settings("p53")["classes"])]

    def factory() -> scoring.Model:
        import numpy as np

        weights = np.array(head).T * 6.0
        return lambda x: x @ weights

    store, book = tables.scratch_path(spark, "predictions"), tables.scratch_path(spark, "ledger")
    vec = F.col("tile_id")
    tiles = proxies.features(spark, sf).select(
        (vec % 40).alias("slide_id"), "tile_id", (vec % 25 * 400).alias("x"), (vec % 31 * 400).alias("y"), "features")
    slides = tiles.select("slide_id", F.concat(F.col("slide_id").cast("string"), F.lit(" P 1.ndpi")).alias("slide_name")).distinct()
    sets = slides.select("slide_id", F.lit(400).alias("patch_size"))
    out = None
    for part in (slides.filter("slide_id < 25"), slides):
        out = workflows.score_run(tiles, sets, part, factory, "p53", "v1", store, book, threshold=0.75)
    return out.select("sample_id", "positive_tiles", "algorithm_result", "algorithm_version")


@query("w3_threshold_study", sql("select t_idx, threshold, tp, fp, fn, tn, sensitivity, specificity from rated", "rated"))
def w3(spark: SparkSession, sf: str) -> DataFrame:
    sample = F.lpad(F.col("slide_id").cast("string"), 6, "0")
    tiles = proxies.tile_scores(spark, sf).select(F.concat(sample, F.lit("-scan.csv")).alias("file_name"), "score")
    truth = proxies.truth_codes(spark, sf).select(sample.alias("sample_id"), "code")
    return workflows.threshold_study(tiles, truth, "score", config.P53_LABELS)["rates"].select(
        "t_idx", "threshold", "tp", "fp", "fn", "tn", "sensitivity", "specificity")


@query("w4_evaluate_run", sql("""
select 'auc' as measure, k as class_idx, round(auc, 9) as value from cauc
union all select 'macro', -1, round(avg(auc), 9) from cauc
union all select 'accuracy', c.label, round((select count(*) from best b where b.label = c.label and b.k = c.label)::double / count(*), 9) from best c group by c.label
union all select 'error', -1, round(1 - count(*) filter (where k = label)::double / count(*), 9) from best""", "probs", extra={
    "cauc": CLASS_AUC, "best": "select vec_id, label, arg_min(k, (-p, k)) as k from probs group by all"}))
def w4(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.functions import vectors

    p = vectors.softmax(vectors.linear_head(F.col("features"), proxies.HEAD))
    scored = proxies.features(spark, sf).select("label", p.alias("p")).withColumn("y_hat", vectors.argmax(F.col("p")))
    found = workflows.evaluate_run(scored, proxies.N_CLASSES, y="label")

    def rows(measure: str, table: DataFrame, index: str | None, value: str) -> DataFrame:
        at = F.col(index) if index else F.lit(-1)
        return table.select(F.lit(measure).alias("measure"), at.cast("int").alias("class_idx"), F.round(value, 9).alias("value"))

    return (
        rows("auc", found["class_auc"], "class_idx", "auc").unionByName(rows("macro", found["macro_auc"], None, "auc"))
        .unionByName(rows("accuracy", found["class_accuracy"], "y", "accuracy")).unionByName(rows("error", found["error"], None, "error")))


@query("w5_neighbours_by_cells")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate, so without a twin: the tests hold it against the exact neighbours."""
    near = embeddings.approximate_neighbours(proxies.features(spark, sf), 5)
    return near.withColumn("similarity", F.round("similarity", 6))
