"""Catalogue entries: evaluation, sampling, heat maps, embeddings, user models, streaming."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilewright.functions import vectors
from tilewright.operators import curves, embeddings, evaluation, heatmap, sampling, scoring, triage
from tilewright.plans import proxies
from tilewright.plans.proxy_sql import sql
from tilewright.plans.registry import Registry
from tilewright.sources import tables
from tilewright.streaming import triage_stream

query = Registry()


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    logits = vectors.linear_head(F.col("features"), proxies.HEAD)
    return proxies.features(spark, sf).select(F.col("tile_id").alias("slide_id"), "label", vectors.softmax(logits).alias("p"))


CLASS_AUC = """
select k, sum(case when a.p > b.p then 1.0::double when a.p = b.p then 0.5::double else 0 end) / count(*) as auc
from (select * from probs where label = k) a join (select * from probs where label <> k) b using (k) group by k"""


@query("a22_one_vs_rest_auc", sql("""
select k as class_idx, round(auc, 9) as auc from cauc union all select -1, round(avg(auc), 9) from cauc""", "probs", extra={"cauc": CLASS_AUC}))
def a22(spark: SparkSession, sf: str) -> DataFrame:
    p = probabilities(spark, sf)
    per = evaluation.one_vs_rest_auc(p).select(F.col("class_idx"), F.round("auc", 9).alias("auc"))
    return per.unionByName(evaluation.macro_auc(p).select(F.lit(-1).alias("class_idx"), F.round("auc", 9).alias("auc")))


@query("a23_micro_auc", sql("""
select round((sum(case when hit then r end) - n_pos*(n_pos + 1)/2.0::double) / (n_pos*n_neg), 9) as auc from (
  select hit, rank() over (order by p) + (count(*) over (partition by p) - 1)/2.0::double as r, count(*) filter (where hit) over () as n_pos, count(*) filter (where not hit) over () as n_neg
  from (select p, label = k as hit from probs)) group by n_pos, n_neg""", "probs"))
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.micro_auc(probabilities(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query("a24_single_class_guard", sql("""
select source, case when min(label) = max(label) then -1.0::double else round((select sum(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0 end) / count(*)
  from s a join s b on a.source = o.source and b.source = o.source and a.label = 1 and b.label = 0), 9) end as auc
from s o group by source""", extra={"s": """
select case when quality = 1 and doc_id % 5 = 0 then 'only-good' else source end as source, quality as label, n_chars::double as score from documents join labels using (doc_id)"""}))
def a24(spark: SparkSession, sf: str) -> DataFrame:
    docs = proxies.table(spark, sf, "documents").join(proxies.table(spark, sf, "labels"), "doc_id")
    scored = docs.select(
        F.when((F.col("quality") == 1) & (F.col("doc_id") % 5 == 0), "only-good").otherwise(F.col("source")).alias("source"),
        F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))
    return evaluation.guarded_auc(scored, "score", "label", ["source"]).select("source", F.round("auc", 9).alias("auc"))


@query("a25_class_accuracy", sql("""
select s.split, c.y, count(t.y) as count, count(*) filter (where t.y = t.y_hat) as correct, round(count(*) filter (where t.y = t.y_hat)::double / nullif(count(t.y), 0), 9) as accuracy
from (select distinct split from train_log) s cross join range(4) c(y) left join train_log t on t.split = s.split and t.y = c.y group by all""", "train_log"))
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.class_accuracy(proxies.train_log(spark, sf), 4, keys=["split"]).withColumn("accuracy", F.round("accuracy", 9))


@query("a26_epoch_means", sql("""
select split, epoch, round(avg(loss), 9) as loss, round(avg(instance_loss), 9) as instance_loss, round(avg(case when y = y_hat then 0.0::double else 1.0::double end), 9) as error
from train_log group by all""", "train_log"))
def a26(spark: SparkSession, sf: str) -> DataFrame:
    means = evaluation.epoch_means(proxies.train_log(spark, sf))
    return means.select("split", "epoch", *[F.round(c, 9).alias(c) for c in ("loss", "instance_loss", "error")])


@query("a27_weighted_loss", sql("""
select batch, round(0.7::double*loss + (1 - 0.7::double)*instance_loss, 9) as total from train_log""", "train_log"))
def a27(spark: SparkSession, sf: str) -> DataFrame:
    total = evaluation.weighted_loss(F.col("loss"), F.col("instance_loss"), 0.7)
    return proxies.train_log(spark, sf).select("batch", F.round(total, 9).alias("total"))


@query("a28_early_stopping", sql("""
select fold, min(epoch) filter (where stopped) as stopped_at, arg_max(checkpoint, epoch) as checkpoint_epoch, round(arg_max(best, epoch), 9) as best_loss from walk group by fold""",
    "train_log", recursive=True, extra={
        "losses": "select *, row_number() over (partition by fold order by epoch) as rn from (select y as fold, epoch, round(avg(loss), 9) as loss from train_log where split = 'val' group by all)",
        "walk": """
select fold, rn, epoch, loss as best, 0 as counter, epoch as checkpoint, false as stopped from losses where rn = 1
union all
select w.fold, l.rn, l.epoch, least(w.best, l.loss), case when l.loss <= w.best then 0 else w.counter + 1 end,
  case when l.loss <= w.best then l.epoch else w.checkpoint end, l.loss > w.best and w.counter + 1 >= 4 and l.epoch > 8
from walk w join losses l on l.fold = w.fold and l.rn = w.rn + 1 where not w.stopped"""}))
def a28(spark: SparkSession, sf: str) -> DataFrame:
    val = proxies.train_log(spark, sf).filter(F.col("split") == "val")
    losses = val.groupBy(F.col("y").alias("fold"), "epoch").agg(F.round(F.avg("loss"), 9).alias("loss"))
    return evaluation.early_stopping(losses, patience=4, stop_epoch=8).withColumn("best_loss", F.round("best_loss", 9))


@query("a29_prediction_table", sql("""
select vec_id as slide_id, label as Y, arg_max(k, p) as Y_hat, """ + ", ".join(f"round(max(p) filter (where k = {k}), 9) as p_{k}" for k in range(10)) + " from probs group by all", "probs"))
def a29(spark: SparkSession, sf: str) -> DataFrame:
    table = evaluation.prediction_table(probabilities(spark, sf), proxies.N_CLASSES)
    return table.select("slide_id", "Y", "Y_hat", *[F.round(f"p_{k}", 9).alias(f"p_{k}") for k in range(proxies.N_CLASSES)])


@query("a30_stage_means", sql("""
select round(avg(case when o_orderstatus = 'F' then o_totalprice/1000 else -1 end), 6) as seg_mean, round(avg(case when o_orderstatus <> 'P' then o_totalprice/2000 else -1 end), 6) as patch_mean,
  round(avg(case when o_orderkey % 3 = 0 then o_totalprice/4000 else -1 end), 6) as stitch_mean from orders"""))
def a30(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    log = proxies.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", price / 1000).alias("seg"),
        F.when(F.col("o_orderstatus") != "P", price / 2000).alias("patch"),
        F.when(F.col("o_orderkey") % 3 == 0, price / 4000).alias("stitch"))
    means = triage.stage_means(log)
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


COARSE = "select *, round(score, 2) as rs from tiles"
RANKED = """
select slide_id, tile_id, x_min, y_min, (rank() over (partition by slide_id order by rs) + (count(*) over (partition by slide_id, rs) - 1)/2.0::double)
  / count(*) over (partition by slide_id) * 100 as percentile from coarse"""


def coarse(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.tile_scores(spark, sf).withColumn("rs", F.round("score", 2))


@query("a31_percentile_rank", sql("select slide_id, tile_id, round(percentile, 9) as percentile from ranked", "tiles", extra={"coarse": COARSE, "ranked": RANKED}))
def a31(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.percentiles(coarse(spark, sf), "rs").select("slide_id", "tile_id", F.round("percentile", 9).alias("percentile"))


@query("a32_top_k", sql("""
select 'top' as side, slide_id, tile_id, rank from (select *, row_number() over (partition by slide_id order by score desc, tile_id) as rank from tiles) where rank <= 4
union all select 'bottom', slide_id, tile_id, rank from (select *, row_number() over (partition by slide_id order by score, tile_id) as rank from tiles) where rank <= 4""", "tiles"))
def a32(spark: SparkSession, sf: str) -> DataFrame:
    tiles = proxies.tile_scores(spark, sf)
    top = sampling.top_k(tiles, 4).select(F.lit("top").alias("side"), "slide_id", "tile_id", "rank")
    return top.unionByName(
        sampling.top_k(tiles, 4, invert=True).select(F.lit("bottom").alias("side"), "slide_id", "tile_id", "rank"))


@query("a33_window_sample", sql("""
select kind, slide_id, tile_id, rank from (select kind, slide_id, tile_id, row_number() over (partition by kind, slide_id order by md5('1|' || slide_id || '|' || tile_id), tile_id) as rank from (
  select 'value' as kind, slide_id, tile_id from tiles where score between 0.48 and 0.52
  union all select 'quantile', t.slide_id, t.tile_id from tiles t join (select slide_id, quantile_cont(score, 0.48) as lo, quantile_cont(score, 0.52) as hi from tiles group by slide_id) q
    on q.slide_id = t.slide_id and t.score between q.lo and q.hi)) where rank <= 6""", "tiles"))
def a33(spark: SparkSession, sf: str) -> DataFrame:
    tiles = proxies.tile_scores(spark, sf)
    by_value = sampling.window_sample(tiles, 6).select(F.lit("value").alias("kind"), "slide_id", "tile_id", "rank")
    by_quantile = sampling.window_sample(tiles, 6, as_quantiles=True).select(
        F.lit("quantile").alias("kind"), "slide_id", "tile_id", "rank")
    return by_value.unionByName(by_quantile)


@query("a34_screen_coords", sql("""
select slide_id, tile_id from tiles where x_min between 2000 and 8000 and y_min between 400 and 6000""", "tiles"))
def a34(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.screen_coords(proxies.tile_scores(spark, sf), (2000, 400), (8000, 6000)).select("slide_id", "tile_id")


@query("a35_sample_rois", sql("""
select mode, slide_id, tile_id, rank from (
  select 'range_sample' as mode, slide_id, tile_id, row_number() over (partition by slide_id order by md5('1|' || slide_id || '|' || tile_id), tile_id) as rank from screened where percentile between 45 and 55
  union all select 'topk', slide_id, tile_id, row_number() over (partition by slide_id order by percentile desc, tile_id) from screened
  union all select 'reverse_topk', slide_id, tile_id, row_number() over (partition by slide_id order by percentile, tile_id) from screened) where rank <= 3""", "tiles",
    extra={"coarse": COARSE, "ranked": RANKED, "screened": "select * from ranked where x_min between 0 and 8000 and y_min between 0 and 8000"}))
def a35(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for mode in ("range_sample", "topk", "reverse_topk"):
        one = sampling.sample_rois(
            coarse(spark, sf), 3, mode, "rs", score_start=45, score_end=55, top_left=(0, 0), bottom_right=(8000, 8000)
        ).select(F.lit(mode).alias("mode"), "slide_id", "tile_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query("a36_sample_patches", sql("""
select slide_id, tile_id, rank from (select *, row_number() over (partition by slide_id order by md5('1|' || slide_id || '|' || x_min || '|' || y_min || '|' || tile_id), x_min, y_min, tile_id) as rank from tiles) where rank <= 20""", "tiles"))
def a36(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_patches(proxies.tile_scores(spark, sf), 20).select("slide_id", "tile_id", "rank")


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.slides(spark, sf).select(
        "slide_id", F.lit(256.0).alias("dx"), F.lit(256.0).alias("dy"), F.lit(62).cast("bigint").alias("width"),
        F.lit(46).cast("bigint").alias("height"))


def _cells(source: str, shift: str, value: str, w: str, h: str) -> str:
    return f"""select slide_id, cx as cell_x, cy as cell_y, {value} as v from (select *, ceil((x_min - {shift})/256.0::double)::bigint as ax, ceil((y_min - {shift})/256.0::double)::bigint as ay from {source}),
lateral (select unnest(range(ax, least(ax + 2, {w}))) as cx), lateral (select unnest(range(ay, least(ay + 2, {h}))) as cy)"""


@query("a37_heat_grid", sql("""
select 'mean' as kind, slide_id, cell_x, cell_y, round(avg(v), 9) as value from plain group by all
union all select 'binary', slide_id, cell_x, cell_y, round_even(avg(v), 0) from hot group by all
union all select 'roi', slide_id, cell_x, cell_y, round(avg(v), 9) from roi group by all""", "tiles", extra={
    "plain": _cells("tiles", "0", "score/100", "62", "46"),
    "hot": _cells("(select *, 1.0::double / count(*) over (partition by slide_id) as cut from tiles)", "0", "case when score/100 >= cut then 1.0::double else 0 end", "62", "46"),
    "coarse": COARSE, "ranked": RANKED.replace("from coarse", "from coarse where x_min between 1600 and 8000 and y_min between 1600 and 8000"),
    "roi": _cells("ranked", "1600", "percentile/100", "25", "25")}))
def a37(spark: SparkSession, sf: str) -> DataFrame:
    tiles, level = proxies.tile_scores(spark, sf), sizes(spark, sf)
    parts = {
        "mean": heatmap.heat_grid(tiles, level, 400),
        "binary": heatmap.heat_grid(tiles, level, 400, binarize=True, thresh=-1),
        "roi": heatmap.heat_grid(coarse(spark, sf), level, 400, "rs", (1600, 1600), (8000, 8000), as_percentiles=True),
    }
    out = None
    for kind, grid in parts.items():
        one = grid.select(F.lit(kind).alias("kind"), "slide_id", "cell_x", "cell_y", F.round("value", 9).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a38_min_max_scale", sql("""
select slide_id, tile_id, round((score - min(score) over ()) / (max(score) over () - min(score) over ()), 9) as whole,
  round((score - min(score) over w) / (max(score) over w - min(score) over w), 9) as per_slide from tiles window w as (partition by slide_id)""", "tiles"))
def a38(spark: SparkSession, sf: str) -> DataFrame:
    whole = embeddings.min_max_scale(proxies.tile_scores(spark, sf), "score", "whole")
    both = embeddings.min_max_scale(whole, "score", "per_slide", ["slide_id"])
    return both.select("slide_id", "tile_id", F.round("whole", 9).alias("whole"), F.round("per_slide", 9).alias("per_slide"))


@query("a39_cosine_neighbours", sql("""
select tile_id, neighbour, round(s, 6) as similarity, rank from (select a.vec_id as tile_id, b.vec_id as neighbour, s, row_number() over (partition by a.vec_id order by s desc, b.vec_id) as rank
from embeddings a, embeddings b, lateral (select list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as s) where a.vec_id <> b.vec_id) where rank <= 5"""))
def a39(spark: SparkSession, sf: str) -> DataFrame:
    near = embeddings.cosine_neighbours(proxies.features(spark, sf), 5)
    return near.withColumn("similarity", F.round("similarity", 6))


# ------------------------------------------------------------ user models

@query("u1_score_tiles", sql("""
select vec_id as tile_id, label, """ + ", ".join(f"round(max(p) filter (where k = {k}), 6) as c{k}" for k in range(10)) + " from probs group by all", "probs"))
def u1(spark: SparkSession, sf: str) -> DataFrame:
    head = proxies.HEAD

    def factory():
        import numpy as np

        weights = np.array(head).T
        return lambda x: x @ weights

    classes = [f"c{k}" for k in range(proxies.N_CLASSES)]
    scored = scoring.score_tiles(proxies.features(spark, sf), factory, classes)
    return scored.select("tile_id", "label", *[F.round(c, 6).alias(c) for c in classes])


@query("u2_extract_features", sql("""
select vec_id as tile_id, label, j, round((select avg(cast(embedding[j*4 + i + 1] as double)) from range(4) r(i)), 5) as value from embeddings, range(16) c(j)"""))
def u2(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the vectors are already stored; only the others are extracted, then all are read."""

    def factory():
        return lambda x: x.reshape(len(x), 16, 4).mean(axis=2)

    tiles = proxies.features(spark, sf)
    path = tables.scratch_path(spark, "features")
    early = tiles.filter(F.col("tile_id") % 2 == 0)
    scoring.extract_features(early, factory).write.mode("append").parquet(path)
    done = spark.read.parquet(path)
    scoring.extract_features(tiles, factory, done=done).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("tile_id", "label", F.posexplode("features").alias("j", "v")).select(
        "tile_id", "label", "j", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("st1_running_triage", sql("""
select slide_id, 'v1' as model_ver, count(*) as tiles, count(*) filter (where score > 0.93) as positive_tiles,
  case when count(*) filter (where score > 0.93) >= 40 then 3 when count(*) filter (where score > 0.93) > 3 then 2 else 1 end as algorithm_result
from tiles group by slide_id""", "tiles"))
def st1(spark: SparkSession, sf: str) -> DataFrame:
    folder, out, state = (tables.scratch_path(spark, n) for n in ("arriving", "running", "state"))
    tiles = proxies.tile_scores(spark, sf).withColumn("model_ver", F.lit("v1"))
    # Files hold about a million tiles however many arrive; they still arrive in two batches.
    files = 2 * max(2, math.ceil(tiles.count() / 2_000_000))
    tiles.repartition(files, "tile_id").write.parquet(folder)
    stream = triage_stream.prediction_stream(spark, folder, tiles.schema, max_files=files // 2)
    running = triage_stream.running_triage(stream, "score", 0.93, 3, 40)
    handle = triage_stream.start_upserts(running, out, state, available_now=True)
    handle.awaitTermination()
    return triage_stream.current_results(spark, out)
