"""Catalogue entries: triage, calibration and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilewright import config
from tilewright.operators import calibration as cal, curves, triage
from tilewright.plans import proxies
from tilewright.plans.proxy_sql import sql
from tilewright.plans.registry import Registry

query = Registry()


# ---------------------------------------------------------------- triage

@query("a1_positive_tiles", sql("""
select slide_id, count(*) filter (where score > 0.99) as positive_tiles from tiles group by slide_id""", "tiles"))
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return triage.positive_tiles(proxies.tile_scores(spark, sf), "score", 0.99)


STAIN_ROWS = "(values ('he',0.99993::double,0,10),('qc',0.99::double,0,95),('p53',0.99::double,0,2),('tff3',0.93::double,3,40)) s(stain,threshold,lcp,hcp)"


@query("a2_triage", sql(f"""
select stain, slide_id, n as positive_tiles, case when n >= hcp then 3 when n > lcp then 2 else 1 end as algorithm_result
from (select stain, lcp, hcp, slide_id, count(*) filter (where score > threshold) as n
      from tiles, {STAIN_ROWS} group by all)""", "tiles"))
def a2(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for stain in config.STAINS:
        one = triage.triage_for_stain(proxies.tile_scores(spark, sf), stain, "score").select(
            F.lit(stain).alias("stain"), "slide_id", "positive_tiles", "algorithm_result"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("a3_positives_ordered", sql("""
select slide_id, tile_id, score, row_number() over (partition by slide_id order by score desc, x_min, y_min, tile_id) as place
from tiles where score > 0.9""", "tiles"))
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return triage.positives_ordered(proxies.tile_scores(spark, sf), "score", 0.9).select(
        "slide_id", "tile_id", "score", "place"
    )


@query("a4_top_crops", sql("""
select slide_id, rank, score, x_min - 200 as crop_x, y_min - 200 as crop_y, 800 as crop_w, 800 as crop_h
from (select *, row_number() over (partition by slide_id order by score desc, x_min, y_min, tile_id) as rank
      from tiles where score > 0.9) where rank <= 5""", "tiles"))
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return triage.top_crops(proxies.tile_scores(spark, sf), "score", 0.9).select(
        "slide_id", "rank", "score", "crop_x", "crop_y", "crop_w", "crop_h"
    )


def he_results(spark: SparkSession, sf: str) -> DataFrame:
    tiles = proxies.tile_predictions(spark, sf, "he")
    return triage.triage(triage.positive_tiles(tiles, "atypia", 0.99), 0, 10)


RECORDS = """
select split_part(slide_name, ' ', 1) as sample_id, replace(slide_name, '.ndpi', '') as slide_filename, n as positive_tiles,
  case when n >= 10 then 3 when n > 0 then 2 else 1 end as algorithm_result,
  case when n > 0 then 'he-model-v1.geojson' end as tile_mapping, 'he-model-v1' as algorithm_version
from (select slide_id, count(*) filter (where score > 0.99) as n from tiles group by slide_id) join slides using (slide_id)"""


@query("a5_slide_record", sql(RECORDS, "tiles", "slides"))
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return triage.slide_records(he_results(spark, sf), proxies.slides(spark, sf), "he-model-v1", ("json",))


@query("a6_run_tally", sql("""
select count(*) filter (where algorithm_result = 3) as high, count(*) filter (where algorithm_result = 2) as low,
  count(*) filter (where algorithm_result = 1) as negative from records""", "tiles", "slides", extra={"records": RECORDS}))
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return triage.run_tally(a5(spark, sf))


# ----------------------------------------------------------- calibration

@query("a7_threshold_grid", sql("""
select slide_id, count(*) as cutoffs, min(threshold) as lowest, max(threshold) as highest, round(sum(threshold), 9) as total,
  count(*) filter (where best >= threshold) as reached
from (select slide_id, max(score) as best from tiles group by slide_id), grid group by slide_id""", "tiles", "grid"))
def a7(spark: SparkSession, sf: str) -> DataFrame:
    best = proxies.tile_scores(spark, sf).groupBy("slide_id").agg(F.max("score").alias("best"))
    values = F.array(*[F.lit(t) for t in cal.slide_grid()])
    return best.select("slide_id", "best", F.explode(values).alias("threshold")).groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("cutoffs"), F.min("threshold").alias("lowest"), F.max("threshold").alias("highest"),
        F.round(F.sum("threshold"), 9).alias("total"), F.count_if(F.col("best") >= F.col("threshold")).alias("reached"),
    )


def swept(spark: SparkSession, sf: str) -> DataFrame:
    return cal.sweep(proxies.tile_scores(spark, sf), "score")


@query("a8_threshold_sweep", sql("select slide_id, t_idx, threshold, positive_tiles from swept", "swept"))
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return swept(spark, sf)


PIVOT_GRID = cal.band_grid([0.0, 0.9], [0.9, 1.0], [0.3, 0.025])


@query("a9_pivot_sweep", sql("select slide_id, " + ", ".join(
    f"count(*) filter (where score >= {t!r}::double) as \"Threshold_{t}\"" for t in PIVOT_GRID
) + " from tiles group by slide_id", "tiles"))
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return cal.pivot_sweep(cal.sweep(proxies.tile_scores(spark, sf), "score", PIVOT_GRID), PIVOT_GRID)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.create_map(*[F.lit(v) for kv in config.P53_LABELS.items() for v in kv])
    return proxies.truth_codes(spark, sf).select("slide_id", F.try_element_at(codes, F.col("code")).alias("label"))


def rated(spark: SparkSession, sf: str) -> DataFrame:
    return cal.rates(cal.confusion(swept(spark, sf), labelled(spark, sf)))


@query("a10_confusion_counts", sql("select * from conf", "conf"))
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return cal.confusion(swept(spark, sf), labelled(spark, sf))


@query("a11_sensitivity_specificity", sql("select t_idx, threshold, sensitivity, specificity from rated", "rated"))
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return rated(spark, sf).select("t_idx", "threshold", "sensitivity", "specificity")


@query("a12_best_at_sensitivity", sql("""
select threshold, sensitivity, specificity from rated where sensitivity >= 0.7 and specificity > 0
order by specificity desc, threshold limit 1""", "rated"))
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return cal.best_at_sensitivity(rated(spark, sf)).select("threshold", "sensitivity", "specificity")


@query("a13_youden", sql("""
select threshold, sensitivity, specificity, sensitivity + specificity - 1 as j from rated
order by j desc, threshold limit 1""", "rated"))
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return cal.youden(rated(spark, sf)).select("threshold", "sensitivity", "specificity", "j")


@query("a14_sweep_roc", sql("""
select round(sum((fpr - pf) * (tpr + pt) / 2), 9) as auroc from (
  select fpr, tpr, lag(fpr) over w as pf, lag(tpr) over w as pt
  from (select threshold, 1 - specificity as fpr, sensitivity as tpr from rated) window w as (order by fpr, tpr, threshold))""", "rated"))
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return cal.sweep_auroc(rated(spark, sf)).select(F.round("auroc", 9).alias("auroc"))


# ---------------------------------------------------------------- curves

@query("a15_roc_curve", sql("""
select distinct score, round((select count(*) from bin_scores b where b.label = 0 and b.score >= a.score)::double / (select count(*) from bin_scores where label = 0), 9) as fpr,
  round((select count(*) from bin_scores b where b.label = 1 and b.score >= a.score)::double / (select count(*) from bin_scores where label = 1), 9) as tpr
from bin_scores a""", "bin_scores"))
def a15(spark: SparkSession, sf: str) -> DataFrame:
    pts = curves.roc_curve(proxies.binary_scores(spark, sf), "score", "label")
    return pts.select("score", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


SWEPT_LABELLED = "select t_idx, threshold, positive_tiles, label from swept join labelled using (slide_id)"


def swept_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return swept(spark, sf).join(labelled(spark, sf), "slide_id")


AUC_BY_T = """
select t_idx, threshold, sum(case when p.positive_tiles > n.positive_tiles then 1.0::double when p.positive_tiles = n.positive_tiles then 0.5::double else 0 end) / count(*) as auc
from (select * from sl where label = 1) p join (select * from sl where label = 0) n using (t_idx, threshold) group by all"""


@query("a16_roc_auc", sql("select t_idx, threshold, round(auc, 9) as auc from aucs", "swept", "labelled", extra={"sl": SWEPT_LABELLED, "aucs": AUC_BY_T}))
def a16(spark: SparkSession, sf: str) -> DataFrame:
    auc = curves.roc_auc(swept_labelled(spark, sf), "positive_tiles", "label", ["t_idx", "threshold"])
    return auc.select("t_idx", "threshold", F.round("auc", 9).alias("auc"))


PR = """
select score, tp::double / (tp + fp) as prec, tp::double / n_pos as rec from (
  select distinct score, count(*) filter (where label = 1) over w as tp, count(*) filter (where label = 0) over w as fp,
    count(*) filter (where label = 1) over () as n_pos from bin_scores
  window w as (order by score desc range between unbounded preceding and current row))"""


@query("a17_pr_curve", sql("select score, round(prec, 9) as precision, round(rec, 9) as recall from pr", "bin_scores", extra={"pr": PR}))
def a17(spark: SparkSession, sf: str) -> DataFrame:
    pts = curves.pr_curve(proxies.binary_scores(spark, sf), "score", "label")
    return pts.select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("a18_average_precision", sql("""
select round(sum((rec - prev) * prec), 9) as average_precision
from (select rec, prec, coalesce(lag(rec) over (order by score desc), 0) as prev from pr)""", "bin_scores", extra={"pr": PR}))
def a18(spark: SparkSession, sf: str) -> DataFrame:
    ap = curves.average_precision(proxies.binary_scores(spark, sf), "score", "label")
    return ap.select(F.round("average_precision", 9).alias("average_precision"))


F1 = """
select t_idx, threshold, case when tp+fp = 0 then 0 else tp::double/(tp+fp) end as precision,
  case when tp+fn = 0 then 0 else tp::double/(tp+fn) end as recall,
  case when 2*tp+fp+fn = 0 then 0 else (2*tp)::double/(2*tp+fp+fn) end as f1 from conf"""


@query("a19_precision_recall_f1", sql("select t_idx, threshold, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from f1t", "conf", extra={"f1t": F1}))
def a19(spark: SparkSession, sf: str) -> DataFrame:
    table = cal.f1_table(swept_labelled(spark, sf), ["t_idx", "threshold"])
    return table.select("t_idx", "threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("a20_best_threshold", sql("""
select t_idx, threshold, round(auc, 9) as auc, round(threshold, 6) as cutoff from aucs order by round(auc, 12) desc, threshold limit 1""",
    "swept", "labelled", extra={"sl": SWEPT_LABELLED, "aucs": AUC_BY_T}))
def a20(spark: SparkSession, sf: str) -> DataFrame:
    auc = curves.roc_auc(swept_labelled(spark, sf), "positive_tiles", "label", ["t_idx", "threshold"])
    best = cal.best_value(auc, "auc")
    return best.select("t_idx", "threshold", F.round("auc", 9).alias("auc"), "cutoff")


@query("a21_melt", sql("""
select t_idx, 'precision' as variable, round(precision, 9) as value from f1t
union all select t_idx, 'recall', round(recall, 9) from f1t""", "conf", extra={"f1t": F1}))
def a21(spark: SparkSession, sf: str) -> DataFrame:
    table = cal.f1_table(swept_labelled(spark, sf), ["t_idx", "threshold"])
    return cal.melt_rates(table, ["t_idx"]).select("t_idx", "variable", F.round("value", 9).alias("value"))


@query("s18_store_cutoff", sql("""
select 'he' as stain, round(threshold, 7) as tile_thresh from aucs order by round(auc, 12) desc, threshold limit 1""",
    "swept", "labelled", extra={"sl": SWEPT_LABELLED, "aucs": AUC_BY_T}))
def s18(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.sources import tables

    auc = curves.roc_auc(swept_labelled(spark, sf), "positive_tiles", "label", ["t_idx", "threshold"])
    best = cal.best_value(auc, "auc", digits=7)
    stored = best.select(F.lit("he").alias("stain"), F.col("cutoff").alias("tile_thresh"))
    return tables.round_trip(stored, "cutoffs", mode="json")
