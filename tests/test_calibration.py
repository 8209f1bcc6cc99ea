from __future__ import annotations

from hypothesis import HealthCheck, given, settings, strategies as st

from tilewright.operators import calibration as cal, curves, ordering, sampling
from pyspark.sql import functions as F

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def test_grid_and_bands():
    grid = cal.slide_grid()
    assert len(grid) == 109 and grid[0] == 0 and grid[98] == 0.98 and grid[-1] == 0.99 + 0.001 * 9
    assert cal.band_grid([0.0, 0.5], [0.5, 1.0], [0.25, 0.1])[:3] == [0.0, 0.25, 0.5]
    assert cal.band_grid([0.0], [1.0], [0.3])[-1] == 1.0


@QUICK
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([0.0, 0.01, 0.5, 0.57, 0.98, 0.99, 0.991, 0.9999, 1.0, 0.29])), min_size=1, max_size=30))
def test_sweep_counts_like_a_loop(spark, rows):
    grid = cal.slide_grid()
    got = {(r.slide_id, r.t_idx): r.positive_tiles for r in cal.sweep(
        spark.createDataFrame(rows, "slide_id int, p double"), "p").collect()}
    want = {(s, i): sum(1 for k, p in rows if k == s and p >= t) for s in {k for k, _ in rows} for i, t in enumerate(grid)}
    assert got == want


def test_bucket_is_exact_on_grid_values(spark):
    grid = cal.slide_grid()
    probes = sorted({v for t in grid for v in (t, t - 1e-12, t + 1e-12)} | {-1.0, 2.0})
    df = spark.createDataFrame([(p,) for p in probes], "p double").select("p", cal.grid_bucket(F.col("p"), grid).alias("b"))
    assert {r.p: r.b for r in df.collect()} == {p: sum(t <= p for t in grid) for p in probes}


def test_first_cut_off_wins_ties(spark):
    rated = spark.createDataFrame(
        [(0.1, 0.9, 0.4), (0.2, 0.8, 0.6), (0.3, 0.7, 0.6), (0.4, 0.6, 0.9)], "threshold double, sensitivity double, specificity double")
    assert cal.best_at_sensitivity(rated).first().threshold == 0.2
    assert cal.youden(rated).first().threshold == 0.4
    assert cal.best_at_sensitivity(rated.withColumn("specificity", F.lit(0.0))).count() == 0
    scored = spark.createDataFrame([(0.5, 0.8), (0.1, 0.8), (0.9, 0.7)], "threshold double, auc double")
    assert cal.best_value(scored, "auc").first().threshold == 0.1


@QUICK
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1)), min_size=2, max_size=40))
def test_auc_counts_pairs(spark, rows):
    got = curves.roc_auc(spark.createDataFrame(rows, "s int, y int"), "s", "y").first().auc
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    if not pos or not neg:
        assert got is None
        return
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


@QUICK
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40))
def test_percentiles_average_ties(spark, rows):
    numbered = [(k, v, i) for i, (k, v) in enumerate(rows)]
    got = {r.i: r.percentile for r in sampling.percentiles(
        spark.createDataFrame(numbered, "slide_id int, v int, i int"), "v").collect()}
    for k, v, i in numbered:
        group = [x for s, x, _ in numbered if s == k]
        rank = sum(x < v for x in group) + (sum(x == v for x in group) + 1) / 2
        assert abs(got[i] - rank / len(group) * 100) < 1e-9


def test_running_totals_over_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 3).alias("k"), "id")
    out = ordering.running_totals(df, ["k"], [F.col("id").desc()], {"n": F.lit(1), "s": F.col("id")}).collect()
    by_key: dict = {}
    for r in out:
        by_key.setdefault(r.k, []).append(r)
    assert sum(map(len, by_key.values())) == 5000
    for rows in by_key.values():
        rows.sort(key=lambda r: -r.id)
        total = 0
        for i, r in enumerate(rows, 1):
            total += r.id
            assert (r.n, r.s) == (i, total)
