from __future__ import annotations

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tilewright.operators import embeddings, evaluation, heatmap, sampling, scoring, triage
from tilewright.streaming import triage_stream

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@QUICK
@given(st.lists(st.integers(1, 6), min_size=1, max_size=25), st.integers(1, 4), st.integers(0, 8))
def test_early_stopping_walks_like_a_loop(spark, losses, patience, stop_epoch):
    rows = [(0, e, float(v)) for e, v in enumerate(losses)]
    got = evaluation.early_stopping(spark.createDataFrame(rows, "fold int, epoch int, loss double"), patience, stop_epoch).first()
    best, counter, saved, stopped = None, 0, None, None
    for _, e, v in rows:
        if best is None or v <= best:
            best, counter, saved = v, 0, e
        else:
            counter += 1
            if counter >= patience and e > stop_epoch:
                stopped = e
                break
    assert (got.stopped_at, got.checkpoint_epoch, got.best_loss) == (stopped, saved, best)


def test_neighbours_match_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "tile_id bigint, features array<float>")
    got = {(r.tile_id, r["rank"]): r.neighbour for r in embeddings.cosine_neighbours(df, 4, block_rows=9).collect()}
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        assert [got[(i, r)] for r in range(1, 5)] == order


def test_sample_is_repeatable_and_without_replacement(spark):
    tiles = spark.range(900).select((F.col("id") % 3).alias("slide_id"), F.col("id").alias("tile_id"),
                                    (F.col("id") % 40).alias("x_min"), (F.col("id") % 30).alias("y_min"))
    a = sampling.sample_patches(tiles, 50).select("slide_id", "tile_id").collect()
    b = sampling.sample_patches(tiles.repartition(7), 50).select("slide_id", "tile_id").collect()
    assert sorted(a) == sorted(b) and len(set(a)) == 150
    other = sampling.sample_patches(tiles, 50, seed=2).select("slide_id", "tile_id").collect()
    assert sorted(other) != sorted(a)


def test_quantiles_interpolate(spark):
    values = [1.0, 1.0, 2.0, 4.0, 4.0, 7.0, 9.5]
    df = spark.createDataFrame([(0, v) for v in values], "k int, v double")
    row = sampling.quantiles(df, "v", ["k"], {"a": 0.1, "b": 0.5, "c": 0.83, "d": 1.0}).first()
    assert np.allclose([row.a, row.b, row.c, row.d], np.quantile(values, [0.1, 0.5, 0.83, 1.0]))


def test_heat_grid_averages_overlaps(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 100.0), (1, 4, 0, 50.0)], "slide_id int, x_min bigint, y_min bigint, score double")
    sizes = spark.createDataFrame([(1, 4.0, 4.0, 3, 2)], "slide_id int, dx double, dy double, width bigint, height bigint")
    got = {(r.cell_x, r.cell_y): r.value for r in heatmap.heat_grid(tiles, sizes, 8).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): 0.75, (1, 1): 0.75, (2, 0): 0.5, (2, 1): 0.5}


def test_model_is_built_once_per_task_and_probabilities_add_up(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "tile_id int, features array<float>")
    scored = scoring.score_tiles(df, lambda: (lambda x: x @ np.array([[0.1, -0.2], [0.3, 0.4]])), ["a", "b"]).collect()
    assert len(scored) == 20 and all(abs(r.a + r.b - 1) < 1e-12 for r in scored)
    plain = scoring.linear_scores(df, [[0.1, 0.3], [-0.2, 0.4]], ["a", "b"]).collect()
    assert np.allclose(sorted(r.a for r in scored), sorted(r.a for r in plain))


def test_stream_ends_at_the_batch_result_and_resumes(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    tiles = spark.range(400).select(
        (F.col("id") % 9).alias("slide_id"), F.lit("m").alias("model_ver"), (F.col("id") / 400.0).alias("p"))

    def drain():
        stream = triage_stream.prediction_stream(spark, folder, tiles.schema, max_files=1)
        running = triage_stream.running_triage(stream, "p", 0.5, 3, 20)
        triage_stream.start_upserts(running, out, state, available_now=True).awaitTermination()

    tiles.filter("p < 0.7").repartition(3).write.mode("append").parquet(folder)
    drain()
    tiles.filter("p >= 0.7").repartition(2).write.mode("append").parquet(folder)
    drain()
    got = {r.slide_id: (r.positive_tiles, r.algorithm_result) for r in triage_stream.current_results(spark, out).collect()}
    want = triage.triage(triage.positive_tiles(tiles, "p", 0.5), 3, 20)
    assert got == {r.slide_id: (r.positive_tiles, r.algorithm_result) for r in want.collect()}


def test_null_keys_and_null_scores_keep_their_rows(spark):
    from tilewright.operators.ordering import top_rows

    rows = spark.createDataFrame(
        [(None if i % 3 == 0 else i % 3, i, None if i % 4 == 0 else i / 10) for i in range(24)], "slide_id int, tile_id int, score double")
    ranked = {r.tile_id: r.percentile for r in sampling.percentiles(rows).collect()}
    assert len(ranked) == 24 and all((ranked[i] is None) == (i % 4 == 0) for i in range(24))
    assert max(ranked[i] for i in range(24) if i % 3 == 0 and i % 4) == 100
    limit = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    order = [F.col("score").desc(), F.col("tile_id")]
    wanted = sorted(map(str, top_rows(rows, ["slide_id"], order, 5).collect()))
    try:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
        assert sorted(map(str, top_rows(rows, ["slide_id"], order, 5).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)


def test_vectors_with_nan_are_no_neighbours(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float("nan")] * 4 if i % 9 == 0 else rnd.standard_normal(4).tolist()) for i in range(45)]
    frame = spark.createDataFrame(rows, "tile_id long, features array<double>")
    for k in (5, 16, 17):
        found = embeddings.cosine_neighbours(frame, k).collect()
        assert len(found) == 40 * k and all(r.tile_id % 9 and r.neighbour % 9 for r in found)


def test_heat_grid_of_many_overlaps(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(rnd.integers(0, 2)), int(rnd.integers(0, 60)), int(rnd.integers(0, 60)), float(rnd.random())) for _ in range(500)]
    tiles = spark.createDataFrame(rows, "slide_id int, x_min bigint, y_min bigint, score double")
    sizes = spark.createDataFrame([(s, 4.0, 4.0, 14, 12) for s in (0, 1)], "slide_id int, dx double, dy double, width bigint, height bigint")
    want: dict = {}
    for s, x, y, v in rows:
        for cx in range(-(-x // 4), min(-(-x // 4) + 4, 14)):
            for cy in range(-(-y // 4), min(-(-y // 4) + 4, 12)):
                want.setdefault((s, cx, cy), []).append(v / 100)
    got = {(r.slide_id, r.cell_x, r.cell_y): r.value for r in heatmap.heat_grid(tiles, sizes, 16).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - np.mean(v)) < 1e-15 for k, v in want.items())


def test_a_copied_file_counts_once_and_a_broken_batch_is_repeated(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    tiles = spark.range(300).select(
        (F.col("id") % 7).alias("slide_id"), F.lit("m").alias("model_ver"), F.col("id").alias("tile_id"), (F.col("id") / 300.0).alias("p"))

    def drain():
        stream = triage_stream.prediction_stream(spark, folder, tiles.schema, max_files=1)
        running = triage_stream.running_triage(stream, "p", 0.5, 3, 20, once=("tile_id",))
        triage_stream.start_upserts(running, out, state, available_now=True).awaitTermination()

    tiles.repartition(2).write.mode("append").parquet(folder)
    drain()
    tiles.filter("p < 0.6").coalesce(1).write.mode("append").parquet(folder)  # the same tiles under another name
    drain()
    wanted = {r.slide_id: r.positive_tiles for r in triage.positive_tiles(tiles, "p", 0.5).collect()}
    assert {r.slide_id: r.positive_tiles for r in triage_stream.current_results(spark, out).collect()} == wanted
    newest, place = triage_stream._pointers(spark, out)[0]
    batch = triage_stream.current_results(spark, out).limit(0)
    torn = spark.createDataFrame([(99, "m", 1, 1, 1)], batch.schema)
    torn.write.mode("overwrite").parquet(f"{out}/table_{1 - place}")  # a batch that broke off before its pointer
    assert {r.slide_id for r in triage_stream.current_results(spark, out).collect()} == set(wanted)
    for _ in range(2):  # its repetition, and once more
        triage_stream.merge_batch(spark.createDataFrame([(3, "m", 9, 8, 2)], batch.schema), newest + 1, out)
    got = {r.slide_id: r.positive_tiles for r in triage_stream.current_results(spark, out).collect()}
    assert got == {**wanted, 3: 8}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["pointer_0", "pointer_1", "table_0", "table_1"]


def _vectors(spark, n=3000, dim=32):
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((40, dim))
    x = centres[rnd.integers(0, 40, n)] + 0.6 * rnd.standard_normal((n, dim))
    x[:300] = x[0]  # copies
    return x, spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "tile_id long, study int, features array<double>")


def test_neighbours_within_a_study(spark):
    x, frame = _vectors(spark, 600)
    found = embeddings.cosine_neighbours(frame, 4, block_rows=150, keys=["study"]).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in found[:400]:
        assert r.tile_id % 2 == r.neighbour % 2 and abs(r.similarity - u[r.tile_id] @ u[r.neighbour]) < 1e-12
    sims = u @ u.T
    sims[np.arange(600)[:, None] % 2 != np.arange(600) % 2] = -2
    np.fill_diagonal(sims, -2)
    best = np.sort(sims, axis=1)[:, ::-1][:, :4]
    assert all(abs(r.similarity - best[r.tile_id, r.rank - 1]) < 1e-12 for r in found) and len(found) == 2400


def test_approximate_neighbours_have_recall(spark):
    x, frame = _vectors(spark)
    for keys in (None, ["study"]):
        exact = {(r.tile_id, r.rank): r.similarity for r in embeddings.cosine_neighbours(frame, 5, keys=keys).collect()}
        found = embeddings.approximate_neighbours(frame, 5, keys=keys, block_rows=400).collect()
        assert len(found) == len(exact) and len({(r.tile_id, r.neighbour) for r in found}) == len(found)
        hits = [r.similarity >= exact[r.tile_id, 5] - 1e-12 for r in found]
        assert np.mean(hits) >= 0.95


def test_ranges_are_stored_and_nothing_is_cached(spark):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    rows = spark.range(1000).select((F.col("id") % 3).alias("slide_id"), F.col("id").alias("tile_id"), (F.col("id") % 17).cast("double").alias("score"))
    sampling.percentiles(rows).count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_one_scan_gives_the_tables_of_an_evaluation(spark):
    from tilewright.operators import evaluation
    from tilewright.plans import workflows

    rnd = np.random.default_rng(9)
    rows = [(int(rnd.integers(0, 3)), int(rnd.integers(0, 4)), np.round(rnd.dirichlet(np.ones(4)), 2).tolist()) for _ in range(300)] + [(1, 1, None), (None, 2, [0.1, 0.2, 0.3, 0.4])]
    frame = spark.createDataFrame(rows, "y int, y_hat int, p array<double>")
    got = workflows.evaluate_run(frame, 4)
    plain = frame.filter("p is not null")
    want = {r.class_idx: r.auc for r in evaluation.one_vs_rest_auc(plain, label="y").collect()}
    assert {r.class_idx: r.auc for r in got["class_auc"].collect()} == want
    assert got["micro_auc"].first().auc == evaluation.micro_auc(plain, label="y").first().auc
    assert abs(got["macro_auc"].first().auc - evaluation.macro_auc(plain, label="y").first().auc) < 1e-12
    columns = ["y", "count", "correct", "accuracy"]
    assert sorted(map(tuple, got["class_accuracy"].select(*columns).collect())) == sorted(
        map(tuple, evaluation.class_accuracy(frame.filter("y is not null"), 4).select(*columns).collect()))
    assert abs(got["error"].first().error - (1 - sum(a == b for a, b, _ in rows) / len(rows))) < 1e-12


def test_threshold_study_from_files(spark):
    from tilewright.plans import workflows

    rnd = np.random.default_rng(2)
    truth = [("A1", "Y"), ("A2", "N"), ("A3", "WT"), ("A4", "EQV"), ("A5", "?"), ("zz", "Y")]
    tiles = [(f"{s}-scan.csv", float(x)) for s, c in truth[:5] for x in rnd.random(20) * (0.99 if c in ("Y", "WT") else 0.5)]
    out = workflows.threshold_study(
        spark.createDataFrame(tiles, "file_name string, p double"), spark.createDataFrame(truth, "sample_id string, code string"),
        "p", {"N": 0, "EQV": 0, "WT": 1, "Y": 1}, grid=[0.2, 0.5, 0.6])
    rates = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in out["rates"].collect()}
    assert rates[0.2] == (2, 2, 0, 0) and rates[0.5] == rates[0.6] == (2, 0, 0, 2)


def test_tasks_of_a_heat_grid_grow_with_the_tiles(spark):
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert heatmap.task_count(spark.range(10)) == 1
    assert heatmap.task_count(spark.range(width * heatmap.LEAST_TILES)) == width
    assert heatmap.task_count(spark.range(5 * width * heatmap.TASK_TILES)) == 5 * width
    tiles = spark.range(50).select(
        F.lit(1).alias("slide_id"), (F.col("id") % 7 * 3).alias("x"), (F.col("id") % 5 * 4).alias("y"), (F.col("id") / 50).alias("v"))
    span = lambda c: F.struct(F.col(c).alias("lo"), (F.col(c) + 6).alias("hi")).alias(c)
    placed = tiles.select("slide_id", span("x"), span("y"), "v")
    one, many = (sorted(map(tuple, heatmap.cell_sums(placed, n).collect())) for n in (1, 7))
    assert one == many and sum(r[-1] for r in one) == 50 * 36


def test_neighbours_hold_one_strip_of_similarities():
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(3)
    block = pa.table({"id": np.arange(8192), "v": pa.array(list(rnd.normal(size=(8192, 8)).astype(np.float32)), pa.list_(pa.float32()))})
    tracemalloc.start()
    found = embeddings._best(block, block, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 3 * 8192 and peak < 50_000_000


def test_files_of_the_running_triage_grow_with_the_tiles(spark, tmp_path, monkeypatch):
    """The largest task reads a file of about a million tiles, not a fixed share of the table."""
    from tilewright.plans import catalogue, queries_models

    monkeypatch.setattr(queries_models.tables, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    keys = {"l_orderkey": F.col("id"), "l_linenumber": F.lit(1), "l_partkey": F.col("id") % 100, "l_suppkey": F.col("id") % 10}
    spark.range(4_100_000).select(*[c.cast("long").alias(n) for n, c in keys.items()]).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalogue.QUERIES["st1_running_triage"](spark, str(tmp_path)).collect()
    assert len(rows) == 10 and sum(r.tiles for r in rows) == 4_100_000
    assert len(list((tmp_path / "arriving").glob("*.parquet"))) == 6
