from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import names
from tilewright.operators import collate, pixels
from tilewright.plans import workflows
from tilewright.sources import annotations, tables


def test_process_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one.ndpi \ntwo.svs\n")
    (tmp_path / "a.csv").write_text("slide_id,process\nthree.ndpi,1\n")
    assert [r.slide_id for r in tables.read_process_list(spark, str(tmp_path / "a.txt")).collect()] == ["one.ndpi", "two.svs"]
    assert tables.read_process_list(spark, str(tmp_path / "a.csv")).first().slide_id == "three.ndpi"
    with pytest.raises(ValueError):
        tables.read_process_list(spark, "a.json")


def test_only_slide_files_are_listed(spark, tmp_path):
    for n in ("b.ndpi", "a.svs", "note.txt"):
        (tmp_path / n).write_bytes(b"xyz")
    assert sorted(r.slide_id for r in tables.list_slides(spark, str(tmp_path)).collect()) == ["a.svs", "b.ndpi"]


@pytest.mark.parametrize("path,want", [("/x/a.b.ndpi", "a.b"), ("a", "a"), (".hidden", ".hidden"), ("/p.q/file", "file")])
def test_stem(spark, path, want):
    assert spark.range(1).select(names.stem(F.lit(path)).alias("s")).first().s == want


def test_geojson_files_are_whole_documents(spark, tmp_path):
    tiles = spark.createDataFrame(
        [(s, i * 4, 0, i * 4 + 4, 4, i / 10, i) for s in (1, 2) for i in range(8)],
        "slide_id int, x_min bigint, y_min bigint, x_max bigint, y_max bigint, p double, tile_id bigint")
    annotations.write_lines(annotations.geojson(tiles, "p", 0.25, "atypia"), str(tmp_path / "out"))
    for s in (1, 2):
        parts = sorted(Path(tmp_path / "out" / f"slide_id={s}").glob("part-*"))
        features = json.loads("".join(p.read_text() for p in parts))["features"]
        assert [f["properties"]["name"].split("_")[1] for f in features] == ["0.7", "0.6", "0.5", "0.4", "0.3"]
        ring = features[0]["geometry"]["coordinates"][0]
        assert len(ring) == 5 and ring[0] == ring[4] == [28, 0]


def test_geometry_text_is_parsed_and_never_run(spark):
    texts = spark.createDataFrame([
        (1, '[{"type":"Polygon","coordinates":[[[0.9,1],[2,3],[4,5]],[[7,7],[8,8],[9,7]]]},'
            '{"type":"Line","coordinates":[[[[0,0],[1,1]],[[2,2]]]]}]'),
        (2, "__import__('os').getcwd()")], "slide_id int, text string")
    got = [(r.slide_id, [(p.x, p.y) for p in r.points]) for r in annotations.contours_from_text(texts).orderBy("group_idx", "ring_idx").collect()]
    assert got == [(1, [(0, 1), (2, 3), (4, 5)]), (1, [(7, 7), (8, 8), (9, 7)]), (1, [(0, 0), (1, 1), (2, 2)])]


def test_attributes_are_written_once(spark, tmp_path):
    path = str(tmp_path / "coords")
    sets = spark.createDataFrame([(1, 256)], "slide_id int, patch_size int")
    for y in (0, 1):
        tables.append_coords(spark.createDataFrame([(1, 0, y)], "slide_id int, x int, y int"), sets, path)
    assert tables.read_coords(spark, path).count() == 2


def results(spark, rows):
    return spark.createDataFrame(
        rows, "sample_id string, slide_filename string, positive_tiles bigint, algorithm_result int, tile_mapping string, algorithm_version string")


def test_collation_multiplies_duplicates_and_matches_nulls(spark):
    qc = results(spark, [("a", "qa", 1, 1, None, "v"), ("a", "qb", 2, 1, None, "v"), (None, "qn", 0, 1, None, "v")])
    he = results(spark, [("a", "h1", 3, 1, None, "v"), ("a", "h2", 4, 1, None, "v"), (None, "hn", 0, 1, None, "v"), ("b", "hb", 0, 1, None, "v")])
    none = results(spark, [])
    out = collate.collate({"qc": qc, "he": he, "p53": none, "tff3": none})
    rows = out.collect()
    assert sorted(str(r.sample_id) for r in rows) == ["None", "a", "a", "a", "a", "b"]
    assert [r.h_e_slide_filename for r in rows if r.sample_id == "b"] == [None]
    filled = collate.collate({"qc": qc, "he": he, "p53": none, "tff3": none}, fill=True)
    assert [r.h_e_slide_filename for r in filled.filter("sample_id = 'b'").collect()] == ["hb"]


def test_last_listed_participant_wins_and_nulls_sort_last(spark):
    four = {s: results(spark, [("a", "f", 1, 1, None, "v"), ("b", "f", 1, 1, None, "v"), ("c", "f", 1, 1, None, "v")]) for s in collate.RENAMES}
    lists = "lab_number string, participant_id string, file_order int"
    primary = spark.createDataFrame([("a", "P1", 0), (None, "P9", 1), ("a", "P2", 2)], lists)
    repeat = spark.createDataFrame([("a", "R1", 0), ("b", "R2", 1)], lists)
    form = workflows.report_form(four, primary, repeat)
    assert form.columns[:4] == ["record_id", "redcap_event_name", "redcap_repeat_instrument", "redcap_repeat_instance"]
    assert [(r.record_id, r.redcap_repeat_instance, r.sample_id) for r in form.collect()] == [("P2", 1, "a"), ("R2", 2, "b"), (None, None, "c")]


def test_prefixes_of_different_lengths(spark):
    samples = spark.createDataFrame([("22A",), ("22A1",), ("9",), ("zz",)], "sample_id string")
    files = spark.createDataFrame([("22A1-x.csv",), ("22A-b.csv",), ("22A-a.csv",), ("9",)], "file_name string")
    got = {r.sample_id: r.file_name for r in collate.prefix_match(samples, files).collect()}
    assert got == {"22A": "22A-a.csv", "22A1": "22A1-x.csv", "9": "9"}


def test_channel_cut_offs(spark):
    image = spark.createDataFrame([(1, 0, c, v, 100, 200) for c, v in enumerate((10, 12, 11, 200, 210, 205))], "slide_id int, row int, col int, r int, g int, b int")
    assert pixels.otsu_threshold(image, "r").first().threshold == 12
    by_saturation = pixels.channel_mask(image, {"S": "otsu"}).filter("fg").count()
    assert 0 < by_saturation < 6
    with pytest.raises(ValueError):
        pixels.channel_mask(image, {})


def test_named_cut_offs_match_histogram_loops(spark):
    rng = np.random.default_rng(8)
    data = {1: np.concatenate([rng.normal(60, 9, 300), rng.normal(170, 20, 200)]).clip(0, 255).astype(int),
            2: rng.integers(10, 90, 150), 3: np.full(5, 7)}
    rows = [(s, int(v)) for s, values in data.items() for v in values]
    image = spark.createDataFrame(rows, "slide_id int, r int")
    got = {name: {r.slide_id: r.threshold for r in pixels.NAMED[name](image, "r").collect()} for name in ("otsu", "yen", "isodata")}
    for s, values in data.items():
        low = values.min()
        counts = np.bincount(values - low).astype(float)
        centres = np.arange(low, values.max() + 1).astype(float)
        if len(counts) == 1:
            assert all(got[n][s] == low for n in got)
            continue
        n1, total = np.cumsum(counts)[:-1], counts.sum()
        s1, whole = np.cumsum(counts * centres)[:-1], (counts * centres).sum()
        m1, m2 = s1 / n1, (whole - s1) / (total - n1)
        assert got["otsu"][s] == centres[np.argmax(np.round(n1 * (total - n1) * (m1 - m2) ** 2, 6))]
        p = counts / total
        q1, q2 = np.cumsum(p ** 2)[:-1], (p ** 2).sum() - np.cumsum(p ** 2)[:-1]
        share = np.cumsum(p)[:-1]
        assert got["yen"][s] == centres[np.argmax(np.round(np.log((share * (1 - share)) ** 2 / (q1 * q2)), 6))]
        distance = (m1 + m2) / 2 - centres[:-1]
        assert got["isodata"][s] == centres[:-1][(distance >= 0) & (distance < 1)][0]


def test_segmentation_finds_two_discs(spark):
    cells = [(1, r, c, *((150, 80, 140) if (r - 15) ** 2 + (c - 15) ** 2 <= 49 or (r - 15) ** 2 + (c - 60) ** 2 <= 36 else (240, 240, 242)))
             for r in range(32) for c in range(80)]
    image = spark.createDataFrame(cells, "slide_id int, row bigint, col bigint, r int, g int, b int")
    sizes = spark.createDataFrame([(1, 80, 32)], "slide_id int, width bigint, height bigint")
    mask, boxes = workflows.segment(image, sizes, remove_pens=False, min_pixel_count=10, max_dist=20)
    found = sorted((r.cluster, r.min_col, r.max_col, r.members) for r in boxes.collect())
    assert found == [(0, 5, 26, 1), (1, 51, 70, 1)]
    assert mask.select("cluster").distinct().count() == 2


def test_repeated_writes_add_nothing(spark, tmp_path):
    tiles = spark.createDataFrame([("he", "v1", 1, 7, 0.5), ("he", "v1", 2, 8, 0.25)], "stain string, model_ver string, slide_id int, tile_id int, score double")
    for _ in range(2):
        tables.write_predictions(tiles, str(tmp_path / "p"))
    assert tables.read_predictions(spark, str(tmp_path / "p")).count() == 2
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "slide_id int, line_no int, line string")
    for _ in range(2):
        annotations.write_lines(lines, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 3
    for n in (1, 2):
        tables.write_results(spark.createDataFrame([(i,) for i in range(n)], "slide_id int"), str(tmp_path / "r"), "he", F.to_date(F.lit("2024-01-05")))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_small_scores_have_no_exponent(spark):
    rows = spark.createDataFrame([(0.0001,), (0.00012,), (0.5,), (1.0,), (1e-9,)], "x double")
    got = [r[0] for r in rows.select(annotations.plain_number(F.col("x"))).collect()]
    assert got == ["0.0001", "0.00012", "0.5", "1.0", "0.000000001"]


def _study(spark):
    tiles = spark.createDataFrame(
        [(s, s * 100 + i, i * 8, 0, [float(i), float(s)]) for s in (1, 2, 3) for i in range(6)],
        "slide_id int, tile_id int, x bigint, y bigint, features array<double>")
    sets = spark.createDataFrame([(s, 8) for s in (1, 2, 3)], "slide_id int, patch_size int")
    slides = spark.createDataFrame([(s, f"{s} P {s}.ndpi") for s in (1, 2, 3, 4)], "slide_id int, slide_name string")
    return tiles, sets, slides


def test_a_scoring_run_resumes_and_then_does_nothing(spark, tmp_path):
    from tilewright.sources import ledger

    tiles, sets, slides = _study(spark)
    store, book = str(tmp_path / "store"), str(tmp_path / "ledger")

    def factory():
        return lambda x: np.stack([x[:, 0] * 4, *[x[:, 0] * 0] * 2], axis=1)

    from tilewright import config

    def head():
        n = len(config.settings("p53")["classes"])
        return lambda x: np.stack([x[:, 0] * 4, *[x[:, 0] * 0] * (n - 1)], axis=1)

    def broken():
        def fail(x):
            raise ValueError("no model")
        return fail

    with pytest.raises(Exception):
        workflows.score_run(tiles, sets, slides, broken, "p53", "v1", store, book)
    assert ledger.latest(spark, book, "score p53 v1").count() == 0
    first = workflows.score_run(tiles, sets, slides.filter("slide_id < 3"), head, "p53", "v1", store, book)
    one = sorted(map(str, first.collect()))
    stored = tables.read_predictions(spark, store).count()
    assert stored == 12 and {r.slide_id: r.status for r in ledger.latest(spark, book, "score p53 v1").collect()} == {"1": "processed", "2": "processed"}
    again = workflows.score_run(tiles, sets, slides.filter("slide_id < 3"), broken, "p53", "v1", store, book)  # nothing is scored
    assert sorted(map(str, again.collect())) == one
    workflows.score_run(tiles, sets, slides, head, "p53", "v1", store, book).collect()
    assert tables.read_predictions(spark, store).count() == 18
    book_now = {r.slide_id: (r.status, r.attempt) for r in ledger.latest(spark, book, "score p53 v1").collect()}
    assert book_now == {"1": ("processed", 1), "2": ("processed", 1), "3": ("processed", 1), "4": ("no_output", 1)}
    # stored but not entered, as when a run breaks off in between
    lost = str(tmp_path / "other-ledger")
    workflows.score_run(tiles, sets, slides, head, "p53", "v1", store, lost).collect()
    assert tables.read_predictions(spark, store).count() == 18 and ledger.latest(spark, lost, "score p53 v1").count() == 4


def test_a_tiling_run_skips_what_is_done(spark, tmp_path):
    store, book = str(tmp_path / "coords"), str(tmp_path / "ledger")
    point = "array<struct<x: bigint, y: bigint>>"
    contours = spark.createDataFrame([(s, 0, [(0, 0), (30, 0), (30, 30), (0, 30)]) for s in (1, 2)], f"slide_id int, cont_idx bigint, points {point}")
    pyramid = spark.createDataFrame([(s, [(100, 100, 1.0)]) for s in (1, 2, 3)], "slide_id int, levels array<struct<w: bigint, h: bigint, downsample: double>>")
    slides = spark.createDataFrame([(1,), (2,), (3,)], "slide_id int")
    for only, statuses in (("slide_id = 1", ["tbp"]), ("slide_id > 0", ["already_exist", "tbp", "tbp"]), ("slide_id > 0", ["already_exist"] * 3)):
        listing = workflows.tile_run(contours, pyramid, slides.filter(only), store, book, 8, 8, test="basic")
        assert [r.status for r in listing.orderBy("slide_id").collect()] == statuses
    tiles = tables.read_coords(spark, store)
    assert {(r.slide_id, r["count"]) for r in tiles.groupBy("slide_id").count().collect()} == {(1, 16), (2, 16)}


def test_stores_read_only_the_folders_they_write_to(spark, tmp_path):
    path = str(tmp_path / "bag")
    rows = spark.createDataFrame([(i % 40, i, 0, bytearray(b"x")) for i in range(400)] + [(None, 1, 1, bytearray(b"y"))], "slide_id int, x int, y int, img binary")
    for _ in range(2):
        tables.append_bag(rows, path)
    assert spark.read.parquet(path).count() == 401  # a null id is stored once
    new = tables.bucketed(rows.filter("slide_id = 7"))
    plan = tables.not_stored(new, path, ["slide_id", "x", "y"], folders=[tables.BUCKET])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slide_bucket" in plan.replace("isnotnull(slide_bucket", "slide_bucket") or "PartitionFilters: [(slide_bucket" in plan
