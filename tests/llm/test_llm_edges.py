"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import decontaminate, linededup, packing, pii, quality, secrets, simhash, substrings, toxicity

LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ROWS = [(1, "same text of a few words here"), (1, "same text of a few words here"), (2, "same text of a few words here"), (3, None),
        (4, ""), (5, LONG), (6, LONG), (None, "a text whose row has no id at all"), (None, None), (7, "x" * 60_000), (8, "\n\n \t\n"), (9, "\x00\x01 odd ퟿ 😀")]
BENCH = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")]
LABELS = [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0), (7, 0, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "docs": spark.createDataFrame(ROWS, "doc_id long, text string"),
        "benchmark": spark.createDataFrame(BENCH, "item_id long, text string"),
        "labels": spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")}


def _path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


OPERATORS = {
    "packing": lambda d, t: packing.pack_documents(d, _path(), 256),
    "lines": lambda d, t: linededup.line_report(d),
    "leaks": lambda d, t: decontaminate.find_leaks(d, t["benchmark"]),
    "secrets": lambda d, t: secrets.report(d),
    "personal": lambda d, t: pii.report(d),
    "simhash": lambda d, t: simhash.near_duplicates(d),
    "quality": lambda d, t: quality.classify(d, quality.fit(d, t["labels"]), F.col("host"), F.lit(None)),
    "substrings": lambda d, t: substrings.remove_repeats(d),
    "toxicity": lambda d, t: toxicity.score(d, toxicity.fit(d, t["labels"])),
}
ONE_PER_ROW = ("lines", "secrets", "personal", "simhash", "quality", "substrings", "toxicity")


def _clashing(docs):
    """Columns named like the operators' own."""
    names = ["id", "key", "fp", "grp", "component", "n", "a", "b", "t", "norm", "host", "hits", "place", "words", "p", "start", "evidence", "score"]
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, tables, name):
    docs = _clashing(tables["docs"])
    rows = OPERATORS[name](docs, tables).collect()
    if name in ONE_PER_ROW:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    if name == "packing":
        assert {r.doc_id for r in rows} == {i for i, _ in ROWS} and sum(r.doc_id == 1 for r in rows) == 2
    if name == "leaks":
        assert rows == []
    if name == "simhash":
        assert {r.component_id for r in rows if r.doc_id in (3, 4, 8)} == {3} and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    if name == "lines":
        assert {r.doc_id: r.n_removed for r in rows if r.doc_id in (1, 2, 5, 6)} == {1: 0, 2: 1, 5: 0, 6: 1}
    if name == "substrings":
        assert {r.doc_id: r.n_removed for r in rows if r.doc_id in (2, 5, 6)} == {2: 0, 5: 0, 6: 40_000}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, tables, name):
    none = {k: t.limit(0) for k, t in tables.items()}
    out = OPERATORS[name](_clashing(none["docs"]), none)
    assert out.count() == 0 and len(out.columns) > 1


def test_vectors_of_no_rows(spark):
    from tilewright.llm.pivots import near_vectors

    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, id string")).count() == 0


def test_stages(spark, tables, tmp_path):
    """Stages one after the other on the odd rows, and each on no rows; columns stay those of the documents."""
    for name in ("benchmark", "labels"):
        tables[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = tables["docs"].withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    empty = docs.limit(0)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        assert name == "packing" or docs.columns == columns
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {i for i, _ in ROWS}


def test_registered_queries_match_their_twins(spark):
    import duckdb
    import os

    from tilewright.llm.queries import query

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not mounted")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in query.oracles.items():
        wanted = con.execute(sql).df()
        got = query.queries[name](spark, sf).toPandas()
        columns = sorted(wanted.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, wanted[columns].astype(str).values))
