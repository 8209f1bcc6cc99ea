"""Catalogue entries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.plans.registry import Registry

query = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Vocabulary file that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.simhash import as_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), max_distance=4, width=4)
    return found.select("doc_id", as_hex(found.fp).alias("fingerprint"), "component_id")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_fuzzy_lines")
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.linededup import line_report

    return line_report(table(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


# All pairs by exact cosine; the closure walks from every vector to the vectors it reaches.
OP1_SQL = """
WITH RECURSIVE sound AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
    SELECT a.vec_id AS src, b.vec_id AS dst FROM sound a JOIN sound b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(src, dst) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src
), named AS (SELECT src, min(dst) AS component_id FROM reach GROUP BY src),
degrees AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN named m ON e.vec_id = m.src LEFT JOIN degrees d ON e.vec_id = d.src
"""


@query("op1_pivot_near_vectors", OP1_SQL)
def op1_pivot_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


# Windows as lists of words; a word goes if any window over it started in an earlier document.
OP9_SQL = """
WITH words AS (
    SELECT doc_id, text IS NULL AS empty,
           [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w FROM documents
), windows AS (
    SELECT doc_id, i AS start, array_to_string(w[i:i + 12], ' ') AS span
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (SELECT span, min(doc_id) AS first FROM windows GROUP BY span),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS pos
    FROM windows JOIN firsts USING (span) WHERE first < doc_id
), kept AS (
    SELECT p.doc_id, p.word, p.pos FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words) p
    ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos
), texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256
FROM words w LEFT JOIN texts t ON w.doc_id = t.doc_id
"""


@query("op9_fm_index_substrings", OP9_SQL)
def op9_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query("op8_site_quality")
def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources of ``documents``, paths their languages: the table has no finer address."""
    from pyspark.sql import functions as F

    from tilewright.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))


def _merkle_sql(levels: int, group_levels: int) -> str:
    """Every level as a relation: nodes go by eights until one is left. ``levels`` reach 8^levels leaves per group."""
    def leaf(text: str) -> str:
        fields = (f"coalesce(concat(strlen(cast({c} as varchar)), ':', cast({c} as varchar)), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
        return "sha256(concat(" + ", ".join(fields) + "))"

    # crc32 of the decimal id: each byte, then eight marks that shift one bit out.
    bits = "flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(cast(doc_id as varchar), '')])"
    crc = (f"xor(list_reduce(list_concat([4294967295], {bits}), lambda c, b: "
           "case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"leaves as (select doc_id, lang, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(lowered)} end as changed from documents)",
        "fold0 as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, coalesce(changed, leaf) as f, '' as proof from leaves)",
        "tree0 as (select lang, pos, leaf as h from fold0)"]

    def climb(tree: str, fold: str, depth: int, group: str) -> None:
        for k in range(depth):
            w = f"over (partition by {group}, pos // 8 order by pos rows between"
            ctes.append(
                f"{tree}_s{k} as (select *, count(*) over (partition by {group}) as c, coalesce(string_agg(h, '') {w} unbounded preceding and 1 preceding), '') as l, "
                f"coalesce(string_agg(h, '') {w} 1 following and unbounded following), '') as r from {tree}{k})")
            ctes.append(
                f"{tree}{k + 1} as (select {group}, pos // 8 as pos, case when max(c) > 1 then sha256(string_agg(h, '' order by pos)) else max(h) end as h "
                f"from {tree}_s{k} group by {group}, pos // 8)")
            ctes.append(
                f"{fold}{k + 1} as (select x.* replace (case when s.c > 1 then sha256(concat(s.l, x.f, s.r)) else x.f end as f, "
                f"case when s.c > 1 then concat(x.proof, s.l, s.r) else x.proof end as proof, x.pos // 8 as pos) "
                f"from {fold}{k} x join {tree}_s{k} s on x.{group} is not distinct from s.{group} and x.pos = s.pos)")

    climb("tree", "fold", levels, "lang")
    ctes.append(f"top0 as (select 0 as one, row_number() over (order by lang nulls first) - 1 as pos, h, lang from tree{levels})")
    ctes.append(
        f"up0 as (select x.doc_id, x.leaf, x.f, x.proof, 0 as one, t.pos, t.h as subroot from fold{levels} x join top0 t on x.lang is not distinct from t.lang)")
    climb("top", "up", group_levels, "one")
    return "with " + ", ".join(ctes) + (
        " select u.doc_id, u.leaf, u.subroot, t.h as root, sha256(u.proof) as proof_sha256, u.f as folded_root, u.f = t.h as verified "
        f"from up{group_levels} u, top{group_levels} t")


@query("op11_merkle_manifest", _merkle_sql(8, 4))
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.manifest import document_manifest

    return document_manifest(table(spark, sf_dir, "documents"))


# Brute force: every query against every row.
OP12_SQL = """
WITH sound AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
    FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query("op12_graph_neighbours", OP12_SQL)
def op12_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.graphs import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


# Whole numbers below 2^53 in doubles: products and sums are exact.
OP13_SQL = """
WITH rows_ AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS s
    FROM rows_ a JOIN rows_ c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, s AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.positive_score, n.s AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 80 * p.positive_score <= 100 * n.s AND 100 * n.s <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.s DESC, n.id) QUALIFY row_number() OVER w <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))
