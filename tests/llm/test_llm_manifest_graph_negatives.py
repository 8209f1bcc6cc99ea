"""Manifest, graph neighbours and hard negatives against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import graphs, manifest, negatives

DOC = "doc_id long, source string, lang string, n_chars long, text string"
VEC = "vec_id long, embedding array<double>, label int"


def _sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_leaf(row: tuple) -> str:
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return _sha(*parts)


def _plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and per leaf the siblings on its left and right from below."""
    paths = [[] for _ in leaves]
    under = [[i] for i in range(len(leaves))]
    level = leaves
    while len(level) > 1:
        up, below = [], []
        for at in range(0, len(level), 8):
            run = level[at:at + 8]
            for j in range(len(run)):
                for i in under[at + j]:
                    paths[i].append((run[:j], run[j + 1:]))
            up.append(_sha(*run))
            below.append([i for u in under[at:at + 8] for i in u])
        level, under = up, below
    return level[0], paths


def _plain_manifest(rows: list[tuple]) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, _plain_leaf(r)))
        trees[lang] = (mine, *_plain_tree([_plain_leaf(r) for r in mine]))
    root, upper = _plain_tree([trees[lang][1] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        mine, subroot, paths = trees[lang]
        for row, path in zip(mine, paths):
            path = path + upper[at]
            proof = _sha(*[s for left, right in path for s in left + right])
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if tampered else row[4]
            node = _plain_leaf((*row[:4], text))
            for left, right in path:
                node = _sha(*left, node, *right)
            out.append((row[0], _plain_leaf(row), subroot, root, proof, node, node == root))
    return out


def _check_manifest(spark, rows):
    df = spark.createDataFrame(rows, DOC).withColumns({"grp": F.lit("x"), "pos": F.lit(1), "h": F.lit(0), "block": F.lit(9)})
    got = [tuple(r) for r in manifest.document_manifest(df.repartition(3)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _plain_manifest(rows)))


def test_manifest_of_uneven_groups(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.choice(["en"] * 6 + ["de"]), len(str(i)), f"Text {i} mit Ä ß 😀 Und A-Z") for i in range(4700)]
    rows += [(9000 + i, None, None, None, None) for i in range(9)] + [(9100, "s", "fr", 0, "")]
    _check_manifest(spark, rows)


@pytest.mark.parametrize("n", [1, 8, 9, 513])
def test_manifest_sizes(spark, n):
    _check_manifest(spark, [(i, "s", "en", i, f"T{i}") for i in range(n)])


def test_manifest_odd_rows(spark):
    same = (5, "s", "en", 1, "Same Row")
    rows = [same] * 30 + [(None, "s", "en", 1, "no id"), (None, None, None, None, None), (6, "s", "", 2, "X" * 70_000), (6, "t", "en", 2, "Other")]
    _check_manifest(spark, rows + [(i, "s", f"lang{i % 70}", i, "Many Groups") for i in range(20, 300)])
    none = manifest.document_manifest(spark.createDataFrame([], DOC))
    assert none.count() == 0 and none.columns[:2] == ["doc_id", "leaf"]


def test_manifest_tamper_is_seen(spark):
    rows = [(i, "s", "en", 1, "lower only" if i % 2 else "Upper") for i in range(60)]
    got = {r.doc_id: r.verified for r in manifest.document_manifest(spark.createDataFrame(rows, DOC)).collect()}
    hit = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 0}
    assert got == {i: i % 2 == 1 or i not in hit for i in range(60)}


# ------------------------------------------------------------ vectors

def _sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _plain_nearest(rows, k=5, every=50):
    mine = {(i, tuple(v)): np.array(v, dtype=float) for i, v, *_ in rows if i is not None and _sound(v) and any(v)}
    out = {}
    for (i, key), q in mine.items():
        if i % every == 0:
            s = [(-float(q @ c / np.sqrt((q @ q) * (c @ c))), j) for (j, _), c in mine.items() if j != i and len(c) == len(q)]
            out[i, key] = sorted(s)[:k]
    return out


def _clustered(n, dim, seed, shared=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.7 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) + shared / np.sqrt(dim)


@pytest.mark.parametrize("dim,shared", [(16, 0.0), (64, 0.0), (200, 0.0), (64, 2.0)])
def test_graph_recall(spark, dim, shared, monkeypatch):
    monkeypatch.setattr(graphs, "SHARD", 1500)
    x = _clustered(6000, dim, 1, shared)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    got = {}
    for r in graphs.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    wanted = _plain_nearest([(i, v.tolist()) for i, v in enumerate(x)])
    assert set(got) == {i for i, _ in wanted} and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = [j in {v for v, _ in got[i].values()} for (i, _), best in wanted.items() for _, j in best]
    assert np.mean(hits) >= 0.95
    for i, places in got.items():  # scores are those of the originals, best first
        scores = [places[r][1] for r in range(1, 6)]
        assert scores == sorted(scores, reverse=True)
        for v, s in places.values():
            assert s == pytest.approx(x[i] @ x[v] / np.linalg.norm(x[i]) / np.linalg.norm(x[v]), abs=1e-12)


def test_graph_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8)
    near = [hot + 1e-3 * rng.normal(size=8) for _ in range(300)]
    rows = [(i, hot.tolist(), 1) for i in range(400)] + [(1000 + i, v.tolist(), 1) for i, v in enumerate(near)]
    rows += [(3000 + i, rng.normal(size=8).tolist(), 2) for i in range(300)]
    got = [tuple(r) for r in graphs.nearest(spark.createDataFrame(rows, VEC)).collect()]
    wanted = _plain_nearest(rows)
    for (i, _), best in wanted.items():
        mine = sorted((r, v) for q, r, v, _ in got if q == i)
        if i < 400:  # copies tie: the smallest ids but one's own
            assert [v for _, v in mine] == [j for j in range(6) if j != i][:5]
        assert len(mine) == 5
    hits = [any(q == i and v == j for q, _, v, _ in got) for (i, _), best in wanted.items() for _, j in best if i >= 3000]
    assert np.mean(hits) >= 0.95


ODD = [
    (0, [1.0, 0.0], 1), (50, [0.0, 0.0], 1), (100, None, 1), (150, [1.0, None], 1), (200, [float("nan"), 1.0], 1), (250, [float("inf"), 1.0], 1),
    (300, [], 1), (350, [1e300, 1e300], 2), (400, [1e-300, 0.0], 2), (450, [1.0], 3), (None, [1.0, 1.0], 1), (500, [3.0, 4.0], None),
    (550, [2.0, 1.0], 4), (550, [2.0, 1.0], 4), (600, [1.0, 5.0], 4), (600, [5.0, 1.0], 4), (1, [-1.0, 0.5], 2), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 1)]


def test_graph_odd_rows(spark):
    df = spark.createDataFrame(ODD, VEC).withColumns({n: F.lit("x") for n in ("id", "key", "shard", "dim", "vec", "ids", "node", "block")})
    got = {}
    for r in graphs.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    wanted = {}
    for (i, _), best in _plain_nearest([r for r in ODD if r[0] != 350 and r[0] != 400]).items():
        wanted.setdefault(i, []).extend((n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(best))
    assert set(got) == {0, 350, 400, 500, 550, 600} and 450 not in got  # 450 has no other vector of its length
    assert {v for rows in got.values() for _, v, _ in rows} <= {0, 1, 2, 3, 350, 400, 500, 550, 600}
    assert [v for _, v, _ in sorted(got[400])[:3]] == [0, 2, 3] and [s for *_, s in sorted(got[400])[:3]] == [1.0, 1.0, 1.0]
    assert sorted(r for r, *_ in got[600]) == sorted([1, 2, 3, 4, 5] * 2)
    assert graphs.nearest(spark.createDataFrame([], VEC)).count() == 0
    assert graphs.nearest(spark.createDataFrame([(7, [1.0, 2.0], 0)], VEC)).count() == 0


def test_robust_prune_keeps_diverse_edges():
    unit = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1], [-1, 0]], dtype=np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    names = np.array([[1, 2, 3, 4]])
    away = 2 - 2 * (unit[[0]] @ unit[names[0]].T)
    assert graphs.robust_prune(unit, np.array([0]), names, away, 2, 1.2).tolist() == [[1, 3]]


def _plain_negatives(rows, every=100):
    mine = {}
    for i, v, label in rows:
        if i is None or label is None or not _sound(v):
            continue
        e = tuple(int(x) * 256 if abs(x) >= 2 ** 52 else math.floor(256 * x) for x in v)
        mine[i, tuple(v), label] = (math.fmod(label + 1, 10) if i % 7 == 0 else label, e)
    out = []
    for (i, *_), (label, a) in mine.items():
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, e)), j, other) for (j, *_), (other, e) in mine.items() if j != i and len(e) == len(a))
        for p, j, other in [s for s in scored if s[2] == label][:5]:
            p = -p
            best = [s for s in scored if s[2] != label and 80 * p <= -100 * s[0] <= 100 * p][:5]
            out += [(i, j, n + 1, b, p, -s) for n, (s, b, _) in enumerate(best)]
    return out


@pytest.mark.parametrize("dim,spread", [(8, 1.0), (64, 1.0), (4, 1e9), (3, 1e12)])
def test_negatives_against_all_scores(spark, dim, spread, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 150)
    monkeypatch.setattr(negatives, "TREE", 6)
    rng = np.random.default_rng(4)
    x = _clustered(1500, dim, 5) * (spread if spread < 1e10 else 1) + rng.normal(size=(1500, dim)) * (0 if spread < 1e10 else spread)
    rows = [(i, (v if i % 3 else np.round(v, 1)).tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    got = [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, VEC)).collect()]
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    assert sorted(got) == sorted((*r[:4], clip(r[4]), clip(r[5])) for r in _plain_negatives(rows))


def test_negatives_of_copies(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 60)
    rng = np.random.default_rng(6)
    hot = rng.normal(size=6).tolist()
    rows = [(i, hot, i % 3) for i in range(0, 700)] + [(i, rng.normal(size=6).tolist(), i % 3) for i in range(700, 1000)]
    got = [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, VEC)).collect()]
    assert sorted(got) == sorted(_plain_negatives(rows))


def test_negatives_odd_rows(spark):
    rows = [(i * 2, v, label) for i, v, label in ODD if i is not None] + [(None, [1.0, 1.0], 1), (5, [1.5, 1.5], 1), (9, [0.5, 0.25], 3), (700, [], 1), (701, [], 2)]
    df = spark.createDataFrame(rows, VEC).withColumns({n: F.lit("x") for n in ("id", "row_key", "dim", "vec", "tree", "block", "score", "anchor")})
    got = sorted({tuple(r) for r in negatives.hard_negatives(df).collect()})
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    wanted = [r for r in _plain_negatives(rows) if max(abs(r[4]), abs(r[5])) < 10 ** 37]
    assert [r for r in got if abs(r[4]) < 2 ** 62] == sorted({(*r[:4], clip(r[4]), clip(r[5])) for r in wanted if abs(r[4]) < 2 ** 62})
    assert negatives.hard_negatives(spark.createDataFrame([], VEC)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], VEC)).count() == 0


def test_bounds_spare_scores():
    """Bounds hold, and a child's scores are computed for the rows that can reach the window only."""
    x = _clustered(4000, 8, 7) * 1000
    anchors = np.vstack([x[:1] + 0.5 * i for i in range(20)])
    walk = negatives._Walk(anchors, x)
    scored = 0
    for i, low, high in walk:
        exact = walk.rows @ walk.anchors[i]
        assert (low <= exact).all() and (exact <= high).all()
        at = np.flatnonzero(high >= np.partition(low, len(low) - 5)[len(low) - 5])
        scored += len(at)
        assert (walk.rescore(i, low, high, at) == exact[at]).all()
    assert scored < 20 * len(x) / 4
