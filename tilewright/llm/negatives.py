"""Hard negatives by bounds along spanning trees of the anchors.

Anchors form groups, and each group a minimum spanning tree by distance. A block of candidates is scored
against a tree's root; below it, the score of a child differs from its parent's by at most the length of
the edge times the norm of the candidate (Cauchy and Schwarz), so the parent's scores, plus or minus that,
bound the child's. Only candidates whose bounds reach the window that is asked for are scored again.
Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tilewright.operators.ordering import top_rows
from tilewright.session import materialise

#: Rows of a block of candidates, anchors of a tree, and components that either may hold.
BLOCK, TREE, VALUES = 4096, 256, 4_000_000
#: Below this, sums of products in doubles are exact integers.
_EXACT = float(1 << 52)
_SCORES = "dim int, anchor long, anchor_key long, id long, row_key long, score decimal(38,0)"


def _sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks] or [pa.array([], pa.float64())])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _whole(x: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` in Python's integers; numbers of 2^52 and more are whole already."""
    number = lambda v: int(v) * 256 if abs(v) >= 1 << 52 else int(np.floor(256.0 * v))
    out = np.empty(x.shape, dtype=object)
    out.ravel()[:] = [number(v) for v in x.ravel().tolist()]
    return out


def spanning_tree(x: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Rows in the order of Prim's algorithm, their parents (-1 for the first) and edge lengths."""
    n = len(x)
    square = (x * x).sum(axis=1)
    away = np.full(n, np.inf)
    parent = np.full(n, -1)
    left = np.ones(n, dtype=bool)
    order, edges, at = [], [], 0
    for _ in range(n):
        order.append(at)
        edges.append(0.0 if parent[at] < 0 else float(np.sqrt(((x[at] - x[parent[at]]) ** 2).sum())))
        left[at] = False
        d = np.maximum(square + square[at] - 2.0 * (x @ x[at]), 0.0)
        nearer = left & (d < away)
        away[nearer], parent[nearer] = d[nearer], at
        at = int(np.argmin(np.where(left, away, np.inf)))
    return order, parent.tolist(), edges


class _Walk:
    """Scores and bounds of one block of candidates along a tree of anchors."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            a, x = np.floor(256.0 * anchors), np.floor(256.0 * rows)
            norms = np.sqrt((x * x).sum(axis=1))
            most = np.sqrt((a * a).sum(axis=1)).max(initial=0.0) * norms.max(initial=0.0)
        # Below 2^52 every partial sum of products is a whole double; else each anchor is a root.
        self.exact = bool(most < _EXACT)
        self.anchors, self.rows = (a, x) if self.exact else (_whole(anchors), _whole(rows))
        self.norms = norms * (1 + 1e-9)
        alone = list(range(len(a))), [-1] * len(a), [0.0] * len(a)
        self.order, self.parent, self.edges = spanning_tree(a) if self.exact else alone
        last = {self.parent[anchor]: i for i, anchor in enumerate(self.order)}
        self._last_child = {p: i for p, i in last.items() if p >= 0}
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def score(self, anchor: int, at: np.ndarray | slice) -> np.ndarray:
        return self.rows[at] @ self.anchors[anchor]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Anchors, parents first, with bounds of all rows; the caller may tighten them in place."""
        for i, anchor in enumerate(self.order):
            parent = self.parent[anchor]
            if parent < 0:
                low = self.score(anchor, slice(None))
                high = low.copy()
            else:
                reach = self.edges[i] * self.norms * (1 + 1e-9) + 1.0
                low, high = self._bounds[parent][0] - reach, self._bounds[parent][1] + reach
            if anchor in self._last_child:
                self._bounds[anchor] = low, high
            yield anchor, low, high
            if parent >= 0 and self._last_child.get(parent) == i:
                del self._bounds[parent]

    def rescore(self, anchor: int, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of the rows ``at``, which also become their bounds."""
        open_ = at[low[at] != high[at]]
        if len(open_):
            low[open_] = high[open_] = self.score(anchor, open_)
        return low[at]


def _at_least(low: np.ndarray, k: int) -> object:
    """A value that the ``k`` best of rows with these lower bounds reach for sure."""
    if len(low) < k:
        return -np.inf
    return sorted(low)[-k] if low.dtype == object else np.partition(low, len(low) - k)[len(low) - k]


def _shortlist(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: higher scores first, ties to the smaller id."""
    can = np.flatnonzero(scores >= _at_least(scores, k))
    if scores.dtype == object:
        return np.array(sorted(can, key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return can[np.lexsort((ids[can], -scores[can]))[:k]]


def _columns(table: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    return (table.column("id").to_numpy(), table.column("row_key").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vec"), dim))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


_NUMBER = pa.decimal128(38, 0)


def _decimal(value: object) -> object:
    from decimal import Decimal

    most = 10 ** 38 - 1
    return Decimal(max(-most, min(most, int(value))))


def prepared(vectors: DataFrame) -> DataFrame:
    """``id, row_key, label, vec, dim`` of the rows that take part, each distinct row once."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec"))
    sound = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _sound(F.col("vec")))
    named = sound.withColumns({"dim": F.size("vec"), "row_key": F.xxhash64("label", "vec")})
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return named.withColumn("label", label).dropDuplicates(["id", "row_key"]).select("dim", "id", "row_key", "label", "vec")


def _blocks(rows: DataFrame, size: int) -> int:
    """How many blocks keep about ``size`` rows and VALUES components each."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dim").alias("values")).first()
    return max(1, -(-seen.n // size), -(-(seen.values or 0) // VALUES))


def _dealt(rows: DataFrame, blocks: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", "row_key", F.lit(salt)), F.lit(blocks)).cast("int")


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, embedding, label``.

    Anchors are the rows whose id is divisible by ``every``. A row's score is its integer inner product
    with the anchor; positives are an anchor's ``positives`` best other rows of its label, and for each of
    them the ``negatives`` best rows of other labels with ``low`` to ``high`` per cent of its score
    follow. Ties go to the smaller id. A row without an id, label or sound vector takes no part; an
    empty vector scores nought. Rows that agree in everything count once, rows that share an id are rows
    of their own but not of their own anchor. Vectors of other lengths do not meet. Scores are
    whole numbers of up to 38 digits, beyond which they count as equal; one beyond 64 bits is reported as
    the nearest long. No anchors give no rows. Not lazy: steps
    are stored in the shared folder.
    """
    rows = materialise(prepared(vectors), "negative-rows")
    anchors = rows.filter(F.col("id") % every == 0)
    blocks, trees = _blocks(rows, BLOCK), _blocks(anchors, TREE)
    right = rows.withColumn("block", _dealt(rows, blocks, 1)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    left = anchors.withColumn("tree", _dealt(anchors, trees, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    task = ["dim", "tree", "block"]

    wanted = pa.schema([("dim", pa.int32()), ("anchor", pa.int64()), ("anchor_key", pa.int64()), ("id", pa.int64()), ("row_key", pa.int64()), ("score", _NUMBER)])

    def same_label(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        out: list[tuple] = []
        if ours.num_rows and theirs.num_rows:
            a_id, a_key, a_label, a = _columns(ours, dim)
            id_, row_key, label, x = _columns(theirs, dim)
            walk = _Walk(a, x)
            for i, lo, hi in walk:
                mine = np.flatnonzero((label == a_label[i]) & (id_ != a_id[i]))
                at = mine[hi[mine] >= _at_least(lo[mine], positives)]
                score = walk.rescore(i, lo, hi, at)
                for j in _shortlist(score, id_[at], positives):
                    out.append((dim, int(a_id[i]), int(a_key[i]), int(id_[at[j]]), int(row_key[at[j]]), _decimal(score[j])))
        return _table(out, wanted)

    found = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(same_label, _SCORES)
    anchor = ["dim", "anchor", "anchor_key"]
    chosen = materialise(top_rows(found, anchor, [F.col("score").desc(), F.col("id"), F.col("row_key")], positives, "place"), "negative-positives")
    asked = chosen.groupBy(*anchor).agg(F.collect_list(F.struct("score", "place", "id")).alias("asked"))  # ``positives`` at most
    led = left.join(asked.withColumnsRenamed({"anchor": "id", "anchor_key": "row_key"}), ["dim", "id", "row_key"])
    led = led.select(*[F.col(c).alias(c) for c in led.columns])  # else both sides of the cogroup name the same columns

    pairs = pa.schema([
        ("anchor", pa.int64()), ("anchor_key", pa.int64()), ("place", pa.int64()), ("positive", pa.int64()), ("positive_score", _NUMBER),
        ("id", pa.int64()), ("row_key", pa.int64()), ("score", _NUMBER)])

    def other_labels(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        out: list[tuple] = []
        if ours.num_rows and theirs.num_rows:
            a_id, a_key, a_label, a = _columns(ours, dim)
            id_, row_key, label, x = _columns(theirs, dim)
            windows = ours.column("asked").to_pylist()
            walk = _Walk(a, x)
            for i, lo, hi in walk:
                other = np.flatnonzero(label != a_label[i])
                olo, ohi = lo[other], hi[other]
                for ask in windows[i]:
                    top = int(ask["score"])
                    if top < 0:
                        continue  # the window of a negative score is empty
                    # 100 s >= 80 p, as a bound on the integer s
                    floor, roof = -(-low * top // 100), high * top // 100
                    if walk.exact:
                        floor, roof = float(floor), float(roof)
                    sure = _at_least(olo[(olo >= floor) & (ohi <= roof)], negatives)
                    at = other[(ohi >= max(floor, sure)) & (olo <= roof)]
                    score = walk.rescore(i, lo, hi, at)
                    olo, ohi = lo[other], hi[other]
                    inside = np.flatnonzero((score >= floor) & (score <= roof))
                    for j in inside[_shortlist(score[inside], id_[at[inside]], negatives)]:
                        out.append((
                            int(a_id[i]), int(a_key[i]), ask["place"], ask["id"], ask["score"], int(id_[at[j]]), int(row_key[at[j]]), _decimal(score[j])))
        return _table(out, pairs)

    met = led.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(
        other_labels, "anchor long, anchor_key long, place long, positive long, positive_score decimal(38,0), id long, row_key long, score decimal(38,0)")
    best = top_rows(met, ["anchor", "anchor_key", "place"], [F.col("score").desc(), F.col("id"), F.col("row_key")], negatives)

    def as_long(c: str) -> Column:
        return F.greatest(F.least(F.col(c), F.lit(2 ** 63 - 1)), F.lit(-(2 ** 63))).cast("long").alias(f"{c}")

    return best.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), as_long("positive_score"), as_long("score").alias("negative_score"))
