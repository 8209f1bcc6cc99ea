"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order. Vectors are retrieved through inverted
lists: each list holds the vectors that have a given set of ``shared`` pivots among their ``nearest``,
so meeting in a list means sharing that many pivots. What meets is verified by exact cosine in double
precision. A list is cut into blocks, so no task holds more than two of them; tasks send link counts
and a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tilewright.operators.components import connected_components
from tilewright.session import materialise, shuffle_width

#: Members of a list that one task compares at once with another such block.
BLOCK = 2048
#: Vector lengths that get an index of their own; vectors of rarer lengths meet in one list per length.
DIMENSIONS = 16


def _sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _identity(vector: Column) -> Column:
    return F.concat(F.hex(F.xxhash64(vector)), F.lit("-"), F.hex(F.xxhash64(vector, F.lit(1))))


def choose_pivots(items: DataFrame, pivots: int, sample: int, apart: float) -> dict[int, np.ndarray]:
    """At most ``pivots`` reference points per vector length, from a fixed sample of ``sample`` vectors.

    Points closer than cosine ``apart`` to one already taken are passed over: a dense group of vectors
    yields one pivot, and near vectors do not differ by which of many close pivots is nearest.
    """
    sizes = [r.dim for r in items.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "dim").limit(DIMENSIONS).collect()]
    out = {}
    for dim in sizes:
        rows = items.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec")
        points = _unit(np.array(rows.to_pylist(), dtype=np.float64))
        taken: list[int] = []
        for i in range(len(points)):
            if len(taken) == pivots:
                break
            if not taken or (points[taken] @ points[i]).max() < apart:
                taken.append(i)
        out[dim] = points[taken]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest entry first, so squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivot_lists(items: DataFrame, points: dict[int, np.ndarray], nearest: int, shared: int) -> DataFrame:
    """``id, dim, list, top``: the lists of every vector, and its nearest pivots by number.

    ``list`` numbers the set of ``shared`` pivots; vectors without pivots of their length, or with
    fewer than ``shared``, are all in list -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            dims = batch.column(1).to_numpy()
            rows: list[np.ndarray] = []
            names, kinds, lists, tops = [], [], [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                mine = points.get(int(dim))
                if mine is None or len(mine) < shared:
                    names += ids[at].tolist()
                    kinds += [int(dim)] * len(at)
                    lists += [-1] * len(at)
                    tops += [[]] * len(at)
                    continue
                k = min(nearest, len(mine))
                x = _unit(np.array(batch.column(2).take(pa.array(at)).to_pylist(), dtype=np.float64))
                near = np.argsort(-(x @ mine.T), axis=1, kind="stable")[:, :k]
                top = np.sort(near, axis=1)
                for chosen in combinations(range(k), shared):
                    number = np.zeros(len(at), dtype=np.int64)
                    for c in chosen:
                        number = number * (len(mine) + 1) + top[:, c]
                    rows.append(number)
                    names += ids[at].tolist()
                    kinds += [int(dim)] * len(at)
                    lists += number.tolist()
                    tops += top.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(kinds, pa.int32()), pa.array(lists, pa.int64()), pa.array(tops, pa.list_(pa.int32()))],
                names=["id", "dim", "list", "top"])

    return items.select("id", "dim", "vec").mapInArrow(run, "id string, dim int, list long, top array<int>")


def _first_shared(top_a: np.ndarray, top_b: np.ndarray, shared: int, base: int) -> np.ndarray:
    """Number of the first list that each pair of rows has in common."""
    common = (top_a[:, :, None] == top_b[:, None, :]).any(axis=2)
    order = np.argsort(~common, axis=1, kind="stable")[:, :shared]
    chosen = np.take_along_axis(top_a, order, axis=1)
    number = np.zeros(len(chosen), dtype=np.int64)
    for c in range(shared):
        number = number * base + chosen[:, c]
    return number


def _compare(rows: list[dict], cosine: float, shared: int, base: dict[int, int]) -> Iterator[tuple[str, str | None, int]]:
    """Link counts (no partner) and forest edges (count zero) of one list or pair of its blocks."""
    lo, hi = rows[0]["lo"], rows[0]["hi"]
    one = [r for r in rows if r["block"] == lo]
    two = one if lo == hi else [r for r in rows if r["block"] == hi]
    if not one or not two or len(rows) < 2:
        return
    number, dim = rows[0]["list"], rows[0]["dim"]
    x, y = (_unit(np.array([r["vec"] for r in side], dtype=np.float64)) for side in (one, two))
    ids = [r["id"] for r in one] + ([] if lo == hi else [r["id"] for r in two])
    shift = 0 if lo == hi else len(one)
    weight = np.array([r["n"] for r in one] + ([] if lo == hi else [r["n"] for r in two]), dtype=np.int64)
    top_one, top_two = (np.array([r["top"] for r in side], dtype=np.int64) for side in (one, two))
    links = np.zeros(len(ids), dtype=np.int64)
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, len(one), 128):
        a, b = np.nonzero(x[at:at + 128] @ y.T >= cosine)
        a = a + at
        if lo == hi:
            a, b = a[a < b], b[a < b]
        for cut in range(0, len(a), 100_000):
            i, j = a[cut:cut + 100_000], b[cut:cut + 100_000]
            mine = slice(None) if number < 0 else _first_shared(top_one[i], top_two[j], shared, base[dim]) == number
            p, q = i[mine], j[mine] + shift
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            # edges of a row to all its partners: the forest needs only those that join two trees
            for u, v in zip(p.tolist(), q.tolist()):
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
    for i, name in enumerate(ids):
        if links[i]:
            yield name, None, int(links[i])
        if parent[i] != i:
            yield name, ids[root(i)], 0


def near_vectors(
    embeddings: DataFrame, cosine: float = 0.95, pivots: int = 256, nearest: int = 8, shared: int = 3, sample: int = 4096, apart: float = 0.7
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings`` (``vec_id, embedding``).

    Linked are vectors of one length whose cosine reaches ``cosine``. A vector that is null, empty,
    zero or holds a null or non-finite component links with nothing and names its own component.
    Equal vectors are one item with a count, so copies are linked without meeting. A null id keeps its
    row and names no component. Pivots come from a sample of at most ``sample`` vectors; every row is
    indexed. Not lazy: steps are stored in the shared folder.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vec"))
    rows = rows.withColumn("id", F.when(_sound(F.col("vec")), _identity(F.transform("vec", lambda x: x + F.lit(0.0)))))
    items = materialise(
        rows.filter("id is not null").groupBy("id").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("lowest"), F.count(F.lit(1)).alias("n"))
        .withColumn("dim", F.size("vec")), "vectors")
    points = choose_pivots(items, pivots, sample, apart)
    base = {dim: len(p) + 1 for dim, p in points.items()}
    lists = materialise(pivot_lists(items, points, nearest, shared), "pivot-lists")
    sizes = lists.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = (
        lists.join(sizes, ["dim", "list"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .join(items.select("id", "vec", "n"), "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .select("dim", "list", "lo", "hi", "block", "id", "n", "top", "vec")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        key = None

        def pack(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["id", "other", "links"])

        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                now = (row["dim"], row["list"], row["lo"], row["hi"])
                if now != key:
                    if group:
                        found += _compare(group, cosine, shared, base)
                    group, key = [], now
                group.append(row)
            yield pack(found)
        if group:
            yield pack(list(_compare(group, cosine, shared, base)))

    task = ["dim", "list", "lo", "hi"]
    spread = members.repartition(shuffle_width(embeddings.sparkSession), *task).sortWithinPartitions(*task)
    found = materialise(spread.mapInArrow(verify, "id string, other string, links long"), "vector-links")
    edges = found.filter("other is not null").select(F.col("other").alias("src"), F.col("id").alias("dst")).distinct()
    grouped = connected_components(items.select("id"), lambda _: edges, [], "id", "grp")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = items.select("id", "lowest", "n").join(grouped, "id")
    heads = named.groupBy("grp").agg(F.min("lowest").alias("component_id"))
    facts = named.join(heads, "grp").join(counted, "id", "left").select(
        "id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "id").join(facts, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
