"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Distinct vectors are dealt by hash into shards. In a shard, vectors are put in batch by batch: a greedy
search from a few entry points proposes neighbours, relaxed distance pruning keeps a few that lie in
different directions, and edges back are pruned the same way. The graphs are stored as rows. Queries go
in blocks to every shard of their length, where a beam search walks the graph; what it finds is scored on
the original vectors in double precision, and the best over all shards stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tilewright.operators.ordering import top_rows
from tilewright.session import materialise

#: Rows of a shard, queries of a block, and components that either may hold.
SHARD, QUERIES, VALUES = 4096, 2048, 4_000_000
#: Edges of a node, nodes that a search keeps, and how much farther a pruned edge may lead.
DEGREE, BEAM, RELAX = 32, 96, 1.2
#: Nodes where a search begins, far from each other, and nodes that it expands in one step.
ENTRIES, _STEP = 48, 4


def _batch(unit: np.ndarray) -> int:
    """Nodes put in or searched at once: fewer where vectors are long."""
    return max(16, min(256, 65_536 // unit.shape[1]))


def _sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest entry first, so squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)


def beam_search(
    unit: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met by each query, nearest first, their squared distances, and the way there.

    All queries walk in step: each expands its nearest unexpanded nodes, whose unseen neighbours are
    measured and merged, until a beam holds expanded nodes only. The way are the nodes expanded that were
    pushed out of the beam later. Missing places are -1 at infinity.
    """
    n, m = len(unit), len(queries)
    found = np.full((m, beam), -1, dtype=np.int32)
    away = np.full((m, beam), np.inf, dtype=np.float64)
    opened = np.zeros((m, beam), dtype=bool)
    seen = np.zeros((m, n), dtype=bool)
    fresh = np.broadcast_to(entry.astype(np.int32), (m, len(entry)))
    live = np.arange(m)
    way: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        # Measure what is new; of repeats in a row only the first counts.
        row, column = np.nonzero(fresh >= 0)
        node = fresh[row, column]
        new = ~seen[live[row], node]
        row, column, node = row[new], column[new], node[new]
        if len(row):
            _, first = np.unique(row.astype(np.int64) * n + node, return_index=True)
            row, column, node = row[first], column[first], node[first]
        seen[live[row], node] = True
        d = np.full(fresh.shape, np.inf, dtype=np.float64)
        apart = queries[live[row]] - unit[node]  # differences keep near copies apart where products would not
        d[row, column] = np.einsum("ij,ij->i", apart, apart)
        names = np.where(np.isfinite(d), fresh, -1)
        names, d = np.hstack([found[live], names]), np.hstack([away[live], d])
        done = np.hstack([opened[live], np.zeros(fresh.shape, dtype=bool)])
        order = np.argsort(d, axis=1, kind="stable")
        best, rest = order[:, :beam], order[:, beam:]
        out, place = np.nonzero(np.take_along_axis(done, rest, 1))
        way.append((live[out], names[out, rest[out, place]]))
        found[live], away[live] = np.take_along_axis(names, best, 1), np.take_along_axis(d, best, 1)
        opened[live] = np.take_along_axis(done, best, 1)
        # The nearest unexpanded nodes of each beam.
        waiting = (found[live] >= 0) & ~opened[live]
        live = live[waiting.any(axis=1)]
        if not len(live):
            break
        waiting = (found[live] >= 0) & ~opened[live]
        turn = np.argsort(~waiting, axis=1, kind="stable")[:, :_STEP]
        valid = np.take_along_axis(waiting, turn, 1)
        nodes = np.where(valid, np.take_along_axis(found[live], turn, 1), -1)
        at, place = np.nonzero(valid)
        opened[live[at], turn[at, place]] = True
        fresh = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(live), -1)
    return found, away, _rows(np.concatenate([q for q, _ in way]), np.concatenate([x for _, x in way]), m)


def _rows(row: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """Values by their row, as a matrix padded with -1."""
    by = np.argsort(row, kind="stable")
    row, value = row[by], value[by]
    many = np.bincount(row, minlength=count)
    out = np.full((count, int(many.max(initial=0))), -1, dtype=np.int32)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = value
    return out


def _distances(unit: np.ndarray, owners: np.ndarray, names: np.ndarray) -> np.ndarray:
    apart = unit[np.maximum(names, 0)] - unit[owners][:, None, :]
    return np.einsum("ikj,ikj->ik", apart, apart)


def entry_points(unit: np.ndarray, count: int) -> np.ndarray:
    """The node nearest to the mean, then each time the one farthest from those taken."""
    taken = [int(np.argmax(unit @ unit.mean(axis=0)))]
    nearest = unit @ unit[taken[0]]
    while len(taken) < min(count, len(unit)):
        taken.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
    return np.unique(np.array(taken, dtype=np.int32))


def robust_prune(unit: np.ndarray, owners: np.ndarray, names: np.ndarray, away: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` diverse candidates per owner, from rows of candidates with squared distances.

    The nearest candidate left is kept; it strikes out those that are nearer to it, by the factor
    ``relax``, than to the owner. Places that stay free take the nearest of those struck out, so a
    group of near copies does not lose its ways out. Missing candidates are -1.
    """
    away = np.where((names < 0) | (names == owners[:, None]), np.inf, away)
    order = np.argsort(away, axis=1, kind="stable")
    names, away = np.take_along_axis(names, order, 1), np.take_along_axis(away, order, 1)
    twice = np.zeros(names.shape, dtype=bool)  # a candidate given twice stands at one distance
    by_name = np.argsort(names, axis=1, kind="stable")
    sorted_names = np.take_along_axis(names, by_name, 1)
    np.put_along_axis(twice, by_name[:, 1:], sorted_names[:, 1:] == sorted_names[:, :-1], 1)
    alive = np.isfinite(away) & ~twice
    usable = alive.copy()
    vectors = unit[np.maximum(names, 0)] - unit[owners][:, None, :]
    square = np.einsum("ikj,ikj->ik", vectors, vectors)
    between = square[:, :, None] + square[:, None, :] - 2.0 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    covered = relax * relax * between <= away[:, None, :]
    kept = np.zeros(names.shape, dtype=bool)
    rows = np.arange(len(names))
    for _ in range(min(degree, names.shape[1])):
        pick = np.argmax(alive, axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        kept[rows[some], pick[some]] = True
        alive[some] &= ~covered[rows[some], pick[some]]
        alive[rows[some], pick[some]] = False
    rank = np.argsort(np.where(kept, 0, np.where(usable, 1, 2)), axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(usable, rank, 1), np.take_along_axis(names, rank, 1), -1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1).astype(np.int32)


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
    """Edges of every node (-1 where there is none) and the entry points."""
    n = len(unit)
    edges = np.full((n, degree), -1, dtype=np.int32)
    entry = entry_points(unit, ENTRIES)
    order = np.concatenate([entry, np.setdiff1d(np.arange(n), entry)]).astype(np.int32)
    at, size = len(entry), len(entry)
    edges[entry] = robust_prune(unit, entry, *_all(unit, entry), degree, relax)
    while at < n:
        batch = order[at:at + size]
        at, size = at + len(batch), min(2 * size, _batch(unit))
        names, away, way = beam_search(unit, edges, entry, unit[batch], beam)
        names, away = np.hstack([names, way]), np.hstack([away, _distances(unit, batch, way)])
        edges[batch] = robust_prune(unit, batch, names, away, degree, relax)
        # Edges back: what a node gets from the batch joins its own edges, and all are pruned.
        source = np.repeat(batch, degree)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hosts, first, counts = np.unique(target, return_index=True, return_counts=True)
        for cut in range(0, len(hosts), 64):
            mine, begin, many = hosts[cut:cut + 64], first[cut:cut + 64], counts[cut:cut + 64]
            place = np.arange(many.max())[None, :]
            got = np.where(place < many[:, None], source[np.minimum(begin[:, None] + place, len(source) - 1)], -1)
            names = np.hstack([edges[mine], got])
            edges[mine] = robust_prune(unit, mine, names, _distances(unit, mine, names), degree, relax)
    return edges, entry


def _all(unit: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node as a candidate of every other."""
    names = np.broadcast_to(nodes, (len(nodes), len(nodes)))
    return names, _distances(unit, nodes, names)


def _blocks(rows: DataFrame, size: int) -> int:
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dim").alias("values")).first()
    return max(1, -(-seen.n // size), -(-(seen.values or 0) // VALUES))


def _named(vectors: DataFrame) -> DataFrame:
    """``id, key, dim, vec`` of the vectors that take part; ``key`` tells different vectors apart."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & _sound(F.col("vec")))
    plain = F.transform("vec", lambda x: x.cast("double") + F.lit(0.0))  # one kind of zero
    return rows.withColumns({"dim": F.size("vec"), "key": F.concat(F.hex(F.xxhash64(plain)), F.hex(F.xxhash64(plain, F.lit(1))))})


def build_index(vectors: DataFrame, k: int, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> DataFrame:
    """The graph of every shard as rows: ``dim, shard, node, key, ids, vec, edges, entry``.

    Equal vectors are one node with the ``k + 1`` smallest of their ids, which are all that a search
    for ``k`` can return of them.
    """
    named = _named(vectors)
    one = top_rows(named.select("key", "id").distinct(), ["key"], [F.col("id")], k + 1)
    ids = one.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    items = materialise(named.groupBy("key", "dim").agg(F.first("vec").alias("vec")).join(ids, "key"), "graph-items")
    shards = _blocks(items, SHARD)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        edges, entry = build_graph(_unit(_matrix(rows.column("vec"))), degree, beam, relax)
        lists = pa.ListArray.from_arrays(np.arange(0, edges.size + 1, edges.shape[1]), pa.array(edges.ravel()))
        return pa.table({
            "dim": rows.column("dim"), "shard": rows.column("shard"), "node": pa.array(np.arange(len(rows)), pa.int32()),
            "key": rows.column("key"), "ids": rows.column("ids"), "vec": rows.column("vec"), "edges": lists,
            "entry": pa.array(np.isin(np.arange(len(rows)), entry))})

    kind = items.schema["vec"].dataType.simpleString()
    return materialise(dealt.groupBy("dim", "shard").applyInArrow(
        build, f"dim int, shard int, node int, key string, ids array<bigint>, vec {kind}, edges array<int>, entry boolean"), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query by cosine, ties to the smaller id.

    ``queries`` are rows as of the index's vectors. Each block of queries meets each shard once.
    """
    asked = materialise(_named(queries).dropDuplicates(["id", "key"]), "graph-queries")
    blocks, shards = _blocks(asked, QUERIES), 1 + (index.agg(F.max("shard").alias("s")).first().s or 0)
    right = asked.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    task = ["dim", "shard", "block"]
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.string()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def walk(key: tuple, graph: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if graph.num_rows and block.num_rows:
            graph = graph.sort_by("node")
            x = _matrix(graph.column("vec"))
            unit = _unit(x)
            edges = graph.column("edges").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            entry = np.flatnonzero(graph.column("entry").to_numpy())
            ids = graph.column("ids").to_pylist()
            q = _matrix(block.column("vec"))
            names, keys = block.column("id").to_pylist(), block.column("key").to_pylist()
            step = _batch(unit)
            for at in range(0, len(q), step):
                found, *_ = beam_search(unit, edges, entry, _unit(q[at:at + step]), beam)
                for i, nodes in enumerate(found, at):
                    nodes = nodes[nodes >= 0]
                    near = sorted(
                        ((s, other) for s, node in zip(cosines(q[i], x[nodes]), nodes) for other in ids[node] if other != names[i]),
                        key=lambda p: (-p[0], p[1]))[:k]
                    out += [(names[i], keys[i], other, s) for s, other in near]
        columns = list(zip(*out)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    found = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(
        walk, "query_id long, query_key string, vec_id long, score double")
    best = top_rows(found, ["query_id", "query_key"], [F.col("score").desc(), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def cosines(query: np.ndarray, rows: np.ndarray) -> list[float]:
    """Cosine of ``query`` with each row, summed in order; vectors are scaled where squares would overflow or vanish."""
    def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumsum(a * b, axis=1)[:, -1]

    with np.errstate(over="ignore", under="ignore"):
        q = np.broadcast_to(query, rows.shape)
        square, own = sums(rows, rows), sums(q, q)
        odd = ~((square * own > 1e-200) & (square * own < 1e200))
        if odd.any():
            rows, q = rows / np.abs(rows).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
            square, own = sums(rows, rows), sums(q, q)
        return np.clip(sums(rows, q) / np.sqrt(square * own), -1.0, 1.0).tolist()


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    All rows are indexed. A vector that is null, empty, zero or holds a null or non-finite component
    takes no part, nor does a row without an id; vectors of other lengths do not meet. Rows that repeat id
    and vector count once; rows that share an id are candidates of their own, but not of that id's queries,
    which are ranked vector by vector. No rows give no rows. Not lazy: steps are stored in the shared folder.
    """
    return search(build_index(vectors, k, degree, beam, relax), vectors.filter(F.col("vec_id").cast("long") % every == 0), k, beam)
