"""Connected components: links inside a block are contracted in one pass, the rest in rounds.

Rounds alternate large-star and small-star contraction. Each is written to the shared folder and read
back: the plan stays flat, statistics stay exact, and a lost executor costs one task instead of the history
of the loop. The number of rounds grows with the logarithm of the component size. Where nodes have places,
such as image rows, links inside a block of them need no round: a task sorts and contracts the links of a
block, and only what crosses blocks is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tilewright.session import shared_folder


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store_round(edges: DataFrame, keys: list[str], path: str) -> tuple[DataFrame, tuple]:
    """Write one round; its size and digest are observed by the same job."""
    seen = Observation()
    watched = edges.observe(
        seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "u", "v")).alias("h"))
    stored = _store(watched, path)
    values = seen.get
    return stored, (values["n"], values["h"])


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it can see.

    Repeated links are left to the small star, which removes them.
    """
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.join(lowest, [*keys, "u"]).filter(F.col("v") > F.col("u"))
        .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    lowest = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))

    def link(a: Column) -> Column:
        return F.struct(a.alias("u"), F.col("m").alias("v"))

    return (
        edges.join(lowest, [*keys, "u"])
        .select(*keys, F.inline(F.array(link(F.col("v")), link(F.col("u")))))
        .filter(F.col("u") > F.col("v")).distinct()
    )


def connected_components(
    nodes: DataFrame, edges: Callable[[DataFrame], DataFrame], keys: list[str], ident: str = "id", name: str = "component", max_rounds: int = 60
) -> DataFrame:
    """``nodes`` with the smallest id of their component.

    ``edges`` turns the stored nodes into ``keys, src, dst``. Not lazy: one job per round, and the
    nodes and the result are stored, since callers use them more than once.
    """
    home = f"{shared_folder(nodes.sparkSession)}/components-{uuid.uuid4().hex}"
    nodes = _store(nodes, f"{home}/nodes")
    links = edges(nodes).select(
        *keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).filter(F.col("u") > F.col("v")).distinct()
    links, seen = _store_round(links, keys, f"{home}/round-0")
    for step in range(1, max_rounds + 1):
        if not seen[0]:
            break
        links, now = _store_round(_small_star(_large_star(links, keys), keys), keys, f"{home}/round-{step}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(*keys, F.col("u").alias(ident), F.col("v").alias("__root"))
    labelled = nodes.join(roots, [*keys, ident], "left").withColumn(
        name, F.coalesce(F.col("__root"), F.col(ident))
    ).drop("__root")
    return _store(labelled, f"{home}/labelled")


def contracted(groups: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links ``a, b`` within ``groups`` to ``link, node, root``: each node that is not the least of its component.

    ``link`` is the number of a link of the node.
    """
    group, node = np.concatenate([groups, groups]), np.concatenate([a, b])
    order = np.lexsort((node, group))
    group, node = group[order], node[order]
    new = np.ones(len(node), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1])
    code = np.empty(len(node), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    u, v = code[:len(a)], code[len(a):]
    label = np.arange(int(new.sum()))
    while True:
        left, right = label[u], label[v]
        low, after = np.minimum(left, right), label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    names = node[new]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return order[new][moved] % max(len(a), 1), names[moved], names[label[moved]]


def _contract_blocks(links: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """``keys, ident, root`` of the nodes that are not the least of their component within ``block``."""
    kept = links.select(*keys, F.xxhash64(*keys, "block").alias("__group"), "src", "dst")
    schema = StructType([*[links.schema[k] for k in keys], StructField(ident, LongType()), StructField("root", LongType())])

    def settle(batch: pa.Table) -> pa.Table:
        group, a, b = (batch.column(c).to_numpy() for c in ("__group", "src", "dst"))
        at, node, root = contracted(group, a, b)
        return pa.table({**{k: batch.column(k).take(pa.array(at)) for k in keys}, ident: node, "root": root})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            group = batch.column(len(keys)).to_numpy()
            first = int(np.argmax(group == group[-1]))  # rows of the last group in this batch begin here
            if held and held[-1].column(len(keys))[0].as_py() != group[0]:
                yield from settle(pa.Table.from_batches(held)).to_batches()
                held = []
            if first:
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, first)])).to_batches()
                held = []
            held.append(batch.slice(first))
        if held:
            yield from settle(pa.Table.from_batches(held)).to_batches()

    return kept.repartition("__group").sortWithinPartitions("__group").mapInArrow(run, schema)


def blocked_components(
    nodes: DataFrame, edges: Callable[[DataFrame], DataFrame], keys: list[str], ident: str = "id", name: str = "component"
) -> DataFrame:
    """``nodes`` with the smallest id of their component, as ``connected_components``.

    ``edges`` turns the stored nodes into ``keys, src, dst, block``; ``block`` names the block that holds
    both ends and is null for a link across. A task holds the links of a block. Not lazy: nodes, links,
    what blocks come to, rounds if links cross blocks, and the result are stored.
    """
    home = f"{shared_folder(nodes.sparkSession)}/components-{uuid.uuid4().hex}"
    nodes = _store(nodes, f"{home}/nodes")
    seen = Observation()
    links = _store(edges(nodes).select(*keys, "src", "dst", "block").observe(
        seen, F.count_if(F.col("block").isNull()).alias("across")), f"{home}/links")
    local = _store(_contract_blocks(links.filter("block is not null"), keys, ident), f"{home}/blocks")
    merged = nodes.join(local, [*keys, ident], "left").withColumn("__root", F.coalesce("root", ident)).drop("root")
    if not seen.get["across"]:
        return _store(merged.withColumnRenamed("__root", name), f"{home}/labelled")

    def rooted(df: DataFrame, end: str) -> DataFrame:
        roots = local.select(*keys, F.col(ident).alias(end), F.col("root").alias("__r"))
        return df.join(roots, [*keys, end], "left").withColumn(end, F.coalesce("__r", end)).drop("__r")

    across = _store(rooted(rooted(links.filter("block is null"), "src"), "dst").select(*keys, "src", "dst").distinct(), f"{home}/across")
    touched = across.select(*keys, F.col("src").alias("__root")).unionByName(across.select(*keys, F.col("dst").alias("__root"))).distinct()
    roots = connected_components(touched, lambda _: across, keys, "__root", "__final")
    out = merged.join(roots, [*keys, "__root"], "left").withColumn(name, F.coalesce("__final", "__root")).drop("__final", "__root")
    return _store(out.select(*nodes.columns, name), f"{home}/labelled")
