"""Merkle manifest of a table, built with lag and lead windows.

Rows of a group are numbered in order and cut into blocks of ``8 ** DEPTH``. Inside a block every row
stays where it is: level ``k`` nodes live on the rows whose number is a multiple of ``8 ** k``, so the
siblings of a node are lags and leads at fixed multiples of ``8 ** k``, masked by its slot in the run
and the length of the run, and the row of the first child hashes the parent. One row of each block then
goes on to the next pass. A window never holds more than a block, whatever the size of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.session import materialise, shuffle_width

#: Children of a node, which is fixed by the format of the manifest.
ARITY = 8
#: Levels that one pass of windows settles.
DEPTH = 3
_BLOCK = ARITY ** DEPTH


def _field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*[_field(c) for c in columns])


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place within ``grp`` from 0, and ``n``, the rows of the group.

    Rows are range-partitioned on group and order and stored with their place in the partition, so the
    counts per partition, a few rows, turn it into the place in the group. Rows equal in ``order`` must
    be told apart by its last column if they are many.
    """
    spread = rows.repartitionByRange(shuffle_width(rows.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    placed = materialise(spread.withColumn("at", F.monotonically_increasing_id()), "manifest-order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    whole = W.partitionBy("grp")
    before = F.sum("here").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n"))
    return placed.join(parts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _levels(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``grp, pos, n, h``) with ``steps`` and, on the first row of a block, its ``top``.

    ``steps`` holds left and right siblings of the row's ancestors in the block, from below; a level
    that has a single node is none. ``n`` counts the nodes of the group.
    """
    w = W.partitionBy("grp", "block").orderBy("pos")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = nodes.withColumn("block", F.floor(F.col("pos") / _BLOCK).cast("long")).withColumn("h0", F.col("h"))
    none = F.lit("")
    for k in range(DEPTH):
        step = ARITY ** k
        h = F.col(f"h{k}")
        own, count = F.floor(F.col("pos") / step), F.ceil(F.col("n") / step)
        slot = own % ARITY
        run = F.least(F.lit(ARITY), count - own + slot)
        out = out.withColumns({
            **{f"b{j}": F.lag(h, j * step).over(w) for j in range(1, ARITY)},
            **{f"f{j}": F.lead(h, j * step).over(w) for j in range(1, ARITY)}})
        left = F.concat(*[F.coalesce(F.when(slot >= j, F.col(f"b{j}")), none) for j in range(ARITY - 1, 0, -1)])
        right = F.concat(*[F.coalesce(F.when(slot + j < run, F.col(f"f{j}")), none) for j in range(1, ARITY)])
        here = (F.col("pos") % step == 0) & (count > 1)
        first = F.col("pos") % (step * ARITY) == 0
        out = out.withColumn(f"s{k}", F.when(here, F.struct(left.alias("l"), right.alias("r")))).withColumn(
            f"h{k + 1}", F.when(first, F.when(count > 1, digest(h, F.col(f"s{k}.r"))).otherwise(h)))
        out = out.drop(f"h{k}", *[f"{side}{j}" for side in "bf" for j in range(1, ARITY)])
        if k:  # rows below a node see what it sees
            out = out.withColumn(f"s{k}", F.last(f"s{k}", ignorenulls=True).over(so_far))
    steps = F.filter(F.array(*[F.col(f"s{k}") for k in range(DEPTH)]), lambda s: s.isNotNull())
    return out.withColumn("steps", steps).withColumnRenamed(f"h{DEPTH}", "top").drop(*[f"s{k}" for k in range(DEPTH)])


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The passes from ``leaves`` (``grp, pos, n, h``) up to one row per group, whose ``h`` is its root.

    The number of passes follows the size of the largest group; each reads one row of 512 of the one before.
    """
    most = leaves.agg(F.max("n").alias("n")).first().n or 0
    passes = [leaves]
    while True:
        passes.append(materialise(_levels(passes[-1]).filter("top is not null").select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / _BLOCK).cast("long").alias("n"), F.col("top").alias("h")), "manifest-level"))
        most = -(-most // _BLOCK)
        if most <= 1:
            return passes


def descend(passes: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with their ``steps`` up to the root and, beyond it, those of ``tops``.

    ``tops`` has one row per group: ``grp``, ``above`` (steps beyond the group's root) and columns to carry.
    Steps go down from block to block, so a join key never has more rows than a block.
    """
    carried = [c for c in tops.columns if c not in ("grp", "above")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(range(len(passes) - 1)):
        seen = _levels(passes[level]).join(above, ["grp", "block"]).withColumn("steps", F.concat("steps", "above"))
        if level == 0:
            return seen
        above = seen.select("grp", F.col("pos").alias("block"), F.col("steps").alias("above"), *carried)
    raise AssertionError


def manifest(table: DataFrame, ident: str, group: str, columns: list[str], altered: Column, altered_columns: list[Column]) -> DataFrame:
    """``ident, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``table``.

    A leaf is the digest of ``columns``. Leaves of a ``group`` ascend by ``ident`` (nulls first, then by
    leaf); groups are ordered by name, null first. Where ``altered`` holds, the root is folded from the
    leaf of ``altered_columns`` instead, with the original siblings. Rows that repeat another are leaves
    of their own; no rows give no rows. Names of other columns do not matter. Not lazy: steps are stored
    in the shared folder.
    """
    # '-' sorts before '=', so a null group comes first and every key is comparable.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaf = leaf_digest([F.col(c) for c in columns])
    changed = F.when(F.coalesce(altered, F.lit(False)), leaf_digest(altered_columns))
    rows = materialise(table.select(
        key.alias("grp"), F.col(ident).alias("ident"), leaf.alias("h"), changed.alias("changed"),
        F.monotonically_increasing_id().alias("tie")), "manifest-leaves")
    leaves = materialise(numbered(rows, ["ident", "h", "tie"]).select("grp", "ident", "h", "changed", "pos", "n"), "manifest-places")
    passes = climb(leaves)
    named = numbered(passes[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"), ["name"])
    groups = climb(materialise(named.select("grp", "pos", "n", "h", "name"), "manifest-groups"))
    top = groups[-1].select("grp", F.col("h").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("above"))
    tops = descend(groups, top).select(F.col("name").alias("grp"), F.col("h").alias("subroot"), "root", F.col("steps").alias("above"))
    seen = descend(passes, materialise(tops, "manifest-tops"))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "")
    folded = F.aggregate(F.col("steps"), F.coalesce("changed", "h"), lambda acc, s: digest(s["l"], acc, s["r"]))
    out = seen.select(
        F.col("ident").alias(ident), F.col("h").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` with its tamper test.

    A third of the rows, those whose crc32 of the decimal ``doc_id`` is divisible by three, are altered
    by lower-casing A-Z in ``text``; a null text stays, and so does a row without an id.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = [lowered(F.col(c)) if c == "text" else F.col(c) for c in columns]
    return manifest(docs, "doc_id", "lang", columns, altered, changed)
