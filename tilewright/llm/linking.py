"""Exact connected groups of keyed items without listing the pairs of a dense group.

Items that share a key may be linked. Items alone with a key go at once. Where a few share one, all their
pairs are compared; these may be the more if pairs are sifted inside the list, where a comparison costs no row.
A key that many share is narrowed: a linked pair must agree in one of a few further parts, so
items are only compared with those that also agree there, and again in parts of the rest. What many still share
is a dense group. There every item is first compared with two others, the heaviest and the one before it, which
costs one comparison each and joins most of the group. Then only keys that still hold several groups are
looked at: each item outside the largest group of its key is compared with all items of the other groups
there. Every linked pair with a common key is thus in one group at the end, as if all pairs had been tested.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.operators.components import connected_components
from tilewright.session import materialise

Near = Callable[[str, str, Column], Column]
Sift = Callable[[Column, Column, Column], Column]
Finer = Callable[[Column, Column, int], list[Column]]


#: Up to so many items of a key are compared pair by pair.
FEW = 32
#: The same for keys that can be narrowed: a narrowing takes one row to several, a comparison in a list takes none.
LISTED = 256
#: A key that more share is narrowed, and so is a part of it.
NARROWINGS = 2


def _of(name: str, columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns]).alias(name)


def _meet(rows: DataFrame, ways: list[Column], near: Near, sift: Sift | None, few: int, bits: tuple[str, int] | None) -> DataFrame:
    """Candidate links ``src, dst`` among few items, and the rows of items that share a value of a way with many.

    ``rows`` are those of a key, and of a ``part`` of it if there are several ways, partitioned by them. The many keep their row for each such
    way, with a ``part`` and a ``path`` of its own. Lists of the others hold ``few`` items at most and are sifted at once,
    the bare values of ``bits`` first, which settles most rows.
    """
    me, own = F.col("me"), ["key", "part", "path", "n", "me", "weight"]
    found, many = [], []
    for i, value in enumerate(ways):
        # A single column is sorted without comparing rows.
        group = W.partitionBy("key", "part", "__v") if len(ways) > 1 else W.partitionBy("key")
        rows = rows.withColumn("__v", value).withColumn("__n", F.count(F.lit(1)).over(group))
        if len(ways) == 1:
            rows = rows.filter("__n > 1")
        rows = rows.withColumn("__list", F.collect_list(F.when(F.col("__n") <= few, me)).over(group))
        sifted = F.filter("__list", lambda x: (x["id"] < me["id"]) & (sift(x, me, F.col("key")) if sift else F.lit(True)))
        if bits:
            name, most = bits
            rows = rows.withColumn("__bits", F.collect_list(F.when(F.col("__n") <= few, me[name])).over(group))
            close = F.filter("__bits", lambda v: F.bit_count(v.bitwiseXOR(me[name])) <= most)  # itself among them
            sifted = F.when(F.size(close) > 1, sifted).otherwise(F.array().cast(rows.schema["__list"].dataType))
        rows = rows.withColumns({f"__f{i}": sifted, f"__m{i}": F.col("__n"), f"__p{i}": F.xxhash64("part", F.lit(i), "__v")}).drop("__list", "__bits", "__n", "__v")
        found.append(F.transform(f"__f{i}", lambda x: F.struct(x.alias("other"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("int").alias("path"), F.lit(None).cast("long").alias("n"))))
        many.append(F.when(F.col(f"__m{i}") > few, F.array(F.struct(
            F.lit(None).cast(rows.schema["me"].dataType).alias("other"), F.col(f"__p{i}").alias("part"), F.lit(i).alias("path"), F.col(f"__m{i}").alias("n")))
        ).otherwise(F.array()))
    out = rows.select("key", "me", "weight", F.explode(F.concat(*found, *many)).alias("__o")).select(
        "key", "me", "weight", F.col("__o.other").alias("other"), F.col("__o.part").alias("part"), F.col("__o.path").alias("path"), F.col("__o.n").alias("n"))
    link = F.col("other").isNotNull()
    return out.filter(~link | near("other", "me", F.col("key"))).select(
        F.col("other.id").alias("src"), F.when(link, F.col("me.id")).alias("dst"), *[F.when(~link, F.col(c)).alias(c) for c in own])


def linked_groups(
    items: DataFrame, keyed: Callable[[DataFrame], DataFrame], near: Near, payload: list[str],
    verify: Callable[[DataFrame], DataFrame] | None = None, weight: str = "weight", name: str = "component",
    sift: Sift | None = None, finer: Finer | None = None, bits: tuple[str, int] | None = None,
) -> DataFrame:
    """``items`` (``id``, ``weight``, payload) with the smallest id of their group as ``name``.

    ``keyed`` adds a column ``key`` and may repeat rows. ``near(a, b, key)`` decides on two structs
    of ``id`` and ``payload`` whether they are candidates; ``verify``, if given, takes candidate links
    ``src, dst`` and returns those that hold. ``sift`` may rule out pairs of structs sooner, ``near`` or not.
    ``finer(key, path, level)`` gives values of the struct ``me``, one of which the candidates of a key must share;
    ``path`` is 0 at first and then the number of the value shared before. ``bits`` names a long of the payload and the
    most bits in which candidates may differ there. Not lazy: the steps are stored in the shared folder.
    """
    columns = ["id", *payload]
    ordered = W.partitionBy("key", "part").orderBy(F.col("weight").desc(), "me.id")
    rows = keyed(items).select("key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("path"), _of("me", columns), F.col(weight).cast("long").alias("weight"))
    few = LISTED if finer else FEW
    met = materialise(_meet(rows.repartition("key"), [F.lit(0)], near, sift, few, bits), "met")
    pairs, large = met.filter("src is not null").select("src", "dst"), met.filter("src is null").drop("src", "dst")
    some = not large.isEmpty()
    for level in range(NARROWINGS if finer else 0):
        if not some:
            break
        met = materialise(_meet(large.repartition("key", "part"), finer(F.col("key"), F.col("path"), level), near, sift, few, bits), "met")
        pairs = pairs.unionByName(met.filter("src is not null").select("src", "dst"))
        large = met.filter("src is null").drop("src", "dst")
        some = not large.isEmpty()
    if some:
        large = large.select("key", "part", "me", "weight")
        top = large.select("key", "me", F.array(F.first("me").over(ordered), F.lag("me").over(ordered)).alias("others"))
        star = top.select("key", "me", F.explode("others").alias("other")).filter("other is not null").filter(
            (F.col("other.id") != F.col("me.id")) & near("other", "me", F.col("key")))
        pairs = pairs.unionByName(star.select(F.col("other.id").alias("src"), F.col("me.id").alias("dst")))
    links = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    if verify:  # one link of each item first: most of the others are then inside a group, and need not be verified
        links = materialise(links.withColumn("early", F.min("src").over(W.partitionBy("dst")) == F.col("src")), "links")
        later, links = links.filter("not early").drop("early"), links.filter("early").drop("early")
        rest = not later.isEmpty()
    else:
        rest = False
    first = _components(materialise(verify(links) if verify else links, "held"), "grp")
    grouped = items.join(first, "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    if not some and not rest:
        return grouped.withColumnRenamed("grp", name)

    own = first.withColumnRenamed("id", "__id")

    def with_group(df: DataFrame, end: str) -> DataFrame:
        return df.join(own, F.col(end) == F.col("__id"), "left").withColumn(f"{end}_grp", F.coalesce("grp", end)).drop("__id", "grp")

    across = []
    if rest:
        across.append(with_group(with_group(later, "src"), "dst").filter("src_grp <> dst_grp").select("src", "dst"))
    if some:
        across.append(_across(large, own, near))
    found = reduce(DataFrame.unionByName, across)
    found = found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    held = with_group(with_group(verify(found) if verify else found, "src"), "dst")
    bridges = materialise(held.select(F.col("src_grp").alias("src"), F.col("dst_grp").alias("dst")).distinct(), "bridges")
    final = _components(bridges, name).withColumnRenamed("id", "grp")
    return grouped.join(final, "grp", "left").withColumn(name, F.coalesce(name, "grp")).select(*items.columns, name)


def _across(large: DataFrame, own: DataFrame, near: Near) -> DataFrame:
    """Candidate links ``src, dst`` between groups (``own``) that meet in one key: all but the largest there with all others."""
    whole = W.partitionBy("key", "part")
    spread = large.join(own, F.col("me.id") == F.col("__id"), "left").select("key", "part", "me", F.coalesce("grp", "me.id").alias("grp"))
    largest = W.partitionBy("key", "part").orderBy(F.col("n").desc(), "grp")
    mixed = materialise(
        spread.withColumns({"lo": F.min("grp").over(whole), "hi": F.max("grp").over(whole)}).filter("lo <> hi")
        .withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key", "part", "grp")))
        .select("key", "part", "grp", "me", (F.first("grp").over(largest) != F.col("grp")).alias("minor")), "mixed")
    one = mixed.filter("minor").select("key", "part", F.col("grp").alias("src_grp"), F.col("me").alias("one"))
    two = mixed.select(F.col("key").alias("key_two"), F.col("part").alias("part_two"), F.col("grp").alias("dst_grp"), F.col("me").alias("two"))
    across = one.join(two, (F.col("key") == F.col("key_two")) & (F.col("part") == F.col("part_two")) & (F.col("src_grp") != F.col("dst_grp")) & near("one", "two", F.col("key")))
    return across.select(F.col("one.id").alias("src"), F.col("two.id").alias("dst"))


def _components(links: DataFrame, name: str) -> DataFrame:
    """``id`` of every item in ``links`` (stored), with the smallest id of its component as ``name``."""
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    return connected_components(ends, lambda _: links, [], "id", name)
