"""Places of pattern matches in whole texts, with DataFrame functions only.

Spark finds the matches of a pattern but not where they are. A replacement puts a mark before and
after every match; the lengths of the pieces between the marks then give the places. Positions count
code points from zero, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"
SPAN = "array<struct<start:int,end:int,value:string>>"


def unmarked(text: Column) -> Column:
    """``text`` (null: empty) with the two marks replaced by another control character, length kept."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _OPEN + _CLOSE, _OTHER + _OTHER)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in an ``unmarked`` text, as ``SPAN``."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def step(state: Column, part: Column) -> Column:
        value = F.substring_index(part, _CLOSE, 1)
        here = F.struct(state["at"].alias("start"), (state["at"] + F.length(value)).alias("end"), value.alias("value"))
        return F.struct((state["at"] + F.length(part) - 1).alias("at"), F.concat(state["found"], F.array(here)).alias("found"))

    begin = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.array().cast(SPAN).alias("found"))
    return F.aggregate(F.slice(parts, 2, F.size(parts)), begin, step, lambda state: state["found"])


def labelled(spans: Column, kind: str, order: int) -> Column:
    """``spans`` as structs that sort by start and then by kind."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def by_start(*groups: Column) -> Column:
    return F.array_sort(F.concat(*groups))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))
