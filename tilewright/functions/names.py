"""Slide, sample and model names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def name_token(name: Column, position: int) -> Column:
    """Token ``position`` of a name split on single spaces, null when there is none."""
    return F.get(F.split(name, " ", -1), F.lit(position))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def model_part(path: Column, position: int) -> Column:
    """Dash-separated part ``position`` (zero-based) of a model file name."""
    return F.get(F.split(basename(path), "-", -1), F.lit(position))


def case_name(path: Column) -> Column:
    return F.replace(basename(path), F.lit(".ndpi"), F.lit(""))


def joined_path(root: Column, name: Column, extension: Column) -> Column:
    return F.concat(F.concat_ws("/", F.rtrim(root, F.lit("/")), name), extension)


def id_list(text: Column) -> Column:
    """``"0,1"`` to ``[0, 1]``; ``none`` and null give an empty array."""
    empty = F.array().cast("array<int>")
    return F.when(text.isNull() | (text == "none") | (text == ""), empty).otherwise(
        F.transform(F.split(text, ","), lambda t: F.trim(t).cast("int"))
    )
