"""Label codes, display names and label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright import config


def map_label(code: Column, mapping: dict[str, int]) -> Column:
    """Code to 0/1 by dictionary; a code outside it gives null."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.try_element_at(table, code)


def display_name(index: Column, stain: str) -> Column:
    return F.get(F.array(*[F.lit(n) for n in config.DISPLAY_NAMES[stain]]), index.cast("int"))


def labelled_subset(annotated: DataFrame, flag: str = "atypia_of_uncertain_significance") -> DataFrame:
    return annotated.filter(F.col(flag) == 1)


def label_columns(annotated: DataFrame, lead: int = 6) -> list[str]:
    return annotated.columns[lead:]
