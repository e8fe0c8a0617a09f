"""Presentation order of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def territory_order(key: str = "sve") -> list[Column]:
    """Catalan alphabetical order with the totals row last."""
    return [F.col("is_total"), F.collate(F.col(key), "ca").asc_nulls_last()]


def totals_last(df: DataFrame, key: str = "sve") -> DataFrame:
    return df.orderBy(*territory_order(key))


def level_position(c: Column, levels: Sequence[str]) -> Column:
    """1-based place of a value in a fixed order; values outside come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), c)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(len(levels) + 1)).cast("int")


def by_level(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    return df.orderBy(level_position(F.col(column), levels), F.col(column))


def by_measure(df: DataFrame, measure: str, *then: str) -> DataFrame:
    return df.orderBy(F.col(measure).desc(), *then)
