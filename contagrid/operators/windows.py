"""Shares and running totals over small aggregated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from contagrid.functions.numbers import percent


def with_overall(df: DataFrame, name: str, aggregate: Column) -> DataFrame:
    """An aggregate of all rows beside each of them, in one pass.

    For tables with a row per category or territory: they become one row on the way.
    """
    rows = df.groupBy().agg(F.collect_list(F.struct("*")).alias("__rows"), aggregate.alias(name))
    return rows.select(name, F.inline("__rows")).select(*df.columns, name)


def share_of_total(df: DataFrame, measure: str = "n", name: str = "pct", digits: int = 1) -> DataFrame:
    """Percentage of the grand total.

    The total is a scalar subquery, so rows stay in their partitions: a window
    without a key would bring all of them into one task.
    """
    total = df.select(F.sum(measure).alias("total")).scalar()
    return df.withColumn(name, percent(F.col(measure), total, digits))


def share_within(df: DataFrame, group: str, measure: str = "n", name: str = "share") -> DataFrame:
    """Fraction of the group's total; ``df`` holds few rows per group."""
    return df.withColumn(
        name, F.try_divide(F.col(measure).cast("double"), F.sum(measure).over(Window.partitionBy(group)).cast("double"))
    )


def running_total(df: DataFrame, measure: str, order: str | Sequence[str], name: str = "running") -> DataFrame:
    """Running total in ``order``, which must tell all rows apart.

    For tables with a row per category: they become one row on the way, in
    order. ``distribution.running_totals`` does the same for tables of any size.
    """
    key = F.struct(*([order] if isinstance(order, str) else order)).alias("key")
    rows = df.groupBy().agg(F.array_sort(F.collect_list(F.struct(key, F.struct("*").alias("row")))).alias("__rows"))
    zero = F.lit(0).cast(dict(df.dtypes)[measure])

    def up_to(entry: Column, i: Column) -> Column:
        part = F.slice("__rows", F.lit(1), i + 1)
        return F.struct(entry["row"].alias("row"), F.aggregate(part, zero, lambda total, e: total + F.coalesce(e["row"][measure], zero)).alias(name))

    return rows.select(F.inline(F.transform("__rows", up_to))).select("row.*", name)


def middle_of_segment(df: DataFrame, measure: str, running: str, name: str = "label_position") -> DataFrame:
    return df.withColumn(name, F.col(running) - F.col(measure) / 2)


def middle_from_end(df: DataFrame, measure: str, running: str, name: str = "label_position") -> DataFrame:
    """Middle of each segment when segments are stacked from the last one."""
    table = with_overall(df, "__all", F.sum(measure))
    return table.withColumn(name, F.col("__all") - F.col(running) + F.col(measure) / 2).drop("__all")
