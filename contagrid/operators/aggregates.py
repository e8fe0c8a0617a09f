"""Counts, sums and totals rows.

Every count is ``count_rows(df)``: the number of rows, or the sum of ``n`` when
the frame is already a count cube. The same operator therefore runs on raw rows
and on a cube made by one pass over them.

Totals rows come from a ``rollup`` over an aggregate that has already shrunk to
one row per group, so the big table is neither expanded nor read twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.functions.text import slug


def count_rows(df: DataFrame, condition: Column | None = None) -> Column:
    """Number of rows (for which ``condition`` holds)."""
    weighted = "n" in df.columns
    if condition is None:
        out = F.sum("n") if weighted else F.count("*")
    elif weighted:
        out = F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    else:
        out = F.count_if(condition)
    return out.cast("bigint")


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(count_rows(df).alias(name))


def with_totals(
    grouped: DataFrame,
    key: str,
    measures: Mapping[str, Column] | Sequence[str],
    label: str = "Totals",
) -> DataFrame:
    """One row per ``key`` plus a totals row flagged by ``is_total``.

    ``measures`` are aggregates (or names of columns to add up) evaluated at
    both levels, so non-additive ones are right in the totals row as well. A
    missing key stays its own row: the label is set from ``grouping()``.
    """
    if not isinstance(measures, Mapping):
        measures = {c: F.sum(c) for c in measures}
    rolled = grouped.rollup(key).agg(
        (F.grouping(key) == 1).alias("is_total"),
        *[m.alias(name) for name, m in measures.items()],
    )
    rolled = rolled.withColumn(key, F.when(F.col("is_total"), F.lit(label)).otherwise(F.col(key).cast("string")))
    return rolled.select(key, "is_total", *measures)


def crosstab(
    df: DataFrame,
    keys: str | Sequence[str],
    column: str,
    levels: Sequence[str],
    other: str | None = "unknown",
) -> DataFrame:
    """Counts of ``column`` levels side by side, zero-filled, in one shuffle.

    ``other`` collects missing values and values outside ``levels``, so row
    sums always equal the number of rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    c = F.col(column)
    aggs = [count_rows(df, c == level).alias(slug(level)) for level in levels]
    if other:
        aggs.append(count_rows(df, F.coalesce(~c.isin(*levels), F.lit(True))).alias(other))
    return df.groupBy(*keys).agg(*aggs)


def level_columns(levels: Sequence[str], other: str | None = "unknown") -> list[str]:
    return [slug(x) for x in levels] + ([other] if other else [])


def row_total(df: DataFrame, columns: Sequence[str], name: str = "row_total") -> DataFrame:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumn(name, total)


def sum_measures(df: DataFrame, keys: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def block_subtotals(df: DataFrame, block: str, item: str, measure: str = "n") -> DataFrame:
    """Items, their block subtotals and the grand total (grouping sets)."""
    return (
        df.groupingSets([[block, item], [block], []], block, item)
        .agg(F.sum(measure).alias(measure), F.grouping_id(block, item).cast("int").alias("level"))
        .select(
            block,
            item,
            F.element_at(F.create_map(F.lit(0), F.lit("item"), F.lit(1), F.lit("block"), F.lit(3), F.lit("total")),
                         F.col("level")).alias("kind"),
            measure,
        )
    )
