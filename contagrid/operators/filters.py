"""Row filters and value corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job runs when a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def not_equal_or_null(c: Column, value) -> Column:
    """True for every row that does not hold ``value``, missing included."""
    return ~c.eqNullSafe(F.lit(value))


def known_and_not_in(c: Column, values: Sequence) -> Column:
    return c.isNotNull() & ~c.isin(*values)


def fix_literals(c: Column, fixes: Mapping[str, str]) -> Column:
    """Replace whole values by a literal map lookup; other values pass through."""
    if not fixes:
        return c
    pairs = [F.lit(x) for pair in fixes.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def row_difference(df: DataFrame, minus: DataFrame) -> DataFrame:
    """Rows of ``df`` that equal no row of ``minus`` on all common columns.

    Missing equals missing, and duplicates of surviving rows are kept. For frames
    that don't come from one another; where ``minus`` is a filter of ``df``, use ``without``.
    """
    common = [c for c in df.columns if c in minus.columns]
    right = minus.select(*[F.col(c).alias(f"__{c}") for c in common]).distinct()
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in common])
    return df.join(right, same, "left_anti")


def without(df: DataFrame, condition: Column) -> DataFrame:
    """The difference of ``df`` and its rows that meet ``condition``, which is one scan and no shuffle.

    Rows for which the condition is missing stay.
    """
    return df.where(~F.coalesce(condition, F.lit(False)))


def with_placeholder(df: DataFrame, label: str) -> DataFrame:
    """For the sink: a one-row placeholder when, and only when, ``df`` is empty.

    Text columns take ``label`` and numeric columns 0. Meant for small result
    tables, which become one row on the way and are computed once;
    operators themselves return empty results as they are.
    """
    row = [
        (F.lit(label) if f.dataType.typeName() == "string" else F.lit(0)).try_cast(f.dataType).alias(f.name)
        for f in df.schema.fields
    ]
    rows = F.collect_list(F.struct("*")).alias("__rows")
    placeholder = F.array(F.struct(*row))
    return df.groupBy().agg(rows).select(F.inline(F.when(F.size("__rows") > 0, F.col("__rows")).otherwise(placeholder)))


def drop_placeholder(df: DataFrame, label: str, key: str = "sve") -> DataFrame:
    """Drop placeholder rows when real rows exist; else keep one of each. For small result tables, like ``with_placeholder``."""
    rows = df.groupBy().agg(F.collect_list(F.struct("*")).alias("__rows"))
    real = F.filter("__rows", lambda r: ~r[key].eqNullSafe(F.lit(label)))
    return rows.select(F.inline(F.when(F.size(real) > 0, real).otherwise(F.array_distinct("__rows"))))
