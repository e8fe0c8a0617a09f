"""Unions, alignment of measures, unpivot and transpose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_and_sum(frames: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union, then add up the rows that share the keys."""
    return union_all(frames).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def align_measures(
    sources: Mapping[str, tuple[DataFrame, str]],
    keys: str | Sequence[str],
    fill: int | None = 0,
) -> DataFrame:
    """Put measures of several tables side by side, like a chain of full joins.

    ``sources`` maps the output name to (table, column); each table holds one
    row per key. One union and one conditional aggregate replace N-1 joins, and
    a missing key stays one row. ``fill=None`` keeps absent values missing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    # tables that bring several measures enter the union once
    by_table: dict[int, tuple[DataFrame, dict[str, str]]] = {}
    for name, (df, column) in sources.items():
        by_table.setdefault(id(df), (df, {}))[1][name] = column
    parts = []
    for df, named in by_table.values():
        parts.append(
            df.select(*keys, *[(F.col(named[m]) if m in named else F.lit(None)).alias(m) for m in sources])
        )
    aligned = union_all(parts).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in sources])
    return aligned if fill is None else aligned.na.fill(fill, list(sources))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def transpose(
    df: DataFrame, key: str, measures: Sequence[str], key_values: Sequence[str | None], missing: str = "unknown"
) -> DataFrame:
    """Measures become rows and the given key values become columns; the missing key's is named ``missing``."""
    headers = [missing if k is None else k for k in key_values]
    if len(set(headers)) < len(headers):
        raise ValueError(f"two columns would have one name: {sorted(headers)}")
    long = df.select(key, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(
        [key], list(measures), "measure", "value"
    )
    if not key_values:  # a week without data
        return long.select("measure").distinct()
    return long.groupBy("measure").agg(
        *[
            F.max(F.when(F.col(key).isNull() if k is None else F.col(key) == F.lit(k), F.col("value"))).alias(header)
            for k, header in zip(key_values, headers)
        ]
    )


def append_row(df: DataFrame, sums: Sequence[str] = (), **values) -> DataFrame:
    """Append one row of literals and of the sums of some columns; columns that are not named are missing."""
    row = [
        (F.sum(f.name) if f.name in sums else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in df.schema.fields
    ]
    return df.unionByName(df.agg(*row) if sums else df.sparkSession.range(1).select(*row))
