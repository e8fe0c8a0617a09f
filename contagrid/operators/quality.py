"""What the inputs lose on the way: written dates that cannot be read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from contagrid.functions.dates import unreadable


def unreadable_dates(df: DataFrame, columns: Mapping[str, Sequence[str]], source: str = "") -> DataFrame:
    """source, column, n_written, n_unreadable for each date column, read in its ``orders``; all in one pass."""
    counts = [
        F.struct(
            F.lit(source).alias("source"),
            F.lit(c).alias("column"),
            F.count_if(F.trim(c) != "").alias("n_written"),
            F.count_if(unreadable(F.col(c), *orders)).alias("n_unreadable"),
        )
        for c, orders in columns.items()
    ]
    return df.agg(F.array(*counts).alias("__counts")).select(F.inline("__counts"))
