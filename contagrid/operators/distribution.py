"""Running totals and exact order statistics of columns with any number of different values.

A range partition sorts the values over all tasks; each part adds up its own, and
the sums of the parts before it are added to that. The parts are the only
thing that is ordered in one place, and they are as many as there are shuffle
partitions. A quantile is then found by its rank, in the one row whose running
count covers it, so no group and no totals row stands in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Writes a table once and reads it again (a ``contagrid.session.Stage``).
Keep = Callable[[DataFrame, str], DataFrame]


def running_totals(df: DataFrame, measure: str, order: Sequence[str], by: Sequence[str], keep: Keep, name: str = "running") -> DataFrame:
    """``df`` with the total of ``measure`` up to and with each row, in ``order`` within ``by``; a missing one adds nothing.

    ``order`` must be total within a group for the result to be the same on
    every run. The sorted rows are written once, so that their parts are the same for both uses.
    """
    sort = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    sorted_ = df.orderBy(*sort).withColumn("__at", F.monotonically_increasing_id())
    sorted_ = keep(sorted_.withColumn("__part", F.shiftright("__at", 33)), f"{name}_sorted")
    keys = [F.col(c) for c in by]
    parts = sorted_.groupBy("__part", *keys).agg(F.sum(measure).alias("__sum"))
    # one row for each part and group that share rows, which is the parts and the groups together at most
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    skip = F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__skip")
    parts = parts.select(F.col("__part").alias("__p"), *[c.alias(f"__{i}") for i, c in enumerate(keys)], skip)
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(keys):
        same = same & c.eqNullSafe(F.col(f"__{i}"))
    within = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sorted_.withColumn("__within", F.sum(measure).over(within)).join(parts, same)
    return running.withColumn(name, F.coalesce("__within", F.lit(0)) + F.col("__skip")).select(*df.columns, name)


def quantiles(df: DataFrame, value: str, by: Sequence[str], shares: Sequence[float], keep: Keep, weight: str | None = None) -> DataFrame:
    """(*by, n, quantiles): exact quantiles of ``value`` in each group, interpolated between ranks.

    ``weight`` says how often a row counts. Missing values don't count; a group
    without others has a row with no quantiles.
    """
    count = F.count(value) if weight is None else F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    histogram = df.groupBy(*by, value).agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("__n"))
    counted = running_totals(histogram, "__n", [value], by, keep, "__seen")
    counted = keep(counted, "counted")
    sizes = counted.groupBy(*by).agg(F.sum("__n").alias("__size"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    sizes = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], "__size")
    rows = counted.join(sizes, same) if by else counted.crossJoin(sizes)
    covers = lambda rank: (F.col("__seen") - F.col("__n") <= rank) & (rank < F.col("__seen"))
    rank = lambda share: (F.col("__size") - 1) * F.lit(float(share))
    at = lambda r: F.max(F.when((F.col("__n") > 0) & covers(r), F.col(value)))
    found: list[Column] = []
    for i, share in enumerate(shares):
        found += [at(F.floor(rank(share))).alias(f"__low{i}"), at(F.ceil(rank(share))).alias(f"__high{i}")]
    table = rows.groupBy(*by, "__size").agg(*found)
    fraction = lambda share: rank(share) - F.floor(rank(share))
    values = [F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * fraction(s) for i, s in enumerate(shares)]
    return table.select(*by, F.col("__size").alias("n"), F.when(F.col("__size") > 0, F.array(*values)).alias("quantiles"))
