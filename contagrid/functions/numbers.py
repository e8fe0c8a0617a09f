"""Numeric expressions. ANSI mode is on in Spark 4, so raw values need ``try_*``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    """Null when either side is null or the divisor is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def sum_nulls_as_zero(*cols: Column) -> Column:
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in cols])


def weighted_quantiles(counts: Column, shares: Sequence[float]) -> Column:
    """Array of exact quantiles, interpolated between ranks, of values that each stand ``n`` times.

    ``counts`` is an array of structs (value, n) in any order, a value in one entry
    or in several. Null where nothing is counted.
    """
    kind = "struct<seen: bigint, before: bigint, low: double, high: double>"

    def at_rank(ordered: Column, rank: Column) -> Column:
        """Values at the whole ranks around ``rank``, in one pass over the ordered entries."""
        below, above = F.floor(rank), F.ceil(rank)
        start = F.struct(F.lit(0), F.lit(0), F.lit(None), F.lit(None)).cast(kind)

        def step(sofar: Column, entry: Column) -> Column:
            seen = sofar["seen"] + entry["n"]
            covers = lambda r: (sofar["seen"] <= r) & (r < seen)
            low = F.when(covers(below), entry["value"]).otherwise(sofar["low"])
            high = F.when(covers(above), entry["value"]).otherwise(sofar["high"])
            return F.struct(seen, sofar["seen"], low, high).cast(kind)

        return F.aggregate(ordered, start, step, lambda end: end["low"] + (end["high"] - end["low"]) * (rank - below))

    def quantiles(ordered: Column) -> Column:
        size = F.aggregate(ordered, F.lit(0).cast("bigint"), lambda sofar, entry: sofar + entry["n"])
        return F.when(size > 0, F.array(*[at_rank(ordered, (size - 1) * F.lit(float(share))) for share in shares]))

    return F.get(F.transform(F.array(F.array_sort(counts)), quantiles), F.lit(0))
