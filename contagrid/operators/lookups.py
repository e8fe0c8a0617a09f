"""Lookup joins that never multiply the left side.

No broadcast hint is given. Catalyst broadcasts a dimension when its size is
known to be under ``spark.sql.autoBroadcastJoinThreshold``; beyond that the
join shuffles both sides. Every join keeps the big table on the left, the side
adaptive execution may split when one key holds very many rows. It only does so
when both inputs come straight from a shuffle, which ``split_hot_keys`` ensures:
the join key is extended by its own hash, so the partitioning left behind by the
selection of first rows does not fit and the (one row per key) side is shuffled
for the join itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def _has_all(columns: Iterable[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def join_on_hashed_key(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    how: str,
    take: dict[str, str] | None = None,
    split_hot_keys: bool = True,
) -> DataFrame:
    """Equi-join of ``left`` columns to ``right`` columns.

    The result has the left's columns and, for a left join, the ``take`` columns
    of the right under their new names; a missing key matches nothing.
    """
    keys = {r: f"__key_{r}" for r in on.values()}
    selected = [F.col(r).alias(k) for r, k in keys.items()] + [F.col(c).alias(new) for c, new in (take or {}).items()]
    condition = [F.col(l) == F.col(keys[r]) for l, r in on.items()]
    added = list(keys.values())
    if split_hot_keys:
        # rows without a key match nothing, and are dealt to all tasks rather than to one
        hashed = F.when(_has_all(on), F.xxhash64(*on)).otherwise(F.xxhash64(*left.columns))
        left = left.withColumn("__left_hash", hashed)
        selected.append(F.xxhash64(*on.values()).alias("__hash"))
        condition.append(F.col("__left_hash") == F.col("__hash"))
        added += ["__left_hash", "__hash"]
    return left.join(right.select(*selected), condition, how).drop(*added)


def members(df: DataFrame, ids: DataFrame, on: str, id_column: str | None = None) -> DataFrame:
    """Rows whose key is in ``ids`` (semi join; never multiplies rows)."""
    return join_on_hashed_key(df, ids.select(id_column or on), {on: id_column or on}, "left_semi")


def non_members(df: DataFrame, ids: DataFrame, on: str, id_column: str | None = None) -> DataFrame:
    """Rows whose key is not in ``ids``; rows without a key stay."""
    return join_on_hashed_key(df, ids.select(id_column or on), {on: id_column or on}, "left_anti")


def first_match(dim: DataFrame, keys: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``.

    ``row_number() = 1`` is pruned per partition before the shuffle, so a key
    with very many copies sends one row per task, not all of them.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return dim.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: dict[str, str],
    take: dict[str, str],
    order: Sequence[str] = ("source_row",),
    unique: bool = False,
    split_hot_keys: bool = False,
    bypass_missing: bool = False,
) -> DataFrame:
    """Left join to the first matching row of ``dim``.

    ``on`` maps left columns to dimension columns and ``take`` maps dimension
    columns to the new names. Missing keys match nothing. ``unique`` says that
    ``dim`` has one row per key already. Ask for ``split_hot_keys`` where the
    dimension can outgrow a broadcast: the rows of a hot key are then read by
    several tasks. With ``bypass_missing`` rows without a key go round the join and
    are united with its result: they are not shuffled, but ``df`` is read once more, so this suits
    scans and written tables.
    """
    if not unique:
        keys = list(on.values())
        dim = first_match(dim.select(*dict.fromkeys([*keys, *take, *order])), keys, order)
    if not bypass_missing:
        return join_on_hashed_key(df, dim, on, "left", take, split_hot_keys)
    joined = join_on_hashed_key(df.where(_has_all(on)), dim, on, "left", take, split_hot_keys)
    kinds = dict(joined.dtypes)
    missing = [F.lit(None).cast(kinds[new]).alias(new) for new in take.values()]
    return joined.unionByName(df.where(~_has_all(on)).select("*", *missing))


def duplicate_keys(df: DataFrame, key: str, value: str, within: Sequence[str] = ()) -> DataFrame:
    """Keys that carry more than one value, within each of ``within``: what a first-match lookup drops."""
    pairs = df.select(*within, key, value).distinct()
    return pairs.groupBy(*within, key).agg(F.count("*").alias("n_values")).where("n_values > 1")
