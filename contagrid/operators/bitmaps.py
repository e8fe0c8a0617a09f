"""Blocked Bloom filters of ids, in built-in bitmap functions.

Where the ids to keep are too many to broadcast, a semi join shuffles the whole big
side to find few rows. A filter of a fixed size that may let others pass, but never
drops an id it was made of, goes to every task instead and prunes the big side
before its shuffle; the exact join that follows sees little more than the rows it keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a bucket, which is what one bitmap of Spark's bitmap functions holds (4 KB).
BUCKET_BITS = 32768
#: Buckets of a filter: at most 8 MB, whatever the number of ids.
BUCKETS = 2048


def _place(key: Column, buckets: int) -> tuple[Column, list[Column]]:
    """The bucket of a key and its two bits there, all from one hash."""
    h = F.xxhash64(key)
    bits = [F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(BUCKET_BITS - 1)), F.shiftrightunsigned(h, 49).bitwiseAND(F.lit(BUCKET_BITS - 1))]
    return F.pmod(h.bitwiseAND(F.lit((1 << 34) - 1)), F.lit(buckets)), bits


def id_filter(ids: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, bitmap): at most ``buckets`` rows of 4 KB each; repeated ids add nothing, missing ones are left out."""
    bucket, bits = _place(F.col(key), buckets)
    rows = ids.where(F.col(key).isNotNull()).select(bucket.alias("bucket"), F.explode(F.array(*bits)).alias("bit"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def distinct_rows(df: DataFrame, digest: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """The rows of ``df`` once each, like ``distinct``, without shuffling rows that have no copy.

    What is shuffled of every row is a digest. Digests that occur more than once become a filter;
    rows it doesn't hold are alone and stay where they are, and only the others
    are compared whole. Equal rows have equal digests, so a weak digest only
    makes more rows be compared. ``df`` is read three times; this suits wide rows with few copies.
    """
    keyed = df.withColumn("__digest", digest(*[F.col(f"`{c}`") for c in df.columns]))
    again = keyed.groupBy("__digest").agg(F.count("*").alias("__n")).where("__n > 1")
    flagged = _flagged(keyed, "__digest", id_filter(again, "__digest"), BUCKETS)
    plain = [F.col(f"`{c}`") for c in df.columns]
    alone = flagged.where("NOT __may_be").select(*plain)
    return alone.unionByName(flagged.where("__may_be").select(*plain).distinct())


def may_be_in(df: DataFrame, key: str, filter_: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``df`` whose key may be among the filter's ids; none of those that are is lost.

    The filter is broadcast: its size is bounded by its number of buckets.
    """
    placed = _flagged(df.where(F.col(key).isNotNull()), key, filter_, buckets, "inner")
    return placed.where("__may_be").select(*df.columns)


def _flagged(df: DataFrame, key: str, filter_: DataFrame, buckets: int, how: str = "left") -> DataFrame:
    """``df`` with ``__may_be``: whether the filter holds the key."""
    bucket, bits = _place(F.col(key), buckets)

    def is_set(bit: Column) -> Column:
        byte = F.substring("__bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1

    small = F.broadcast(filter_.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap")))
    held = F.coalesce(is_set(bits[0]) & is_set(bits[1]), F.lit(False))
    return df.join(small, bucket == F.col("__bucket"), how).withColumn("__may_be", held)
