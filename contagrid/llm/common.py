"""What the text operators share: input columns, word classes and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contagrid.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters and digits and of everything beyond ASCII, in lower-cased text.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, as every engine does it alike."""
    return F.translate(text, UPPER, LOWER)


def part_of(doc_id: str, parts: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``parts``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again.

    Lost executors don't lose it, its readers don't compute it anew, and Spark
    knows its size: joins broadcast it only if it is under the session's
    threshold. It goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def hot_split_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join whose left side adaptive execution can split where one key has very many rows.

    It splits only partitions that come straight from a shuffle made for the
    join. The right side often is partitioned by its keys already, so both sides
    get the hash of the keys as one key more. Keys must not be null on the right.
    """
    return (
        left.withColumn("__on", F.xxhash64(*on))
        .join(right.withColumn("__on", F.xxhash64(*on)), ["__on", *on], how)
        .drop("__on")
    )
