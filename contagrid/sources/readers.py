"""Table scans. Raw columns stay text; operators convert what they use."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from contagrid.functions.dates import snapshot_monday
from contagrid.functions.numbers import to_number
from contagrid.operators.filters import require_columns
from contagrid.sources import schemas

SNAPSHOT = "snapshot_week"
#: Where a row that doesn't fit its header is kept as written.
MALFORMED = "__malformed"


def scan_text(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Every column as text, except the partition column of the snapshot week."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    df = reader.format(fmt).load(path)
    return df.select(*[F.col(f"`{c}`") if c == SNAPSHOT else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def _headers(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The files of a folder of delimited text by their header line, which is all that is read of them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    if not files.exists(place):
        return found
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if not status.isFile() or name.startswith(("_", ".")):
            continue
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(files.open(status.getPath()), "UTF-8"))
        line = reader.readLine()
        reader.close()
        if line:
            found.setdefault(line, []).append(status.getPath().toString())
    return found


def scan_weeks(spark: SparkSession, path: str, weeks: Sequence[date]) -> tuple[DataFrame, DataFrame]:
    """Weekly folders of delimited text: the rows, every column as text, and those that don't fit their header.

    Each file is read by the columns its own header names, so columns may
    appear, vanish and change places between weeks; a column that a file doesn't have is missing in its rows.
    No job looks for a schema. Fields don't contain line breaks. Rows with more or fewer fields than their header are not
    guessed at: the second table holds them as written, with their week.
    """
    parts, kept = [], [SNAPSHOT, MALFORMED]
    for week in weeks:
        for header, files in _headers(spark, f"{path.rstrip('/')}/{SNAPSHOT}={week.isoformat()}").items():
            schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in (*next(csv.reader([header])), MALFORMED))
            # lines are parsed one by one: the file reader judges a row by the columns a query uses
            lines = spark.read.text(files).where((F.col("value") != header) & (F.col("value") != ""))
            fields = F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED})
            parts.append(lines.select(fields.alias("__row")).select("__row.*", F.lit(week).alias(SNAPSHOT)))
    if not parts:
        nothing = spark.createDataFrame([], f"{SNAPSHOT} date, {MALFORMED} string")
        return nothing.drop(MALFORMED), nothing
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    good = rows.where(F.col(MALFORMED).isNull()).drop(MALFORMED)
    bad = reduce(DataFrame.unionByName, [p.where(F.col(MALFORMED).isNotNull()).select(*kept) for p in parts])
    return good, bad


def malformed_counts(bad: DataFrame) -> DataFrame:
    """How many rows of each week were set aside."""
    return bad.groupBy(SNAPSHOT).agg(F.count("*").alias("n_malformed"))


def rename_columns(df: DataFrame, names: Mapping[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """Internal names for the used columns; absent optional ones become missing."""
    require_columns(df, *[c for c in names if c not in optional])
    kept = [
        (F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(new) for c, new in names.items()
    ]
    partition = [SNAPSHOT] if SNAPSHOT in df.columns else []
    return df.select(*partition, *kept)


def select_snapshots(df: DataFrame, as_of: date, offsets: Sequence[int]) -> DataFrame:
    """Rows of the given snapshot weeks (a partition filter on partitioned tables)."""
    return df.where(F.col(SNAPSHOT).isin([snapshot_monday(as_of, o) for o in offsets]))


def _facts(spark, path, as_of, offsets, fmt) -> DataFrame:
    # whole raw rows are compared, so this precedes the column selection; the
    # snapshot filter is below the distinct and prunes the scan
    if fmt == "csv":
        good, _ = scan_weeks(spark, path, [snapshot_monday(as_of, o) for o in offsets])
        return good.distinct()
    return select_snapshots(scan_text(spark, path, fmt), as_of, offsets).distinct()


def read_patients(
    spark: SparkSession, path: str, as_of: date, offsets: Sequence[int] = (-1, -2, -3), fmt: str = "parquet"
) -> DataFrame:
    df = rename_columns(_facts(spark, path, as_of, offsets, fmt), schemas.PATIENT_COLUMNS, schemas.PATIENT_OPTIONAL)
    return df.withColumn("n_contacts", to_number(F.col("n_contacts")))


def read_contacts(
    spark: SparkSession, path: str, as_of: date, offsets: Sequence[int] = (-1, -2, -3), fmt: str = "parquet"
) -> DataFrame:
    return rename_columns(_facts(spark, path, as_of, offsets, fmt), schemas.CONTACT_COLUMNS)


def _reference(spark, path, names, fmt) -> DataFrame:
    df = scan_text(spark, path, fmt)
    order = F.col("source_row").cast("bigint") if "source_row" in df.columns else None
    if order is None:
        raise ValueError("reference tables need a source_row column: it defines which match is first")
    out = rename_columns(df, {**names, "source_row": "source_row"})
    return out.withColumn("source_row", F.col("source_row").cast("bigint"))


def read_gazetteer(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    df = _reference(spark, path, schemas.GAZETTEER_COLUMNS, fmt)
    return df.withColumn("place_name", F.upper("place_name")).withColumn(
        "municipality_name", F.upper("municipality_name")
    )


def read_converter(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _reference(spark, path, schemas.CONVERTER_COLUMNS, fmt)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The stored history; empty when nothing has been written yet."""
    try:
        return spark.read.schema(schemas.HISTORY_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.HISTORY_SCHEMA)
