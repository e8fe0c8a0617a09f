"""Result tables and the weekly history."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from contagrid.fixed_values import (
    COLUMN_LABELS,
    DOMAIN,
    OTHER_LEVELS_LABEL,
    OUTCOME_TABLES,
    SETTING_TABLES,
    SHEET_NAMES,
    UNSHOWN_COLUMNS,
    Vocabulary,
)
from contagrid.functions.text import format_number, percent_label, slug
from contagrid.operators.history import new_history_rows, previous_study_week, study_week
from contagrid.session import run_together
from contagrid.sources.published import Folder
from contagrid.sources.readers import read_history


def week_folder(out: str, as_of: date) -> str:
    year, week = study_week(as_of)
    return f"{out.rstrip('/')}/iso_year={year}/iso_week={week:02d}"


def sheet(name: str) -> str:
    """The name a table goes by in the report; its own where the report has none for it."""
    return SHEET_NAMES.get(name, name)


def labelled(name: str, df: DataFrame, as_of: date, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """A table as readers see it: its headers, percentages and spreads written as text, and no helping columns."""
    weeks = {"now": study_week(as_of)[1], "before": previous_study_week(as_of)[1]}
    labels = {c: text.format(**weeks) for c, text in COLUMN_LABELS.get(name, {}).items()}
    if name in SETTING_TABLES:
        labels = {slug(x): x for x in (*vocab.settings, vocab.school, vocab.unknown_setting)} | {"unknown": OTHER_LEVELS_LABEL} | labels
    if name in OUTCOME_TABLES:
        labels = {slug(x): x for x in vocab.outcomes} | {"unknown": OTHER_LEVELS_LABEL} | labels
    if name == "outcome_breakdown":
        # blocks and the total have no label of their own
        df = df.withColumn("label", F.coalesce("label", F.concat(F.lit("3.1"), "block"), F.lit(vocab.total)))
    if "iqr_contacts" in df.columns:
        spread = [format_number(F.col(c)) for c in ("iqr_contacts", "q25_contacts", "q75_contacts")]
        df = df.withColumn("iqr_contacts", F.concat(spread[0], F.lit(" ("), spread[1], F.lit("-"), spread[2], F.lit(")")))
    shares = [c for c, kind in df.dtypes if (c == "pct" or c.endswith("_pct")) and kind == "double"]
    return df.withColumns({c: percent_label(F.col(c)) for c in shares}).drop(*UNSHOWN_COLUMNS).withColumnsRenamed(labels)


def write_tables(tables: Mapping[str, DataFrame], out: str, as_of: date, fmt: str = "parquet") -> dict[str, str]:
    """The week's tables under their names in the report, published together.

    They are written beside those of an earlier run and take their place when all
    are there; if one fails, the earlier ones stay. Returns the path of each.
    """
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession

    def save(df: DataFrame, path: str) -> None:
        writer = df.write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(path)

    def write(version: str) -> None:
        run_together(spark, {name: lambda df=df, name=name: save(df, f"{version}/{sheet(name)}") for name, df in tables.items()})

    version = Folder(spark, week_folder(out, as_of)).replace(write)
    return {name: f"{version}/{sheet(name)}" for name in tables}


def read_table(spark: SparkSession, out: str, name: str, as_of: date, fmt: str = "parquet") -> DataFrame:
    """A published table of a week."""
    version = Folder(spark, week_folder(out, as_of)).current()
    if version is None:
        raise FileNotFoundError(f"no report of that week in {out}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{version}/{sheet(name)}")


def update_history(history_path: str, current: DataFrame, replace: bool = True) -> DataFrame:
    """Store this week in the history; a re-run with corrected data replaces the week.

    Only the week's own partition is written, so runs of different weeks don't
    touch each other and two runs of one week leave it there once. Without ``replace`` a
    week that is already there is left as it is; that takes a look at the
    partition columns first, so such runs must not overlap.
    """
    spark = current.sparkSession
    if replace:
        writer = current.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        current = new_history_rows(read_history(spark, history_path), current)
        writer = current.write.mode("append")
    writer.partitionBy("iso_year", "iso_week").parquet(history_path)
    return read_history(spark, history_path)
