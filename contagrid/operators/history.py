"""Week-over-week change against the stored history.

History is long: one row per ISO year, ISO week and territory, without totals.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.fixed_values import DOMAIN, Vocabulary
from contagrid.functions.dates import iso_week, iso_year, iso_year_week
from contagrid.functions.numbers import percent
from contagrid.operators.aggregates import with_totals

HISTORY_COLUMNS = ("iso_year", "iso_week", "sve", "ci", "cni")


def study_week(as_of: date) -> tuple[int, int]:
    return iso_year_week(as_of - timedelta(weeks=1))


def previous_study_week(as_of: date) -> tuple[int, int]:
    return iso_year_week(as_of - timedelta(weeks=2))


def history_row(indicators: DataFrame, as_of: date) -> DataFrame:
    """This week's rows for the history: reporting and not-reporting cases."""
    year, week = study_week(as_of)
    reporting = F.coalesce("reporting_cases", F.lit(0))
    return indicators.where("NOT is_total").select(
        F.lit(year).alias("iso_year"),
        F.lit(week).alias("iso_week"),
        "sve",
        reporting.cast("bigint").alias("ci"),
        (F.col("cases") - reporting).cast("bigint").alias("cni"),
    )


def new_history_rows(history: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``current`` whose week is not stored yet."""
    weeks = history.select("iso_year", "iso_week").distinct()
    return current.join(weeks, ["iso_year", "iso_week"], "left_anti").select(*HISTORY_COLUMNS)


def weekly_counts(patients: DataFrame) -> DataFrame:
    """History rows of every snapshot week in ``patients``, counted in one pass."""
    reporting = F.count_if(F.col("n_contacts") > 0)
    return (
        patients.groupBy("snapshot_week", "sve")
        .agg(reporting.alias("ci"), (F.count("*") - reporting).alias("cni"))
        .select(iso_year(F.col("snapshot_week")).cast("int").alias("iso_year"), iso_week(F.col("snapshot_week")).alias("iso_week"), "sve", "ci", "cni")
    )


def week_over_week(weeks: DataFrame, as_of: date, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Share of reporting cases this week and last, and the change in points.

    ``weeks`` are history rows, the study week's among them. Both weeks are read in one
    pass. Territories are those of this week; last week's totals use all of its rows.
    """

    def of(week: tuple[int, int], measure: str) -> Column:
        return F.sum(F.when((F.col("iso_year") == week[0]) & (F.col("iso_week") == week[1]), F.col(measure)))

    now, then = study_week(as_of), previous_study_week(as_of)
    columns = {"informed": of(now, "ci"), "not_informed": of(now, "cni"), "previous_informed": of(then, "ci"), "previous_not_informed": of(then, "cni")}
    wide = weeks.groupBy("sve").agg(*[c.alias(name) for name, c in columns.items()])
    both = with_totals(wide, "sve", list(columns), vocab.total)
    both = both.withColumn("total", F.col("informed") + F.col("not_informed")).where("total IS NOT NULL")
    before = F.col("previous_informed") + F.col("previous_not_informed")
    return (
        both.withColumn("informed_pct", percent(F.col("informed"), F.col("total")))
        .withColumn("not_informed_pct", percent(F.col("not_informed"), F.col("total")))
        .withColumn("previous_informed_pct", percent(F.col("previous_informed"), before))
        .withColumn("previous_not_informed_pct", percent(F.col("previous_not_informed"), before))
        .withColumn("change_points", F.round(F.col("informed_pct") - F.col("previous_informed_pct"), 1))
        .drop("previous_informed", "previous_not_informed")
    )


def chart_week_over_week(table: DataFrame, as_of: date) -> DataFrame:
    """Long form for the chart: territory, state and week, percentage."""
    this, last = study_week(as_of)[1], previous_study_week(as_of)[1]
    states = {
        f"I_SE{this}": "informed_pct",
        f"I_SE{last}": "previous_informed_pct",
        f"NI_SE{this}": "not_informed_pct",
        f"NI_SE{last}": "previous_not_informed_pct",
    }
    wide = table.where("NOT is_total").select("sve", *[F.col(c).alias(s) for s, c in states.items()])
    return wide.unpivot(["sve"], list(states), "state", "pct")
