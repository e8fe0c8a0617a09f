"""Indicators over cases: counts, contacts per case, origin, school, heavy reporters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from contagrid.fixed_values import DOMAIN, Vocabulary
from contagrid.functions.dates import DAY_MONTH_YEAR, YEAR_MONTH_DAY, age_years, parse_date
from contagrid.functions.numbers import percent, ratio
from contagrid.operators.aggregates import count_rows, crosstab, level_columns, row_total, with_totals
from contagrid.operators.bitmaps import id_filter, may_be_in
from contagrid.operators.distribution import Keep, quantiles
from contagrid.operators.lookups import non_members
from contagrid.operators.windows import share_of_total

INDICATOR_COLUMNS = (
    "cases", "reporting_cases", "reporting_pct", "contacts_per_case", "total_contacts", "mean_contacts",
    "median_contacts", "iqr_contacts", "q25_contacts", "q75_contacts", "min_contacts", "max_contacts",
)


def case_contact_indicators(patients: DataFrame, vocab: Vocabulary = DOMAIN, keep: Keep | None = None) -> DataFrame:
    """Cases, reporting cases and the distribution of contacts per reporting case.

    ``patients`` are rows or a case cube. The first aggregation makes a
    histogram per territory, combined on the map side; means, exact quartiles
    and the totals row are then computed from the histogram, so no statistic
    ever sees the people of a territory in one place. With ``keep`` the quartiles are found by rank over
    range partitions, so that not even the different numbers of contacts stand in one place.
    """
    v = F.col("n_contacts")
    histogram = patients.groupBy("sve", "n_contacts").agg(count_rows(patients).alias("n"))
    reports = v > 0
    value, weight = F.when(reports, v), F.when(reports, F.col("n"))
    shares = (0.25, 0.5, 0.75)
    measures = {
        "cases": F.sum("n"),
        "reporting_cases": F.sum(weight),
        "total_contacts": F.sum(value * weight),
        "min_contacts": F.min(value),
        "max_contacts": F.max(value),
    }
    if keep is None:
        measures["quartiles"] = F.percentile(value, F.array(*map(F.lit, shares)), F.coalesce(weight, F.lit(0)))
        stats = with_totals(histogram, "sve", measures, vocab.total)
    else:
        histogram = keep(histogram, "histogram")
        stats = with_totals(histogram, "sve", measures, vocab.total)
        both = [F.struct(F.lit(t).alias("__total"), key.cast("string").alias("__sve"), "n_contacts", "n") for t, key in ((False, F.col("sve")), (True, F.lit(None)))]
        found = quantiles(histogram.where(reports).select(F.inline(F.array(*both))), "n_contacts", ["__total", "__sve"], shares, keep, "n")
        key = F.when(~F.col("is_total"), F.col("sve"))
        same = (F.col("is_total") == F.col("__total")) & key.eqNullSafe(F.col("__sve"))
        stats = stats.join(found.select("__total", "__sve", "quantiles"), same, "left").withColumnRenamed("quantiles", "quartiles")
    q = lambda i: F.element_at("quartiles", i)
    per_case = ratio(F.col("total_contacts"), F.col("reporting_cases"))
    return (
        stats.withColumn("reporting_pct", percent(F.col("reporting_cases"), F.col("cases")))
        .withColumn("contacts_per_case", per_case)
        .withColumn("mean_contacts", per_case)
        .withColumn("q25_contacts", q(1))
        .withColumn("median_contacts", q(2))
        .withColumn("q75_contacts", q(3))
        .withColumn("iqr_contacts", q(3) - q(1))
        .select("sve", "is_total", *INDICATOR_COLUMNS)
    )


def origin_split(patients: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Cases by the two source systems, side by side, with shares and totals."""
    first, second = vocab.origins
    known = patients.where(F.col("origin").isin(first, second))
    by_territory = known.groupBy("sve").agg(
        count_rows(known, F.col("origin") == first).alias("first_n"),
        count_rows(known, F.col("origin") == second).alias("second_n"),
    )
    both = F.col("first_n") + F.col("second_n")
    return (
        with_totals(by_territory, "sve", ["first_n", "second_n"], vocab.total)
        .withColumn("first_pct", percent(F.col("first_n"), both))
        .withColumn("second_pct", percent(F.col("second_n"), both))
        .withColumn("total", both)
    )


def contacts_per_case(patients: DataFrame) -> DataFrame:
    """How many reporting cases have each number of contacts, most frequent first."""
    reporting = patients.where("n_contacts > 0")
    counts = reporting.groupBy("n_contacts").agg(count_rows(reporting).alias("informed_cases"))
    return share_of_total(counts, "informed_cases", "pct", 3).orderBy(F.col("informed_cases").desc(), "n_contacts")


def reporting_case_ids(patients: DataFrame) -> DataFrame:
    """Ids of cases that reported contacts."""
    return patients.where("n_contacts > 0").select("cip").distinct()


def school_case_ids(contacts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Ids of cases with at least one school contact."""
    return contacts.where(F.col("setting") == vocab.school).select("case_cip").distinct()


def cases_without_school(patients: DataFrame, contacts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Ids of reporting cases with no school contact (anti join)."""
    return non_members(reporting_case_ids(patients), school_case_ids(contacts, vocab), "cip", "case_cip")


def heavy_reporters(
    patients: DataFrame,
    contacts: DataFrame,
    as_of: date,
    minimum: int = 20,
    vocab: Vocabulary = DOMAIN,
    settings: Sequence[str] | None = None,
) -> DataFrame:
    """Cases that report at least ``minimum`` contacts, with their contacts by setting.

    A filter made of such cases' ids, of a fixed size, keeps other contacts from being
    shuffled. Those it lets through are counted per case before they meet the
    cases: a case with very many is reduced to a row on the map side.
    """
    levels = list(settings) if settings is not None else [*vocab.settings, vocab.school, vocab.unknown_setting]
    heavy = patients.where(F.col("n_contacts") >= minimum)
    birth = parse_date(F.col("birth_date"), DAY_MONTH_YEAR, YEAR_MONTH_DAY)
    people = heavy.select(
        "cip", "gender", age_years(birth, as_of).alias("age"), "place_name", "sve",
        F.col("n_contacts").alias("n_contacts_reported"),
    )
    columns = level_columns(levels)
    listed = may_be_in(contacts.select("case_cip", "setting"), "case_cip", id_filter(heavy, "cip"))
    per_case = crosstab(listed, "case_cip", "setting", levels)
    per_case = row_total(per_case, columns, "n_contacts_listed").withColumnRenamed("case_cip", "cip")
    return people.join(per_case, "cip", "left").orderBy(F.col("n_contacts_reported").desc(), "cip")


def became_cases(contacts: DataFrame, indicators: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Contacts verified as cases against the territory's cases.

    Only territories with such a contact are listed; shares are over both sides.
    """
    turned = contacts.where(F.col("outcome") == vocab.became_case)
    yes = turned.groupBy("sve").agg(count_rows(turned).alias("yes_n"))
    cases = indicators.where("NOT is_total").select(F.col("sve").alias("__sve"), F.col("cases").alias("total_n"))
    joined = yes.join(cases, F.col("sve").eqNullSafe(F.col("__sve")), "left")
    table = joined.select(
        "sve",
        F.coalesce(F.col("total_n") - F.col("yes_n"), F.lit(0)).alias("no_n"),
        "yes_n",
        F.coalesce("total_n", F.lit(0)).alias("total_n"),
    )
    both = F.col("no_n") + F.col("yes_n")
    return (
        with_totals(table, "sve", ["no_n", "yes_n", "total_n"], vocab.total)
        .withColumn("no_pct", percent(F.col("no_n"), both))
        .withColumn("yes_pct", percent(F.col("yes_n"), both))
    )


def single_measure(table: DataFrame, measure: str, name: str) -> DataFrame:
    """One measure per territory with its totals row."""
    return table.select("sve", "is_total", F.col(measure).alias(name))
