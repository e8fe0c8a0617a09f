"""Summary tables composed of the indicator tables (all label-sized)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.fixed_values import DOMAIN, MEASURE_LABELS, SPANISH_LABELS, WEEKLY_LINES, Vocabulary
from contagrid.functions.numbers import percent
from contagrid.functions.text import format_number, percent_label
from contagrid.operators.aggregates import count_rows, with_totals
from contagrid.operators.filters import fix_literals, known_and_not_in
from contagrid.operators.history import study_week
from contagrid.operators.ordering import totals_last
from contagrid.operators.outcomes import is_school_no_answer
from contagrid.operators.reshape import transpose
from contagrid.operators.territory import add_province
from contagrid.operators.windows import with_overall

SUMMARY_MEASURES = ("cases", "contacts", "symptomatic", "confirmed")
INFOGRAPHIC_MEASURES = tuple(MEASURE_LABELS)


def province_summary(measures: DataFrame, converter: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """The same measures added up per province, with a totals row."""
    placed = add_province(measures.where("NOT is_total"), converter)
    return with_totals(placed, "province", SUMMARY_MEASURES, vocab.total)


def national_summary(measures: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Measures per territory and share of all cases; some territories are reported as one."""
    rows = measures.where("NOT is_total").withColumn("sve", fix_literals(F.col("sve"), vocab.merged_territories))
    table = with_totals(rows, "sve", SUMMARY_MEASURES, vocab.total)
    table = with_overall(table, "__all", F.max(F.when(F.col("is_total"), F.col("cases"))))
    return table.withColumn("cases_pct", percent(F.col("cases"), F.col("__all"))).drop("__all")


def national_summary_es(national: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Spanish labels, without the share."""
    sve = F.when(F.col("is_total"), F.lit("Total")).otherwise(F.col("sve"))
    return national.select(
        sve.alias(SPANISH_LABELS["sve"]), *[F.col(m).alias(SPANISH_LABELS[m]) for m in SUMMARY_MEASURES]
    )


def verified_contacts(contacts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Followable contacts and those that accepted the first call, per territory."""
    followable = ~is_school_no_answer(vocab) & known_and_not_in(F.col("outcome"), vocab.not_followable)
    counts = contacts.groupBy("sve").agg(
        count_rows(contacts, followable).alias("verified"),
        count_rows(contacts, F.col("outcome") == vocab.accepted).alias("accepted"),
    )
    return counts.where("verified > 0")


def infographic(summary: DataFrame) -> DataFrame:
    """Thirteen measures per territory with a totals row, of the territories that have cases, contacts or symptoms."""
    some = summary.where("is_total OR cases > 0 OR verified > 0 OR symptomatic > 0 OR confirmed > 0")
    return some.select("sve", "is_total", *INFOGRAPHIC_MEASURES)


def territory_columns(table: DataFrame) -> list[str | None]:
    """The territories of a table with a totals row, in report order; the missing one is listed too.

    They become column headers, so they must reach the driver: one entry per territory.
    """
    return [r.sve for r in totals_last(table.select("sve", "is_total")).collect()]


def infographic_transposed(table: DataFrame, territories: Sequence[str | None]) -> DataFrame:
    """Measures as rows with their labels, one column per territory."""
    out = transpose(table, "sve", INFOGRAPHIC_MEASURES, territories)
    label = F.element_at(F.create_map(*[F.lit(x) for p in MEASURE_LABELS.items() for x in p]), F.col("measure"))
    return out.select(label.alias("label"), *out.columns)


def weekly_summary(summary: DataFrame, as_of: date) -> DataFrame:
    """The 26-line weekly report: label, numeric value and the value as written.

    The totals row becomes the lines by one expression.
    """
    quartile = lambda i: F.get("quartiles", F.lit(i))
    measures = {m: F.col(m).cast("double") for m in (*INFOGRAPHIC_MEASURES, "all_outcomes", "block_a", "block_b")}
    measures["median_contacts"], measures["max_contacts"] = quartile(2), quartile(4)
    measures["accepted_pct_no_school"] = percent(F.col("accepted"), F.col("verified") - F.col("school_no_answer"))
    lowest, first, median, third, highest = (format_number(quartile(i)) for i in range(5))
    texts = {
        "median_contacts": F.concat(median, F.lit(" ("), first, F.lit("-"), third, F.lit(")")),
        "max_contacts": F.concat(F.lit("("), lowest, F.lit("-"), highest, F.lit(")")),
    }
    year, week = study_week(as_of)
    missing = F.lit(None).cast("double")
    lines = [
        F.struct(
            F.lit(ord_).alias("ord"),
            F.lit(label).alias("label"),
            F.lit(measure).cast("string").alias("measure"),
            (missing if measure is None else measures[measure]).alias("value"),
            written_value(style, missing if measure is None else measures[measure], texts.get(measure)).alias("value_text"),
        )
        for ord_, label, measure, style in WEEKLY_LINES
    ]
    # without any facts there is no totals row, but there are lines
    totals = summary.groupBy().agg(F.first(F.when(F.col("is_total"), F.struct("*")), ignorenulls=True).alias("__totals")).select("__totals.*")
    return totals.select(F.inline(F.array(*lines))).select(F.lit(year).alias("iso_year"), F.lit(week).alias("iso_week"), "*")


def written_value(style: str | None, value: Column, text: Column | None) -> Column:
    if style == "percent":
        return percent_label(value)
    if style == "number":
        return format_number(value)
    return text if style == "text" else F.lit("")
