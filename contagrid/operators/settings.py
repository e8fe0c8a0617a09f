"""Exposure settings of contacts by territory, age band and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contagrid.fixed_values import AGE_BANDS, DOMAIN, Vocabulary
from contagrid.functions.numbers import percent
from contagrid.functions.text import sentence_case
from contagrid.operators.aggregates import count_rows, crosstab, level_columns, row_total, with_totals
from contagrid.operators.ordering import level_position
from contagrid.operators.windows import middle_of_segment, running_total, share_within, with_overall


def setting_base(cube: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """The part of a contact cube with a known non-school setting and a valid age.

    The setting test is on a plain column and reaches the scan. The age test
    involves ``n`` so that it stays above the cube's aggregation: pushed below,
    it would parse every birth date a second time.
    """
    setting = F.col("setting")
    known = cube.where(setting.isNotNull() & ~setting.isin(vocab.school, vocab.unknown_setting))
    return known.where("if(age_band IS NOT NULL, n, 0) > 0")


def setting_totals(base: DataFrame) -> DataFrame:
    return base.groupBy("setting").agg(count_rows(base).alias("n_contacts"))


def setting_by_territory(base: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    columns = level_columns(vocab.settings)
    return with_totals(crosstab(base, "sve", "setting", vocab.settings), "sve", columns, vocab.total)


def setting_by_age(base: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    columns = level_columns(vocab.settings)
    table = with_totals(crosstab(base, "age_band", "setting", vocab.settings), "age_band", columns, vocab.total)
    order = level_position(F.col("age_band"), [label for label, _, _ in AGE_BANDS])
    return table.withColumn("ord", order)


def setting_by_territory_age(base: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Territory and age band by setting, with the row total."""
    table = crosstab(base, ["sve", "age_band"], "setting", vocab.settings)
    return row_total(table, level_columns(vocab.settings), "total")


def setting_by_outcome(base: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    columns = level_columns(vocab.outcomes)
    return with_totals(crosstab(base, "setting", "outcome", vocab.outcomes), "setting", columns, vocab.total)


def chart_setting_by_age(base: DataFrame) -> DataFrame:
    """Share of each setting inside its age band (stacked to 1)."""
    counts = base.groupBy("age_band", "setting").agg(count_rows(base).alias("n_contacts"))
    return share_within(counts, "age_band", "n_contacts")


def chart_labels(chart: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """A chart's settings as its legend has them: in sentence case, those outside the report's order left out."""
    return chart.where(F.col("setting").isin(*vocab.settings)).withColumn("setting", sentence_case(F.col("setting")))


def chart_setting_totals(base: DataFrame) -> DataFrame:
    """Share of each setting with running total and label position."""
    totals = with_overall(setting_totals(base), "__all", F.sum("n_contacts"))
    shares = totals.withColumn("pct", percent(F.col("n_contacts"), F.col("__all"))).drop("__all")
    return middle_of_segment(running_total(shares, "pct", ["setting"], "running_pct"), "pct", "running_pct")
