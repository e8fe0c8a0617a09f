"""Verification outcomes of contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.fixed_values import DOMAIN, Vocabulary
from contagrid.functions.numbers import percent
from contagrid.functions.text import outcome_label, replace_first
from contagrid.operators.aggregates import block_subtotals, count_rows, crosstab, level_columns, with_totals
from contagrid.operators.ordering import level_position
from contagrid.operators.windows import middle_from_end, running_total, with_overall


def is_school_no_answer(vocab: Vocabulary = DOMAIN) -> Column:
    return F.col("outcome").eqNullSafe(F.lit(vocab.no_answer)) & F.col("setting").eqNullSafe(F.lit(vocab.school))


def school_no_answer(contacts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """School contacts that did not answer, per territory, with share and totals."""
    rows = contacts.where(is_school_no_answer(vocab))
    counts = rows.groupBy("sve").agg(count_rows(rows).alias("n"))
    table = with_totals(counts, "sve", ["n"], vocab.total)
    table = with_overall(table, "__all", F.max(F.when(F.col("is_total"), F.col("n"))))
    return table.withColumn("pct", percent(F.col("n"), F.col("__all"))).drop("__all")


def outcome_category(vocab: Vocabulary = DOMAIN) -> Column:
    """Report label of a contact's outcome; school no-answers are their own."""
    merged = F.col("outcome")
    for old, new in vocab.merged_outcomes.items():
        merged = replace_first(merged, old, new)
    return F.when(is_school_no_answer(vocab), F.lit(vocab.school_no_answer_label)).otherwise(outcome_label(merged))


def outcome_breakdown(contacts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Counts and shares by outcome, two block subtotals and the total.

    ``kind`` is ``item``, ``block`` or ``total``; every expected label appears,
    with 0 where no contact has it, and unexpected ones stay in the total.
    """
    labels = [label for label, _ in vocab.outcome_labels]
    seen = contacts.where("outcome IS NOT NULL")
    counts = seen.groupBy(outcome_category(vocab).alias("label")).agg(count_rows(seen).alias("n"))
    expected = contacts.sparkSession.createDataFrame([(x, 0) for x in labels], "label string, n bigint")
    block_of = F.create_map(*[F.lit(x) for pair in vocab.outcome_labels for x in pair])
    merged = counts.unionByName(expected).withColumn("block", F.coalesce(F.element_at(block_of, F.col("label")), F.lit("other")))
    table = block_subtotals(merged, "block", "label")
    table = with_overall(table, "__all", F.max(F.when(F.col("kind") == "total", F.col("n"))))
    position = F.when(F.col("kind") == "item", level_position(F.col("label"), labels)).otherwise(F.lit(len(labels) + 2))
    return table.withColumn("pct", percent(F.col("n"), F.col("__all"))).withColumn("ord", position).drop("__all")


def outcome_by_territory(contacts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    columns = level_columns(vocab.outcomes)
    return with_totals(crosstab(contacts, "sve", "outcome", vocab.outcomes), "sve", columns, vocab.total)


def outcome_totals(contacts: DataFrame) -> DataFrame:
    """Contacts per outcome, missing outcomes included."""
    return contacts.groupBy("outcome").agg(count_rows(contacts).alias("n_contacts"))


def chart_outcomes(breakdown: DataFrame) -> DataFrame:
    """Outcome shares with the label position of a ring stacked from the end."""
    items = breakdown.where("kind = 'item'").select("ord", "label", "n", "pct")
    return middle_from_end(running_total(items, "pct", ["ord", "label"], "running_pct"), "pct", "running_pct")
