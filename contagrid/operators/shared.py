"""The summaries from one pass over each fact table.

Counts of all kinds of facts (cases, contacts, follow-up slots and first answers) are
rows of one tall cube. One aggregation of it fills a row per territory with
everything the summaries ask for, the distribution of contacts per case included;
totals rows are a rollup of that. So a summary of four cubes is one plan in
which every fact table is scanned once, and no table is written or read on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.fixed_values import DOMAIN, FOLLOWUP_WEEKS, Vocabulary
from contagrid.functions.numbers import percent, ratio, weighted_quantiles
from contagrid.operators.aggregates import with_totals
from contagrid.operators.filters import known_and_not_in
from contagrid.operators.outcomes import is_school_no_answer, outcome_category

#: Columns of the tall cube; a kind of fact fills some and leaves the others missing.
KEYS = {"kind": "string", "sve": "string", "n_contacts": "double", "setting": "string", "outcome": "string", "day": "int", "status": "string", "symptoms": "string"}
COUNTS = {"n": "bigint", "n_first": "bigint"}


def tall(kind: str | None, df: DataFrame) -> DataFrame:
    """A cube's rows as rows of the tall cube; ``kind`` None keeps the kind they carry."""
    columns = {**KEYS, **COUNTS}
    given = {c: F.col(c) if c in df.columns else F.lit(None) for c in columns}
    if kind is not None:
        given["kind"] = F.lit(kind)
    return df.select(*[given[c].cast(as_).alias(c) for c, as_ in columns.items()])


def territory_facts(cubes: Sequence[DataFrame], vocab: Vocabulary = DOMAIN, days: Sequence[int] = tuple(FOLLOWUP_WEEKS)) -> DataFrame:
    """One row per territory with the counts the summaries are made of; ``cubes`` are parts of the tall cube.

    ``per_case`` holds how many cases report each number of contacts: as many entries as there are such numbers.
    """
    rows = cubes[0]
    for more in cubes[1:]:
        rows = rows.unionByName(more)
    cube = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])
    case, contact, slot = (F.col("kind") == kind for kind in ("case", "contact", "slot"))
    reports = case & (F.col("n_contacts") > 0)
    followable = ~is_school_no_answer(vocab) & known_and_not_in(F.col("outcome"), vocab.not_followable)
    block_of = F.create_map(*[F.lit(x) for pair in vocab.outcome_labels for x in pair])
    block = F.element_at(block_of, outcome_category(vocab))
    later = F.col("day").isin(*days)

    def total(condition: Column, measure: str | Column = "n") -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(measure) if isinstance(measure, str) else measure)), F.lit(0))

    return cube.groupBy("sve").agg(
        total(case).alias("cases"),
        total(reports).alias("reporting_cases"),
        total(reports, F.col("n_contacts") * F.col("n")).alias("total_contacts"),
        F.collect_list(F.when(reports, F.struct(F.col("n_contacts").alias("value"), "n"))).alias("per_case"),
        total(contact & followable).alias("verified"),
        total(contact & (F.col("outcome") == vocab.accepted)).alias("accepted"),
        total(contact & (F.col("outcome") == vocab.became_case)).alias("confirmed"),
        total(contact & is_school_no_answer(vocab)).alias("school_no_answer"),
        total(contact & F.col("outcome").isNotNull()).alias("all_outcomes"),
        *[total(contact & F.col("outcome").isNotNull() & (block == b)).alias(f"block_{b}") for b in ("a", "b")],
        total(slot & later & (F.col("status") == vocab.done), "n_first").alias("done"),
        total(slot & (F.col("symptoms") == vocab.yes) & (later | (F.col("day") == 0))).alias("symptomatic"),
    )


def territory_measures(facts: DataFrame) -> DataFrame:
    """Cases, contacts, symptomatic and confirmed contacts of each territory that has any, without totals."""
    some = facts.where("cases > 0 OR symptomatic > 0 OR confirmed > 0")
    return some.select("sve", F.lit(False).alias("is_total"), "cases", F.col("total_contacts").alias("contacts"), "symptomatic", "confirmed")


def single_measures(facts: DataFrame, measures: Sequence[str], vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Some measures of the territories that have any of them, with a totals row."""
    some = facts.where(" OR ".join(f"{m} > 0" for m in measures))
    return with_totals(some, "sve", list(measures), vocab.total)


ADDED = (
    "cases", "reporting_cases", "total_contacts", "verified", "accepted", "in_followup", "symptomatic", "confirmed", "of_cases",
    "school_no_answer", "all_outcomes", "block_a", "block_b",
)


def summary_facts(facts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """The territories' counts with a totals row, shares, means and quartiles.

    Follow-ups count where a contact was verified, and the cases that confirmed contacts are compared with
    where one was confirmed; so the totals of both leave other territories out.
    """
    counted = facts.withColumns(
        {
            "in_followup": F.when(F.col("verified") > 0, F.col("accepted") + F.col("done")).otherwise(F.lit(0)),
            "of_cases": F.when(F.col("confirmed") > 0, F.col("cases")).otherwise(F.lit(0)),
        }
    )
    measures = {c: F.sum(c) for c in ADDED} | {"per_case": F.flatten(F.collect_list("per_case"))}
    table = with_totals(counted, "sve", measures, vocab.total)
    shares = {
        "reporting_pct": ("reporting_cases", "cases"),
        "accepted_pct": ("accepted", "verified"),
        "symptomatic_pct": ("symptomatic", "in_followup"),
        "confirmed_pct": ("confirmed", "of_cases"),
    }
    zero = F.lit(0.0)
    table = table.withColumns({name: F.coalesce(percent(F.col(part), F.col(whole)), zero) for name, (part, whole) in shares.items()})
    table = table.withColumn("mean_contacts", F.coalesce(ratio(F.col("total_contacts"), F.col("reporting_cases")), zero))
    return table.withColumn("quartiles", weighted_quantiles(F.col("per_case"), (0.0, 0.25, 0.5, 0.75, 1.0)))
