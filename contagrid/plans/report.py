"""The weekly report job.

    spark-submit -m contagrid.plans.report --patients P --contacts C \
        --gazetteer G --converter K --history H --out O --as-of 2020-12-21

Work grows with the facts in four places only: two scans with their distinct,
the case/contact join, and the aggregations to cubes. Everything after the cubes
handles label-sized tables.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from contagrid.fixed_values import DOMAIN, FOLLOWUP_WEEKS, Vocabulary
from contagrid.operators import cases, files, followup as follow, history as past, outcomes, settings, shared, summaries
from contagrid.operators.cubes import case_cube, contact_cube
from contagrid.operators.filters import with_placeholder
from contagrid.operators.lookups import duplicate_keys
from contagrid.operators.ordering import level_position, totals_last
from contagrid.operators.quality import unreadable_dates
from contagrid.operators.territory import (
    resolve_contact_territory,
    resolve_territory,
    territory_display_name,
    unresolved,
)
from contagrid.functions.dates import DAY_MONTH_YEAR, MONTH_DAY_YEAR, YEAR_MONTH_DAY, snapshot_monday
from contagrid.session import Stage, build_session
from contagrid.sources import readers, sinks


@dataclass
class Inputs:
    patients: DataFrame
    contacts: DataFrame
    gazetteer: DataFrame
    converter: DataFrame
    history: DataFrame


def read_inputs(spark: SparkSession, paths: dict[str, str], as_of: date, fmt: str = "parquet") -> Inputs:
    return Inputs(
        readers.read_patients(spark, paths["patients"], as_of, fmt=fmt),
        readers.read_contacts(spark, paths["contacts"], as_of, fmt=fmt),
        readers.read_gazetteer(spark, paths["gazetteer"], fmt),
        readers.read_converter(spark, paths["converter"], fmt),
        readers.read_history(spark, paths["history"]),
    )


def report_tables(
    spark: SparkSession, inputs: Inputs, as_of: date, vocab: Vocabulary = DOMAIN, stage: Stage | None = None
) -> dict[str, DataFrame]:
    """All result tables by name, chart tables and the history rows included.

    They read the tables in ``stage``, which the caller removes when they are written.
    """
    stage = stage or Stage(spark)
    study = F.col("snapshot_week") == F.lit(snapshot_monday(as_of, -1))

    # names are harmonised before any grouping, so merged territories add up
    patients = stage(
        territory_display_name(resolve_territory(inputs.patients, inputs.gazetteer, inputs.converter, vocab), vocab),
        "patients",
    )
    contacts = resolve_contact_territory(
        inputs.contacts, patients, inputs.gazetteer, vocab, partition_keys=("snapshot_week",)
    )
    contacts = territory_display_name(contacts, vocab)
    study_patients = patients.where(study)
    study_contacts = stage(
        contacts.where(study).select("case_cip", "sve", "setting", "outcome", "symptoms_day0", "birth_date"),
        "study_contacts",
    )
    by_case, by_contact, followups = stage.together(
        case_cube=case_cube(study_patients),
        contact_cube=contact_cube(study_contacts, as_of),
        followup_cube=follow.followup_cube(contacts, as_of, weeks=FOLLOWUP_WEEKS, vocab=vocab, first_week=-1),
    )

    t: dict[str, DataFrame] = {}
    indicators = stage(cases.case_contact_indicators(by_case, vocab, stage), "indicators")
    t["case_contact_indicators"] = indicators.drop("contacts_per_case")
    t["origin_split"] = cases.origin_split(by_case, vocab)
    t["contacts_per_case"] = cases.contacts_per_case(by_case)
    t["heavy_reporters"] = cases.heavy_reporters(study_patients, study_contacts, as_of, vocab=vocab)
    t["school_split"] = files.school_split(files.case_counts(study_patients, study_contacts, vocab), vocab)
    t["became_cases"] = became = cases.became_cases(by_contact, indicators, vocab)

    current = past.history_row(indicators, as_of)
    year, week = past.study_week(as_of)
    older = inputs.history.where(f"NOT (iso_year = {year} AND iso_week = {week})")
    weeks = past.week_over_week(older.unionByName(current), as_of, vocab)
    t["week_over_week"] = weeks.drop("not_informed_pct", "previous_not_informed_pct")

    base = settings.setting_base(by_contact, vocab)
    t["setting_totals"] = settings.setting_totals(base)
    t["setting_by_territory"] = settings.setting_by_territory(base, vocab)
    t["setting_by_age"] = settings.setting_by_age(base, vocab)
    t["setting_by_territory_age"] = settings.setting_by_territory_age(base, vocab)
    t["setting_by_outcome"] = settings.setting_by_outcome(base, vocab)

    t["outcome_breakdown"] = breakdown = outcomes.outcome_breakdown(by_contact, vocab)
    t["school_no_answer"] = outcomes.school_no_answer(by_contact, vocab)
    t["outcome_by_territory"] = outcomes.outcome_by_territory(by_contact, vocab)
    t["outcome_totals"] = outcomes.outcome_totals(by_contact)

    t["followups"] = follow.followup_table(followups, vocab=vocab)
    t["isolation_reasons"] = follow.isolation_reasons(followups)
    t["symptomatic"] = symptoms = follow.symptom_evolution(None, followups, vocab.yes, vocab=vocab)
    t["asymptomatic"] = follow.symptom_evolution(None, followups, vocab.no, vocab=vocab)

    cubes = [shared.tall("case", by_case), shared.tall("contact", by_contact), shared.tall("slot", followups)]
    facts = stage(shared.territory_facts(cubes, vocab), "facts")
    measures = shared.territory_measures(facts)
    national = summaries.national_summary(measures, vocab)
    t["province_summary"] = summaries.province_summary(measures, inputs.converter, vocab)
    t["national_summary"] = national
    t["national_summary_es"] = summaries.national_summary_es(national, vocab)
    t["symptomatic_total"] = cases.single_measure(symptoms, "total", "symptomatic")
    t["became_cases_total"] = cases.single_measure(became, "yes_n", "confirmed")

    summary = shared.summary_facts(facts, vocab)
    graphic = stage(summaries.infographic(summary), "infographic")
    t["infographic"] = summaries.infographic_transposed(graphic, summaries.territory_columns(graphic))
    t["weekly_summary"] = summaries.weekly_summary(summary, as_of)

    t["chart_week_over_week"] = past.chart_week_over_week(weeks, as_of)
    t["chart_setting_totals"] = settings.chart_labels(settings.chart_setting_totals(base), vocab)
    t["chart_setting_by_age"] = settings.chart_labels(settings.chart_setting_by_age(base), vocab)
    t["chart_outcomes"] = outcomes.chart_outcomes(breakdown)

    # contacts of the older snapshots take their territory from those weeks' cases
    t["unresolved_places"] = unresolved(patients, ("snapshot_week",))
    t["ambiguous_cases"] = duplicate_keys(patients, "cip", "sve", ("snapshot_week",))
    birth = {"birth_date": (DAY_MONTH_YEAR, MONTH_DAY_YEAR, YEAR_MONTH_DAY)}
    slots = {c: (DAY_MONTH_YEAR,) for c in ("date_1", "date_2")}
    t["unreadable_dates"] = unreadable_dates(inputs.patients, birth, "patients").union(
        unreadable_dates(inputs.contacts, birth | slots, "contacts")
    )
    t["history"] = current
    return t


def in_report_order(tables: dict[str, DataFrame], vocab: Vocabulary = DOMAIN) -> dict[str, DataFrame]:
    """Tables sorted the way readers see them; an empty follow-up table says so in one row."""
    out = {}
    for name, df in tables.items():
        if name in ("followups", "isolation_reasons", "symptomatic", "asymptomatic"):
            df = with_placeholder(df, vocab.placeholder)
        if "is_total" in df.columns:
            key = next(k for k in ("sve", "province", "age_band", "setting") if k in df.columns)
            df = df.orderBy("is_total", "ord") if "ord" in df.columns else totals_last(df, key)
        elif "ord" in df.columns:
            df = df.orderBy("ord", *[c for c in ("kind", "block") if c in df.columns])
        elif name == "setting_by_territory_age":
            bands = [label for label, _, _ in settings.AGE_BANDS]
            df = df.orderBy(F.collate("sve", "ca"), level_position(F.col("age_band"), bands))
        out[name] = df
    return out


def run_report(
    spark: SparkSession,
    paths: dict[str, str],
    out: str,
    as_of: date,
    fmt: str = "parquet",
    vocab: Vocabulary = DOMAIN,
    export: str | None = None,
) -> dict[str, str]:
    """Compute and write every table, then add the week to the history.

    ``export`` names a folder for labelled CSV copies, made from the written
    tables so that nothing is computed twice.
    """
    stage = Stage(spark)
    try:
        tables = report_tables(spark, read_inputs(spark, paths, as_of, fmt), as_of, vocab, stage)
        current = tables.pop("history")
        written = sinks.write_tables(in_report_order(tables, vocab), out, as_of)
        if export:
            stored = {name: spark.read.schema(df.schema).parquet(written[name]) for name, df in tables.items()}
            copies = {name: sinks.labelled(name, df, as_of, vocab) for name, df in in_report_order(stored, vocab).items()}
            sinks.write_tables(copies, export, as_of, "csv")
        sinks.update_history(paths["history"], current)
    finally:
        stage.remove()
    return written


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Write the weekly case and contact report.")
    for name in ("patients", "contacts", "gazetteer", "converter", "history", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--as-of", required=True, type=date.fromisoformat)
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    parser.add_argument("--export", help="folder for labelled CSV copies")
    args = vars(parser.parse_args(argv))
    out, as_of, fmt, export = (args.pop(k) for k in ("out", "as_of", "format", "export"))
    spark = build_session("contagrid weekly report")
    for name, path in run_report(spark, args, out, as_of, fmt, export=export).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
