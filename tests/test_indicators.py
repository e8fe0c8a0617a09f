from __future__ import annotations

import math
import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from contagrid.operators import cases, files, history, outcomes, settings, shared, summaries
from contagrid.operators.cubes import case_cube, contact_cube
from contagrid.sources import readers, sinks
from helpers import AS_OF, CASES, CONTACTS, CONVERTER, frame, table

SPREAD = ("median_contacts", "q25_contacts", "q75_contacts", "iqr_contacts", "min_contacts", "max_contacts")


@pytest.fixture(scope="module")
def patients(spark):
    rows = [
        ("1", "A", 1.0, "eCap"), ("2", "A", 2.0, "eCap"), ("3", "A", 4.0, "COVID19"), ("4", "A", 0.0, None),
        ("5", "B", None, "COVID19"), ("6", "B", 0.0, "COVID19"), ("7", "C", 5.0, "altres"), ("8", None, 2.0, "eCap"),
    ]
    return frame(spark, rows, CASES)


@pytest.fixture(scope="module")
def contacts(spark):
    rows = [
        ("1", "A", "escolar", "no contesta", "Sí", "1/1/2010"),
        ("1", "A", "laboral", "CIP vàlid", "No", "1/1/1980"),
        ("2", "A", None, "és cas", "Sí", "1/1/1950"),
        ("3", "B", "social", "contacte no vàlid", None, "1/1/2000"),
        ("3", "B", "domicili", "no contesta", "Sí", "30/2/1990"),
        ("3", "B", "desconegut", "no és contacte", None, "1/1/1990"),
        ("7", "C", "escolar", "rebutja", "No", None),
        ("7", "C", "social", None, "No", "1990-05-06"),
        ("9", None, "altres", "migrat SVE", "Sí", "1/1/1990"),
    ]
    return frame(spark, rows, CONTACTS)


@pytest.fixture(scope="module")
def indicators(patients):
    return cases.case_contact_indicators(patients)


def test_indicators(indicators):
    got = table(indicators, ["sve", "is_total"], "cases", "reporting_cases", "reporting_pct", "contacts_per_case", *SPREAD)
    assert got[("A", False)] == (4, 3, 75.0, 2.3, 2.0, 1.5, 3.0, 1.5, 1.0, 4.0)
    # a territory without reporting cases has no share and no statistics
    assert got[("B", False)] == (2, None, None, None, *[None] * 6)
    assert got[("Totals", True)] == (8, 5, 62.5, 2.8, 2.0, 2.0, 4.0, 2.0, 1.0, 5.0)
    assert (None, False) in got


def test_indicators_equal_plain_statistics(spark):
    rng = random.Random(11)
    rows = [(str(i), rng.choice("AABC"), float(rng.choice([0, 1, 2, 3, 5, 8, 40])), None) for i in range(400)]
    got = table(cases.case_contact_indicators(case_cube(frame(spark, rows, CASES))), "sve", "cases", "total_contacts", "mean_contacts", *SPREAD[:3])
    for sve in ("A", "B", "C", "Totals"):
        mine = [r for r in rows if sve in (r[1], "Totals")]
        values = sorted(r[2] for r in mine if r[2] > 0)
        q25, q50, q75 = statistics.quantiles(values, n=4, method="inclusive")
        assert got[sve] == (len(mine), sum(values), math.floor(sum(values) / len(values) * 10 + 0.5) / 10, q50, q25, q75)


def test_origin_split(patients):
    got = table(cases.origin_split(patients), "sve", "first_n", "first_pct", "second_n", "second_pct", "total")
    assert got["A"] == (2, 66.7, 1, 33.3, 3) and got["B"] == (0, 0.0, 2, 100.0, 2)
    assert "C" not in got and got["Totals"] == (3, 50.0, 3, 50.0, 6)


def test_contacts_per_case_is_numeric_and_most_frequent_first(patients):
    rows = cases.contacts_per_case(patients).collect()
    assert [tuple(r) for r in rows] == [(2.0, 2, 40.0), (1.0, 1, 20.0), (4.0, 1, 20.0), (5.0, 1, 20.0)]


def test_school_split(spark, patients, contacts):
    columns = ("cases_with_school", "cases_without_school", "school_contacts", "other_contacts", "school_ratio", "other_ratio")
    got = table(files.school_split(files.case_counts(patients, contacts)), ["sve", "is_total"], *columns)
    assert got[("A", False)] == (1, 2, 1, 2, 1.0, 1.0)
    assert got[("B", False)] == (0, 0, 0, 3, 0.0, 0.0)
    assert got[("Totals", True)] == (2, 3, 2, 7, 1.0, 2.3)
    assert {r.cip for r in cases.cases_without_school(patients, contacts).collect()} == {"2", "3", "8"}


def test_school_split_decides_by_case_id(spark, contacts):
    # one id twice: it reports in one row, so both rows count as reporting
    twice = frame(spark, [("5", "B", 3.0, None), ("5", "D", 0.0, None)], CASES)
    got = table(files.school_split(files.case_counts(twice, contacts)), "sve", "cases_without_school")
    assert got["B"] == 1 and got["D"] == 1 and got["Totals"] == 2


def test_heavy_reporters(spark):
    schema = "cip string, gender string, birth_date string, place_name string, sve string, n_contacts double"
    people = frame(
        spark,
        [("1", "dona", "21/12/2000", "P", "A", 20.0), ("2", "home", "1990-01-01", "P", "A", 35.0), ("3", None, None, None, None, 19.0)],
        schema,
    )
    listed = frame(spark, [("1", "social"), ("1", "social"), ("1", None), ("3", "social")], "case_cip string, setting string")
    rows = cases.heavy_reporters(people, listed, AS_OF).collect()
    assert [(r.cip, r.age, r.n_contacts_reported) for r in rows] == [("2", 30, 35.0), ("1", 20, 20.0)]
    assert (rows[0].social, rows[0].n_contacts_listed) == (None, None)
    assert (rows[1].social, rows[1].unknown, rows[1].n_contacts_listed) == (2, 1, 3)


def test_became_cases(contacts, indicators):
    got = table(cases.became_cases(contacts, indicators), "sve", "no_n", "yes_n", "total_n", "yes_pct")
    assert got == {"A": (3, 1, 4, 25.0), "Totals": (3, 1, 4, 25.0)}


def test_setting_tables(contacts):
    base = settings.setting_base(contact_cube(contacts, AS_OF))
    # school, unknown and missing settings and impossible birth dates are out
    assert table(settings.setting_totals(base), "setting", "n_contacts") == {"laboral": 1, "social": 2, "altres": 1}
    assert table(settings.setting_by_territory(base), ["sve", "is_total"], "social", "laboral", "altres")[("Totals", True)] == (2, 1, 1)
    by_age = table(settings.setting_by_age(base), "age_band", "social", "ord")
    assert by_age["20-39 anys"] == (2, 3) and by_age["Totals"] == (2, 7)
    both = settings.setting_by_territory_age(base)
    assert sum(r.total for r in both.collect()) == 4
    assert table(settings.setting_by_outcome(base), "setting", "unknown", "contacte_no_valid")["social"] == (1, 1)
    shares = table(settings.chart_setting_totals(base), "setting", "pct", "running_pct", "label_position")
    assert shares == {"altres": (25.0, 25.0, 12.5), "laboral": (25.0, 50.0, 37.5), "social": (50.0, 100.0, 75.0)}
    per_band = settings.chart_setting_by_age(base).groupBy("age_band").agg(F.sum("share").alias("s"))
    assert {r.s for r in per_band.collect()} == {1.0}


def test_outcome_breakdown(contacts):
    rows = outcomes.outcome_breakdown(contacts)
    items = table(rows.where("kind = 'item'"), "label", "n", "pct")
    assert len(items) == 10
    assert items['No contesta ("escolar")'] == (1, 12.5) and items["No contesta"] == (1, 12.5)
    assert items["No és contacte"] == (2, 25.0) and items["Error dades"] == (0, 0.0)
    sums = table(rows.where("kind <> 'item'"), ["kind", "block"], "n")
    assert sums == {("block", "a"): 3, ("block", "b"): 5, ("total", None): 8}
    positions = [r.label_position for r in outcomes.chart_outcomes(rows).orderBy("ord").collect()]
    assert positions[0] == 93.75 and positions[-1] == 6.25


def test_unexpected_outcome_stays_in_the_total(spark, contacts):
    extra = frame(spark, [("1", "A", None, "estrany", None, None)], CONTACTS)
    rows = outcomes.outcome_breakdown(contacts.unionByName(extra))
    assert table(rows.where("kind = 'total'"), "kind", "n") == {"total": 9}
    assert table(rows.where("kind = 'item'"), "label", "block")["Estrany"] == "other"


def test_school_no_answer_and_totals(contacts):
    assert table(outcomes.school_no_answer(contacts), "sve", "n", "pct") == {"A": (1, 100.0), "Totals": (1, 100.0)}
    assert table(outcomes.outcome_by_territory(contacts), ["sve", "is_total"], "unknown", "es_cas")[("Totals", True)] == (1, 1)
    assert table(outcomes.outcome_totals(contacts), "outcome", "n_contacts")[None] == 1


def test_verified_contacts(contacts):
    got = table(summaries.verified_contacts(contacts), "sve", "verified", "accepted")
    assert got == {"A": (1, 1), "B": (1, 0), "C": (1, 0)}


@pytest.fixture(scope="module")
def measures(spark):
    rows = [
        ("Tarragona", False, 10, 30.0, 2, 1), ("Terres de l'Ebre", False, 30, 50.0, 1, 0), ("Girona", False, 60, 20.0, 4, 3),
        ("Totals", True, 100, 100.0, 7, 4),
    ]
    return frame(spark, rows, "sve string, is_total boolean, cases bigint, contacts double, symptomatic bigint, confirmed bigint")


def test_national_summary_merges_and_recomputes(measures):
    national = summaries.national_summary(measures)
    assert table(national, "sve", "cases", "cases_pct", "contacts", "symptomatic", "confirmed") == {
        "Tarragona i Terres de L'Ebre": (40, 40.0, 80.0, 3, 1), "Girona": (60, 60.0, 20.0, 4, 3), "Totals": (100, 100.0, 100.0, 7, 4),
    }
    spanish = summaries.national_summary_es(national)
    assert len(spanish.columns) == 5 and "Total" in {r[0] for r in spanish.collect()}


def test_province_summary(spark, measures):
    converter = frame(
        spark,
        [("a", None, None, "Tarragona", "Tarragona", 1), ("b", None, None, "Tarragona", "Terres de l'Ebre", 2), ("c", None, None, "Girona", "Girona", 3)],
        CONVERTER,
    )
    got = table(summaries.province_summary(measures, converter), "province", "cases", "confirmed")
    assert got == {"Tarragona": (40, 1), "Girona": (60, 3), "Totals": (100, 4)}


SLOT_CUBE = "sve string, day int, status string, symptoms string, n bigint, n_first bigint"
SLOTS_OF_A = [("A", 7, "Realitzat", None, 1, 1), ("A", 14, "Realitzat", "Sí", 3, 2), ("A", 0, None, "No", 5, 5)]


def test_weekly_summary_text(spark, contacts, patients):
    cubes = [shared.tall("case", case_cube(patients)), shared.tall("contact", contact_cube(contacts, AS_OF)), shared.tall("slot", frame(spark, SLOTS_OF_A, SLOT_CUBE))]
    summary = shared.summary_facts(shared.territory_facts(cubes))
    graphic = summaries.infographic(summary)
    got = table(graphic, ["sve", "is_total"], "verified", "accepted", "accepted_pct", "in_followup", "symptomatic_pct", "confirmed_pct")
    assert got[("A", False)] == (1, 1, 100.0, 4, 75.0, 25.0)
    assert got[("Totals", True)] == (3, 1, 33.3, 4, 75.0, 25.0)
    lines = summaries.weekly_summary(summary, AS_OF)
    text = table(lines, "ord", "value_text")
    assert len(text) == 26
    assert (text[2], text[4], text[9], text[10]) == ("8", "62.5%", "2 (2-4)", "(1-5)")
    assert (text[13], text[14], text[15], text[18], text[26]) == ("8", "3", "5", "50%", "")
    assert {(r.iso_year, r.iso_week) for r in lines.collect()} == {(2020, 51)}
    wide = summaries.infographic_transposed(graphic, ["A", "Totals"])
    assert wide.count() == 13 and table(wide, "measure", "A", "Totals")["cases"] == (4.0, 8.0)


def test_weekly_summary_of_nothing_still_has_its_lines(spark):
    nothing = shared.tall("case", frame(spark, [], "sve string, n_contacts double, n bigint"))
    lines = summaries.weekly_summary(shared.summary_facts(shared.territory_facts([nothing])), AS_OF)
    assert lines.count() == 26 and lines.where("value IS NOT NULL").count() == 0


def test_measures_list_only_territories_that_have_some(spark, contacts, patients):
    extra = frame(spark, [("8", "D", "social", "migrat SVE", "No", None)], CONTACTS)
    facts = shared.territory_facts([shared.tall("case", case_cube(patients)), shared.tall("contact", contact_cube(contacts.unionByName(extra), AS_OF))])
    got = table(shared.territory_measures(facts), "sve", "cases", "contacts", "symptomatic", "confirmed")
    assert got == {"A": (4, 7.0, 0, 1), "B": (2, 0.0, 0, 0), "C": (1, 5.0, 0, 0), None: (1, 2.0, 0, 0)}
    assert "D" not in table(summaries.infographic(shared.summary_facts(facts)), "sve", "cases")
    assert table(shared.single_measures(facts, ["confirmed"]), "sve", "confirmed") == {"A": 1, "Totals": 1}


HISTORY = "sve string, ci bigint, cni bigint, iso_year int, iso_week int"


def test_week_over_week(spark, indicators):
    past = frame(spark, [("A", 1, 3, 2020, 50), ("Gone", 1, 1, 2020, 50), ("A", 9, 9, 2020, 49), ("A", 9, 9, 2019, 50)], HISTORY)
    got = history.week_over_week(past.unionByName(history.history_row(indicators, AS_OF)), AS_OF)
    rows = table(got, ["sve", "is_total"], "informed", "not_informed", "informed_pct", "previous_informed_pct", "change_points")
    assert rows[("A", False)] == (3, 1, 75.0, 25.0, 50.0)
    assert rows[("B", False)] == (0, 2, 0.0, None, None)
    assert rows[("Totals", True)] == (5, 3, 62.5, 33.3, 29.2)
    assert ("Gone", False) not in rows
    states = {r.state for r in history.chart_week_over_week(got, AS_OF).collect()}
    assert states == {"I_SE51", "I_SE50", "NI_SE51", "NI_SE50"}


@pytest.mark.parametrize(
    "as_of, this, last",
    [
        (date(2020, 12, 21), (2020, 51), (2020, 50)),
        (date(2021, 1, 4), (2020, 53), (2020, 52)),
        (date(2021, 1, 11), (2021, 1), (2020, 53)),
        (date(2021, 1, 17), (2021, 1), (2020, 53)),
    ],
)
def test_study_weeks_around_new_year(as_of, this, last):
    assert (history.study_week(as_of), history.previous_study_week(as_of)) == (this, last)


def test_history_is_appended_once(spark, indicators, tmp_path):
    path = str(tmp_path / "history")
    row = history.history_row(indicators, AS_OF)
    assert readers.read_history(spark, path).count() == 0
    first = {tuple(r) for r in sinks.update_history(path, row).collect()}
    assert ("A", 3, 1, 2020, 51) in first and len(first) == 4
    assert {tuple(r) for r in sinks.update_history(path, row).collect()} == first
    later = sinks.update_history(path, history.history_row(indicators, date(2020, 12, 28)))
    assert later.count() == 8 and {r.iso_week for r in later.collect()} == {51, 52}
