from __future__ import annotations

from datetime import date

import pytest

from contagrid.fixed_values import FOLLOWUP_WEEKS
from contagrid.operators import followup as f
from helpers import AS_OF, SLOTS, frame, table

OFF = ("Anul·lat", None, None, None, None)
# the study week is Monday 14 to Sunday 20 December 2020


def slot(day, status="Realitzat", isolated="Sí", reason=None, symptoms=None):
    return (status, f"{day}/12/2020", isolated, reason, symptoms)


def contact(verified, first=OFF, second=OFF, sve="A"):
    return (sve, f"{verified}/12/2020 10:00:00", *first, *second)


def contacts(spark, *rows):
    return frame(spark, rows, SLOTS)


def day7(spark, *rows, kind="status", **kw):
    return f.followup(contacts(spark, *rows), 7, AS_OF, **kw)[kind]


@pytest.mark.parametrize("day, counted", [(13, 0), (14, 1), (20, 1), (21, 0)])
def test_week_is_closed_on_both_ends(spark, day, counted):
    assert day7(spark, contact(day - 7, slot(day))).count() == counted


@pytest.mark.parametrize("verified, counted", [(9, 0), (8, 1), (7, 0)])
def test_only_the_exact_day(spark, verified, counted):
    assert day7(spark, contact(verified, slot(15))).count() == counted


@pytest.mark.parametrize("status, counted", [("Realitzat", 1), ("Pendent", 1), ("Anul·lat", 0), (None, 0)])
def test_live_statuses(spark, status, counted):
    assert day7(spark, contact(8, slot(15, status))).count() == counted


def test_contact_counts_once_when_both_slots_hit(spark):
    both = contact(8, slot(15), slot(15))
    differ = contact(8, slot(15, "Realitzat"), slot(15, "Pendent"))
    got = day7(spark, both, differ)
    assert table(got, ["sve", "status"], "followup_day7") == {("A", "Realitzat"): 2, ("A", "Pendent"): 1}


def test_second_slot_stands_alone(spark):
    assert table(day7(spark, contact(8, OFF, slot(15))), "status", "followup_day7") == {"Realitzat": 1}
    assert day7(spark, contact(8, OFF, slot(15)), slots=(1,)).count() == 0
    assert day7(spark, contact(8, OFF, slot(15)), slots=(2,)).count() == 1


def test_reasons_and_symptoms_count_per_slot(spark):
    row = contact(8, slot(15, isolated="No", reason="feina", symptoms="Sí"), slot(15, isolated="No", reason="feina", symptoms="No"))
    other = contact(8, slot(15, isolated="Sí", reason="casa", symptoms="No"), OFF)
    assert table(day7(spark, row, other, kind="reason"), "reason", "followup_day7") == {"feina": 2}
    assert table(day7(spark, row, other, kind="symptomatic"), "sve", "followup_day7") == {"A": 1}
    assert table(day7(spark, row, other, kind="asymptomatic"), "sve", "followup_day7") == {"A": 2}


def test_bad_dates_are_ignored(spark):
    rows = [("A", "x", *slot(15), *OFF), ("A", "8/12/2020 10:00:00", "Realitzat", "31/2/2020", None, None, None, *OFF)]
    assert day7(spark, *rows).count() == 0


def test_illegal_day_and_week_are_refused(spark):
    for day, week in ((7, -3), (14, -2)):
        with pytest.raises(ValueError, match="snapshot week"):
            f.followup(contacts(spark), day, AS_OF, week=week)
    with pytest.raises(ValueError, match="slot"):
        f.followup_cube(contacts(spark), AS_OF, slots=(3,))


@pytest.fixture(scope="module")
def cube(spark):
    week2, week3 = date(2020, 12, 7), date(2020, 11, 30)
    rows = [
        (week2, *contact(8, slot(15, isolated="No", reason="feina", symptoms="Sí"))),  # day 7
        (week2, *contact(8, slot(18, symptoms="No"), sve="B")),  # day 10 from week -2
        (week3, *contact(5, slot(15), slot(19, "Pendent", symptoms="Sí"))),  # days 10 and 14 from week -3
        (week3, *contact(8, slot(15))),  # day 7 cannot come from week -3
        (date(2020, 12, 14), *contact(8, slot(15))),  # nor from the study week
        (week2, *contact(4, slot(18))),  # day 14 cannot come from week -2
    ]
    return f.followup_cube(frame(spark, rows, f"snapshot_week date, {SLOTS}"), AS_OF, weeks=FOLLOWUP_WEEKS)


def test_followup_table(spark, cube):
    assert table(f.followup_table(cube), ["sve", "status"], "day7", "day10", "day14") == {
        ("A", "Realitzat"): (1, 1, 0), ("A", "Pendent"): (0, 0, 1), ("B", "Realitzat"): (0, 1, 0), ("Totals", "---"): (1, 2, 1),
    }


def test_isolation_reasons(spark, cube):
    assert table(f.isolation_reasons(cube), ["sve", "reason"], "day7", "day10", "day14") == {("A", "feina"): (1, 0, 0)}


def test_symptom_evolution(spark, cube):
    day0 = frame(spark, [("A", "Sí"), ("C", "Sí"), ("C", "No"), (None, "Sí")], "sve string, symptoms_day0 string")
    assert table(f.symptom_evolution(day0, cube), ["sve", "is_total"], "day0", "day7", "day10", "day14", "total") == {
        ("A", False): (1, 1, 0, 1, 3), ("C", False): (1, 0, 0, 0, 1), (None, False): (1, 0, 0, 0, 1),
        ("Totals", True): (3, 1, 0, 1, 5),
    }
    assert table(f.symptom_evolution(day0, cube, "No"), "sve", "total") == {"B": 1, "C": 1, "Totals": 2}


def test_empty_week_gives_empty_tables(spark):
    empty = f.followup_cube(contacts(spark), AS_OF)
    assert f.followup_table(empty).count() == 0
    assert f.isolation_reasons(empty).count() == 0
    assert f.symptom_evolution(frame(spark, [], "sve string, symptoms_day0 string"), empty).count() == 0
