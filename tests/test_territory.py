"""Every branch of the territory cascade, one person each."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from contagrid.fixed_values import DOMAIN
from contagrid.operators.cases import case_contact_indicators
from contagrid.operators.territory import (
    add_province,
    place_directory,
    resolve_contact_territory,
    resolve_territory,
    territory_display_name,
    unresolved,
)
from helpers import CONVERTER, GAZETTEER, PATIENTS, frame, table

PLACES = [
    # name, category, sve
    ("Girona", "Municipi", "Girona"),
    ("Girona", "Barri", "Lleida"),
    ("SOL", None, "Lleida"),
    ("PARELL", None, "Camp"),
    ("PARELL", "Barri", "Girona"),
    ("DOBLE", "Barri", "Girona"),
    ("DOBLE", "Masia", "Lleida"),
    ("TRIPLE", "Barri", "Camp"),
    ("TRIPLE", "Barri", "Girona"),
    ("TRIPLE", None, "Lleida"),
    ("FONOLLOSA", "Poble", "Central"),
    ("NULL", "Barri", "Camp"),
    ("DOS NULS", None, "Girona"),
    ("DOS NULS", None, "Lleida"),
]
UNITS = [
    ("Girona", "UVE1", "RG", "Girona", "Girona"),
    ("Lleida", "UVE2", "RL", "Lleida", "Lleida"),
    ("Camp", "UVE3", "RC", "Tarragona", "Camp"),
    ("Camp Sud", "UVE4", "RC", "Tarragona", "Camp Sud"),
]
PEOPLE = {
    # id: (place, unit, region, territory, branch)
    "unit wins": ("Girona", "UVE2", "RC", "Lleida", "uve"),
    "unit N/A": ("GIRONA", "N/A", "RC", "Girona", "settlement"),
    "unit unknown": ("GIRONA", "UVE9", "RC", "Girona", "settlement"),
    "unit on unmatched": ("ENLLOC", "UVE3", "RL", "Camp", "uve"),
    "settlement": ("GIRONA", None, "RL", "Girona", "settlement"),
    "unique": ("SOL", None, "RC", "Lleida", "unique_name"),
    "two, one uncategorised": ("PARELL", None, "RL", "Camp", "unique_name"),
    "two, both uncategorised": ("DOS NULS", None, "RL", "Girona", "unique_name"),
    "ambiguous in region": ("DOBLE", None, "RL", "Lleida", "name_and_region"),
    "ambiguous in other region": ("DOBLE", None, "RG", "Girona", "name_and_region"),
    "ambiguous, region has none": ("DOBLE", None, "RC", "Girona", "first_name"),
    "ambiguous, no region": ("TRIPLE", None, None, "Camp", "first_name"),
    "triple in region": ("TRIPLE", None, "RL", "Lleida", "name_and_region"),
    "absent name": ("ENLLOC", None, "RC", "Camp", "region"),
    "no name": (None, None, "RL", "Lleida", "region"),
    "NULL name": ("NULL", None, "RL", "Lleida", "region"),
    "NULL name, no region": ("NULL", None, None, "Camp", "unique_name"),
    "nothing": ("ENLLOC", None, None, None, None),
    "misspelt": ("FALS", None, None, "Central", "settlement"),
    "commas": ("SO,L,", None, None, "Lleida", "unique_name"),
    "lower case": ("Girona", None, "RL", "Lleida", "region"),
}


@pytest.fixture(scope="module")
def gazetteer(spark):
    return frame(spark, [(n, c, s, n, None, i) for i, (n, c, s) in enumerate(PLACES)], GAZETTEER)


@pytest.fixture(scope="module")
def converter(spark):
    return frame(spark, [(*u, i) for i, u in enumerate(UNITS)], CONVERTER)


@pytest.fixture(scope="module")
def people(spark):
    return frame(spark, [(k, p, u, r) for k, (p, u, r, _, _) in PEOPLE.items()], PATIENTS)


def expected():
    return {k: v[3:] for k, v in PEOPLE.items()}


def test_every_branch(spark, people, gazetteer, converter):
    got = resolve_territory(people, gazetteer, converter)
    assert table(got, "cip", "sve", "sve_source") == expected()


@pytest.mark.parametrize("partitions", [1, 8])
def test_result_does_not_depend_on_row_order(spark, people, gazetteer, converter, partitions):
    shuffled = [d.orderBy(F.rand(3)).repartition(partitions) for d in (people, gazetteer, converter)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert table(resolve_territory(*shuffled), "cip", "sve", "sve_source") == expected()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_ambiguous_name_and_no_region_column(spark, gazetteer, converter):
    rows = frame(spark, [("1", "SOL", None), ("2", "DOBLE", None)], "cip string, municipality string, uve string")
    got = resolve_territory(rows, gazetteer, converter)
    assert table(got, "cip", "sve", "sve_source") == {"1": ("Lleida", "unique_name"), "2": ("Girona", "first_name")}


def test_rows_are_neither_lost_nor_multiplied(spark, people, gazetteer, converter):
    twice = people.unionByName(people)
    assert resolve_territory(twice, gazetteer, converter).count() == 2 * len(PEOPLE)


def test_unresolved_lists_people_without_territory(spark, people, gazetteer, converter):
    assert table(unresolved(resolve_territory(people, gazetteer, converter)), "cip", "municipality") == {"nothing": "ENLLOC"}


def test_missing_column_is_refused(spark, gazetteer, converter):
    with pytest.raises(ValueError, match="uve"):
        resolve_territory(frame(spark, [("1", "SOL")], "cip string, municipality string"), gazetteer, converter)


def test_place_classes(spark, gazetteer):
    got = table(place_directory(gazetteer), "place_name", "place_class")
    assert got == {
        "GIRONA": "settlement", "FONOLLOSA": "settlement", "SOL": "unique", "PARELL": "unique", "NULL": "unique",
        "DOS NULS": "unique", "DOBLE": "ambiguous", "TRIPLE": "ambiguous",
    }


def test_contacts_take_their_own_settlement_else_the_case(spark, gazetteer):
    patients = frame(spark, [("p", "Lleida"), ("p", "Camp"), ("p", None), ("q", "Girona")], "cip string, sve string")
    contacts = frame(
        spark,
        [("1", "p", "GIRONA"), ("2", "p", "SOL"), ("3", "q", None), ("4", "x", "ENLLOC"), ("5", None, "FONOLLOSA")],
        "id string, case_cip string, municipality string",
    )
    got = resolve_contact_territory(contacts, patients, gazetteer)
    assert table(got, "id", "sve") == {"1": "Girona", "2": "Camp", "3": "Girona", "4": None, "5": "Central"}


def test_contacts_are_matched_within_their_snapshot(spark, gazetteer):
    patients = frame(spark, [(1, "p", "Lleida"), (2, "p", "Camp")], "snapshot_week int, cip string, sve string")
    contacts = frame(spark, [(1, "p", None), (2, "p", None)], "snapshot_week int, case_cip string, municipality string")
    got = resolve_contact_territory(contacts, patients, gazetteer, partition_keys=("snapshot_week",))
    assert table(got, "snapshot_week", "sve") == {1: "Lleida", 2: "Camp"}


def test_display_names(spark):
    names = {
        "Barcelona": "Barcelona Ciutat",
        "Barcelona Ciutat": "Barcelona Ciutat",
        "Barcelonès Sud": "Barcelona Sud",
        "Vallès Oriental i Vallès Occidental": "Vallès",
        "Girona": "Girona",
    }
    df = frame(spark, [(k, k) for k in names], "raw string, sve string")
    once = territory_display_name(df)
    assert table(once, "raw", "sve") == names == table(territory_display_name(once), "raw", "sve")


def test_names_that_merge_are_added_up(spark):
    vocab = dataclasses.replace(DOMAIN, display_rules=(("North$", "One"), ("South$", "One")))
    cases = frame(spark, [("1", "North", 2.0), ("2", "South", 0.0)], "cip string, sve string, n_contacts double")
    got = case_contact_indicators(territory_display_name(cases, vocab))
    assert table(got, "sve", "cases") == {"One": 2, "Totals": 2}


def test_province(spark, converter):
    df = frame(spark, [("Camp",), ("Enlloc",)], "sve string")
    assert table(add_province(df, converter), "sve", "province") == {"Camp": "Tarragona", "Enlloc": None}
