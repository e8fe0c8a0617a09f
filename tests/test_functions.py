from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from contagrid.functions import dates, numbers, text
from contagrid.operators.cubes import contact_birth_date


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    "value, expected",
    [("és cas", "És cas"), ("MIGRAT SVE", "Migrat sve"), ("àrea bàsica", "Àrea bàsica"), ("", ""), (None, None)],
)
def test_sentence_case(spark, value, expected):
    assert one(spark, value, text.sentence_case) == expected


def test_outcome_label_keeps_the_acronym(spark):
    assert one(spark, "migrat SVE", text.outcome_label) == "Migrat SVE"
    assert one(spark, "CIP vàlid", text.outcome_label) == "Cip vàlid"


def test_replace_first_changes_one_place_only(spark):
    fn = lambda c: text.replace_first(c, "a.", "b")
    assert one(spark, "xa.ya.", fn) == "xbya."
    assert one(spark, "xay", fn) == "xay"
    assert one(spark, None, fn) is None


def test_parenthesised(spark):
    assert one(spark, "3 (1-5)", text.parenthesised) == "(1-5)"
    assert one(spark, "3", text.parenthesised) is None


@pytest.mark.parametrize(
    "value, expected", [(100.0, "100"), (12.3, "12.3"), (12345678.0, "12345678"), (0.0, "0"), (0.25, "0.25"), (None, None)]
)
def test_format_number(spark, value, expected):
    assert one(spark, value, text.format_number, "double") == expected


def test_slug():
    assert text.slug("CIP no vàlid") == "cip_no_valid"
    assert text.slug("medi transport") == "medi_transport"


@pytest.mark.parametrize(
    "value, expected", [("7", 7.0), (" 7.5 ", 7.5), ("n/a", None), ("", None), (None, None)]
)
def test_to_number(spark, value, expected):
    assert one(spark, value, numbers.to_number) == expected


def test_shares_are_missing_without_a_divisor(spark):
    row = spark.sql("SELECT 1D a, 0D b, 8D c").select(
        numbers.percent(F.col("a"), F.col("b")).alias("none"),
        numbers.percent(F.col("a"), F.col("c")).alias("some"),
        numbers.ratio(F.lit(9), F.lit(4)).alias("tie"),
    ).first()
    assert (row.none, row.some, row.tie) == (None, 12.5, 2.3)


@pytest.mark.parametrize(
    "value, expected",
    [
        ("5/3/1990", date(1990, 3, 5)),
        ("05-03-1990", date(1990, 3, 5)),
        ("3/25/1990", date(1990, 3, 25)),
        ("1990-03-25", date(1990, 3, 25)),
        ("30/2/1990", None),
        ("29/2/2000", date(2000, 2, 29)),
        ("29/2/1900", None),
        ("1/13/32", None),
        ("ahir", None),
        ("22/12/2020", None),  # tomorrow
        ("21/12/2020", date(2020, 12, 21)),
        ("31/12/1900", None),
        ("1/1/1901", date(1901, 1, 1)),
        (None, None),
    ],
)
def test_contact_birth_date(spark, value, expected):
    assert one(spark, value, lambda c: contact_birth_date(c, date(2020, 12, 21))) == expected


def test_datetime_needs_a_valid_time(spark):
    assert one(spark, "8/1/2024 9:05:00", dates.parse_datetime_as_date) == date(2024, 1, 8)
    assert one(spark, "8/1/2024 25:05:00", dates.parse_datetime_as_date) is None
    assert one(spark, "8/1/2024", dates.parse_datetime_as_date) is None


@pytest.mark.parametrize(
    "born, age",
    [(date(2000, 12, 20), 20), (date(2000, 12, 21), 20), (date(2000, 12, 22), 19), (date(2020, 12, 21), 0)],
)
def test_age_turns_on_the_birthday(spark, born, age):
    assert one(spark, born, lambda c: dates.age_years(c, date(2020, 12, 21)), "date") == age


def test_age_of_a_leap_day_birth(spark):
    fn = lambda day: one(spark, date(2004, 2, 29), lambda c: dates.age_years(c, day), "date")
    assert (fn(date(2021, 2, 27)), fn(date(2021, 3, 1))) == (16, 17)


@pytest.mark.parametrize(
    "age, band",
    [
        (0, "< 12 anys"), (11, "< 12 anys"), (12, "12-19 anys"), (19, "12-19 anys"), (20, "20-39 anys"),
        (39, "20-39 anys"), (40, "40-59 anys"), (59, "40-59 anys"), (60, "60-79 anys"), (79, "60-79 anys"),
        (80, "> 79 anys"), (119, "> 79 anys"), (None, None),
    ],
)
def test_age_band(spark, age, band):
    assert one(spark, age, dates.age_band, "int") == band


@pytest.mark.parametrize(
    "as_of, low, high",
    [
        (date(2020, 12, 21), date(2020, 12, 14), date(2020, 12, 20)),  # a Monday
        (date(2020, 12, 27), date(2020, 12, 14), date(2020, 12, 20)),  # a Sunday
        (date(2021, 1, 4), date(2020, 12, 28), date(2021, 1, 3)),
    ],
)
def test_previous_week(as_of, low, high):
    assert dates.previous_week(as_of) == (low, high)
    assert dates.snapshot_monday(as_of, -1) == low


def test_iso_year_and_week_at_the_year_end(spark):
    got = one(spark, date(2021, 1, 3), lambda c: F.struct(dates.iso_year(c), dates.iso_week(c)), "date")
    assert tuple(got) == (2020, 53) == dates.iso_year_week(date(2021, 1, 3))
