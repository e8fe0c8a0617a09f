"""Count cubes: one pass over a big table, reused by every report table.

A cube holds the number of rows per combination of the categories the report
groups by, so its size depends on the number of categories and not on the
number of people. All territory tables are then cheap sums over it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.functions.dates import (
    DAY_MONTH_YEAR,
    MONTH_DAY_YEAR,
    YEAR_MONTH_DAY,
    age_band,
    age_years,
    null_unless_between,
    parse_date,
)

EARLIEST_BIRTH = date(1901, 1, 1)


def contact_birth_date(c: Column, as_of: date) -> Column:
    """Birth date of a contact; impossible, future and very old ones are missing."""
    return null_unless_between(parse_date(c, DAY_MONTH_YEAR, MONTH_DAY_YEAR, YEAR_MONTH_DAY), EARLIEST_BIRTH, as_of)


CONTACT_KEYS = ("sve", "setting", "outcome", "symptoms_day0", "age_band")


def contact_cube(contacts: DataFrame, as_of: date, by: Sequence[str] = CONTACT_KEYS) -> DataFrame:
    """(sve, setting, outcome, symptoms_day0, age_band, n) of a snapshot, or fewer of these keys.

    A cube without the age band reads no birth date.
    """
    if "age_band" in by:
        band = age_band(age_years(contact_birth_date(F.col("birth_date"), as_of), as_of))
        contacts = contacts.withColumn("age_band", band)
    return contacts.groupBy(*by).agg(F.count("*").alias("n"))


def case_cube(patients: DataFrame) -> DataFrame:
    """(sve, origin, n_contacts, n) of a snapshot.

    A case with m contacts owns m contact rows, so D different positive counts
    need at least D*D/2 contacts: the cube stays small for any table size.
    """
    return patients.groupBy("sve", "origin", "n_contacts").agg(F.count("*").alias("n"))
