"""Small frames and readable results for the tests."""

from __future__ import annotations

from datetime import date

AS_OF = date(2020, 12, 21)  # a Monday; the study week is 14-20 December, ISO week 51

GAZETTEER = "place_name string, category string, sve string, municipality_name string, province string, source_row bigint"
CONVERTER = "sve string, uve string, region string, province string, sve_display string, source_row bigint"
PATIENTS = "cip string, municipality string, uve string, region string"
CASES = "cip string, sve string, n_contacts double, origin string"
CONTACTS = "case_cip string, sve string, setting string, outcome string, symptoms_day0 string, birth_date string"
SLOTS = (
    "sve string, verified_at string, status_1 string, date_1 string, isolated_1 string, reason_1 string, "
    "symptoms_1 string, status_2 string, date_2 string, isolated_2 string, reason_2 string, symptoms_2 string"
)


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def table(df, key, *columns):
    """{key value(s): value(s)} of a small result."""
    keys = [key] if isinstance(key, str) else list(key)
    out = {}
    for r in df.collect():
        k = r[keys[0]] if len(keys) == 1 else tuple(r[c] for c in keys)
        assert k not in out, f"duplicate {k}"
        out[k] = r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)
    return out


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
