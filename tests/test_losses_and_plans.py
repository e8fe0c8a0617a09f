"""Nothing is lost on the way, and the scans and shuffles are those that were meant."""

from __future__ import annotations

import re
from datetime import date

import pytest

from __spark_entry__ import queries
from contagrid.functions import dates
from contagrid.operators import reshape, summaries
from contagrid.operators.lookups import duplicate_keys
from contagrid.operators.quality import unreadable_dates
from contagrid.operators.territory import unresolved
from contagrid.session import Stage, is_shared
from contagrid.sources import sinks
from helpers import frame, plan, table

SF_DIR = "/root/testdata/sf0.001"
OF_EVENTS = [
    "snapshot_week_filter", "followup_counts", "followup_single_slot", "followup_reasons", "symptom_evolution", "asymptomatic_evolution",
    "union_reaggregate", "week_over_week", "informed_unpivot", "province_rollup", "national_summary", "single_measures", "infographic",
    "weekly_summary", "followup_placeholder",
]


def test_missing_territory_is_a_column_and_adds_up(spark):
    measures = summaries.INFOGRAPHIC_MEASURES
    rows = [("A", False, 1), (None, False, 2), ("Totals", True, 3)]
    df = frame(spark, [(s, t, *[float(v)] * len(measures)) for s, t, v in rows], "sve string, is_total boolean, " + ", ".join(f"{m} double" for m in measures))
    names = summaries.territory_columns(df)
    out = summaries.infographic_transposed(df, names)
    assert set(names) == {"A", None, "Totals"} and set(out.columns) == {"label", "measure", "A", "unknown", "Totals"}
    assert all(r["A"] + r["unknown"] == r["Totals"] for r in out.collect())


def test_two_columns_of_one_name_are_refused(spark):
    df = frame(spark, [("unknown", 1.0), (None, 2.0)], "sve string, x double")
    with pytest.raises(ValueError):
        reshape.transpose(df, "sve", ["x"], ["unknown", None])


def test_appended_row_carries_sums(spark):
    df = frame(spark, [("a", 1, 5), ("b", 2, None)], "k string, n long, x long")
    assert table(reshape.append_row(df, sums=["n"], k="all"), "k", "n", "x")["all"] == (3, None)


def test_diagnostics_keep_the_weeks_apart(spark):
    rows = [(date(2020, 12, 7), "1", "X", None), (date(2020, 12, 14), "1", "X", None), (date(2020, 12, 14), "2", "Y", "A"), (date(2020, 12, 7), "2", "Y", "B"), (date(2020, 12, 7), "2", "Y", "C")]
    df = frame(spark, rows, "snapshot_week date, cip string, municipality string, sve string")
    assert unresolved(df, ("snapshot_week",)).count() == 2
    assert [tuple(r) for r in duplicate_keys(df, "cip", "sve", ("snapshot_week",)).collect()] == [(date(2020, 12, 7), "2", 2)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("14/12/20", date(2020, 12, 14)), ("1-2-68", date(2068, 2, 1)), ("1.2.69", date(1969, 2, 1)), ("20201214", date(2020, 12, 14)),
        ("14122020", date(2020, 12, 14)), ("20111203", date(2011, 12, 3)), ("12/31/2019", date(2019, 12, 31)), ("2020-2-3", date(2020, 2, 3)),
        ("30/2/2020", None), ("141220", None), ("1/1/020", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_dates_in_all_forms(spark, text, expected):
    df = frame(spark, [(text,)], "d string")
    orders = (dates.DAY_MONTH_YEAR, dates.MONTH_DAY_YEAR, dates.YEAR_MONTH_DAY)
    assert df.select(dates.parse_date(df["d"], *orders)).first()[0] == expected


def test_unreadable_dates_are_counted(spark):
    df = frame(spark, [("1/2/2020", "x"), ("31/2/2020", None), ("", "2/1/20"), (None, "y")], "a string, b string")
    got = unreadable_dates(df, {"a": ("dmy",), "b": ("dmy",)}, "t").collect()
    assert [tuple(r) for r in got] == [("t", "a", 2, 1), ("t", "b", 3, 2)]


@pytest.mark.parametrize("name", OF_EVENTS)
def test_weeks_are_pushed_to_the_scan_of_events(spark, name):
    text = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[[^\n]*?ts#[^\n]*", text)
    assert scans and all(re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts[^\]]*LessThan\(ts", s) for s in scans)


def test_stage_leaves_nothing(spark, tmp_path):
    import pathlib

    stage = Stage(spark)
    stage(spark.range(3), "three")
    folder = pathlib.Path(stage.folder.removeprefix("file:"))
    assert folder.exists()
    stage.remove()
    assert not folder.exists()


def test_a_corrected_week_replaces_the_stored_one(spark, tmp_path):
    schema = "sve string, ci bigint, cni bigint, iso_year int, iso_week int"
    path = str(tmp_path / "history")
    week = lambda ci, w: frame(spark, [("A", ci, 1, 2024, w)], schema)
    for df in (week(5, 1), week(6, 2), week(7, 2)):
        sinks.update_history(path, df)
    stored = sinks.update_history(path, week(9, 2), replace=False)
    assert sorted((r["iso_week"], r["ci"]) for r in stored.collect()) == [(1, 5), (2, 7)]


def test_difference_from_a_filter_is_the_generic_difference(spark):
    from pyspark.sql import functions as F

    from contagrid.operators import filters

    df = frame(spark, [("a", 1), ("a", None), (None, 1), ("b", 1), ("b", 1)], "k string, n long")
    bad = (F.col("k") == "a") & (F.col("n") == 1)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(filters.without(df, bad)) == rows(filters.row_difference(df, df.where(bad)))


def test_row_difference_scans_the_contacts_once(spark):
    text = plan(queries()["row_difference"](spark, SF_DIR))
    assert text.count("FileScan") == 1 and "Join" not in text


def write_lines(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_weeks_of_text_with_changing_columns(spark, tmp_path):
    from contagrid.sources import readers

    first, second, third = (date(2020, 12, 7), date(2020, 12, 14), date(2020, 12, 21))
    write_lines(tmp_path / f"snapshot_week={first}", "a.csv", "CIP,municipi", "1,Valls", '2,"Reus, ciutat"', "3", "", "4,Valls,x")
    write_lines(tmp_path / f"snapshot_week={first}", "b.csv", "municipi,CIP", "Tortosa,5")
    write_lines(tmp_path / f"snapshot_week={second}", "a.csv", "CIP,nova `x`,municipi", "6,n,Valls", "7,,")
    write_lines(tmp_path / f"snapshot_week={second}", "_SUCCESS", "CIP")
    good, bad = readers.scan_weeks(spark, str(tmp_path), [first, second, third])
    assert table(good, "CIP", "municipi", "nova `x`", "snapshot_week") == {
        "1": ("Valls", None, first), "2": ("Reus, ciutat", None, first), "5": ("Tortosa", None, first), "6": ("Valls", "n", second), "7": (None, None, second),
    }
    assert sorted((r["snapshot_week"], r[readers.MALFORMED]) for r in bad.collect()) == [(first, "3"), (first, "4,Valls,x")]
    assert table(readers.malformed_counts(bad), "snapshot_week", "n_malformed") == {first: 2}
    assert good.count() == 5 and bad.count() == 2
    none, nothing = readers.scan_weeks(spark, str(tmp_path), [third])
    assert none.count() == nothing.count() == 0


def test_placeholders_are_computed_once(spark):
    from contagrid.operators import filters

    text = plan(queries()["followup_placeholder"](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet [^\n]*events", text)) == 1 and "Join" not in text.replace("BroadcastHashJoin", "", 1)
    df = frame(spark, [("A", 1), ("Sense seguiments", 0), ("Sense seguiments", 0)], "sve string, n int")
    assert table(filters.drop_placeholder(df, "Sense seguiments"), "sve", "n") == {"A": 1}
    assert table(filters.drop_placeholder(df.where("n = 0"), "Sense seguiments"), "sve", "n") == {"Sense seguiments": 0}
    assert filters.drop_placeholder(df.limit(0), "x").count() == 0
    assert table(filters.with_placeholder(df.limit(0), "none"), "sve", "n") == {"none": 0}


@pytest.mark.parametrize(
    "master, folder, default_files, shared",
    [
        ("local", "/w", "file:///", True),
        ("local[8]", "file:/w", "file:///", True),
        ("local-cluster[3,2,1024]", "file:/w", "hdfs://n", False),
        ("yarn", "/w", "file:///", False),
        ("yarn", "/w", "hdfs://n", True),
        ("spark://m:7077", "s3a://b/w", "file:///", True),
    ],
)
def test_a_local_warehouse_is_no_shared_folder_on_a_cluster(master, folder, default_files, shared):
    assert is_shared(master, folder, default_files) is shared
