"""The whole weekly job on invented files, against plain Python counts."""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import date, timedelta
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from contagrid.fixed_values import FOLLOWUP_WEEKS, OUTCOMES, SETTINGS, SHEET_NAMES
from contagrid.operators import cases
from contagrid.operators.followup import followup_cube
from contagrid.operators.territory import resolve_contact_territory
from contagrid.plans import report
from contagrid.session import Stage, shared_folder
from contagrid.sources import readers, sinks
from contagrid.sources.schemas import CONTACT_COLUMNS, CONVERTER_COLUMNS, GAZETTEER_COLUMNS, PATIENT_COLUMNS
from helpers import AS_OF, plan, table

TERRITORIES = ["Alt Pirineu", "Barcelona", "Barcelonès Sud", "Camp", "Girona", "Lleida", "Tarragona", "Terres de l'Ebre",
               "Vallès Oriental i Vallès Occidental"]
SHOWN = {"Barcelona": "Barcelona Ciutat", "Barcelonès Sud": "Barcelona Sud", "Vallès Oriental i Vallès Occidental": "Vallès"}
WEEKS = [date(2020, 12, 14), date(2020, 12, 7), date(2020, 11, 30)]


def write(spark, rows, columns, path, partition=None):
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.createDataFrame([tuple(r) for r in rows], schema)
    if partition:
        df = df.withColumn(partition, F.col(partition).cast("date"))
        df.write.partitionBy(partition).parquet(path)
    else:
        df.write.parquet(path)
    return path


def day(d):
    return f"{d.day}/{d.month}/{d.year}"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    patients, contacts = [], []
    for week in WEEKS:
        for i in range(120):
            cip = f"P{i}"
            place = TERRITORIES[i % 9].upper() if i % 5 else None
            uve = f"UVE{i % 9}" if i % 3 == 0 or place is None else "N/A"
            n = rng.choice(["0", "1", "2", "3", "25", None, "desc."])
            patients.append((cip, place, uve, None, n, rng.choice(["eCap", "COVID19"]), "3/4/1980", "dona", week.isoformat()))
        patients.append(patients[-1])  # an exact copy
        for j in range(400):
            verified = week + timedelta(days=rng.randrange(7))
            slots = []
            for _ in range(2):
                on = verified + timedelta(days=rng.choice([6, 7, 10, 14]))
                slots += [rng.choice(["Realitzat", "Pendent", None]), day(on), rng.choice(["Sí", "No"]), rng.choice(["feina", None]), rng.choice(["Sí", "No", None])]
            contacts.append((
                f"P{rng.randrange(120)}", None, rng.choice([*SETTINGS, "escolar", "desconegut", None]),
                rng.choice(["1/2/2015", "2/28/1990", "1950-01-31", "x"]), rng.choice([*OUTCOMES, None]),
                f"{day(verified)} 9:00:00", rng.choice(["Sí", "No", None]), *slots, f"camp lliure {j}", week.isoformat(),
            ))
    return patients, contacts


@pytest.fixture(scope="module")
def paths(spark, data, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("inputs"))
    patients, contacts = data
    places = [(t.upper(), "Municipi", t, t, None, str(i)) for i, t in enumerate(TERRITORIES)]
    units = [(t, f"UVE{i}", f"R{i}", "Tarragona" if t.startswith("T") else "Barcelona", SHOWN.get(t, t), str(i)) for i, t in enumerate(TERRITORIES)]
    return {
        "patients": write(spark, patients, [*PATIENT_COLUMNS, "snapshot_week"], f"{root}/patients", "snapshot_week"),
        "contacts": write(spark, contacts, [*CONTACT_COLUMNS, "no usada", "snapshot_week"], f"{root}/contacts", "snapshot_week"),
        "gazetteer": write(spark, places, [*GAZETTEER_COLUMNS, "source_row"], f"{root}/gazetteer"),
        "converter": write(spark, units, [*CONVERTER_COLUMNS, "source_row"], f"{root}/converter"),
        "history": f"{root}/history",
    }


@pytest.fixture(scope="module")
def written(spark, paths, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    locations = report.run_report(spark, paths, out, AS_OF)
    return {name: spark.read.parquet(path) for name, path in locations.items()}


def territory(i):
    name = TERRITORIES[i % 9]
    return SHOWN.get(name, name)


def test_every_sheet_is_written(written):
    assert set(SHEET_NAMES) <= set(written) and len(SHEET_NAMES) == 24
    assert {"chart_week_over_week", "chart_setting_totals", "chart_setting_by_age", "chart_outcomes"} <= set(written)
    assert all(written[name].columns for name in SHEET_NAMES)


def test_cases_by_territory(written, data):
    study = {p[:8] for p in data[0] if p[8] == WEEKS[0].isoformat()}
    expected = Counter(territory(int(p[0][1:])) for p in study)
    got = table(written["case_contact_indicators"], "sve", "cases")
    assert got.pop("Totals") == len(study) == sum(got.values())
    assert got == expected
    assert written["unresolved_places"].count() == 0


def test_contacts_by_territory_and_outcome(written, data):
    study = [c for c in data[1] if c[-1] == WEEKS[0].isoformat()]
    expected = Counter(territory(int(c[0][1:])) for c in study if c[4] == "rebutja")
    got = table(written["outcome_by_territory"], "sve", "rebutja")
    assert got.pop("Totals") == sum(got.values())
    assert {k: v for k, v in got.items() if v} == expected


def test_followups(written, data):
    expected = Counter()
    low, high = WEEKS[0], WEEKS[0] + timedelta(days=6)
    parse = lambda text: date(*map(int, reversed(text.split(" ")[0].split("/"))))
    for c in data[1]:
        week = date.fromisoformat(c[-1])
        hits = set()
        for status, on in ((c[7], c[8]), (c[12], c[13])):
            gap = (parse(on) - parse(c[5])).days
            allowed = (gap, week) in {(7, WEEKS[1]), (10, WEEKS[1]), (10, WEEKS[2]), (14, WEEKS[2])}
            if status in ("Realitzat", "Pendent") and low <= parse(on) <= high and allowed:
                hits.add((status, gap))
        for status, gap in hits:
            expected[territory(int(c[0][1:])), status, gap] += 1
    got = Counter()
    for r in written["followups"].where("NOT is_total").collect():
        got.update({(r.sve, r.status, d): r[f"day{d}"] for d in (7, 10, 14)})
    assert {k: v for k, v in got.items() if v} == dict(expected)


def test_totals_rows_add_up(written):
    for name, columns in {
        "origin_split": ["first_n", "second_n", "total"],
        "school_split": ["cases_with_school", "cases_without_school", "school_contacts", "other_contacts"],
        "symptomatic": ["day0", "day7", "day10", "day14", "total"],
        "asymptomatic": ["total"],
        "became_cases": ["yes_n", "no_n", "total_n"],
        "province_summary": ["cases", "contacts", "symptomatic", "confirmed"],
        "setting_by_territory": ["social", "altres"],
        "setting_by_age": ["social", "altres"],
        "setting_by_outcome": ["es_cas", "unknown"],
        "school_no_answer": ["n"],
    }.items():
        sums = {r.is_total: r for r in written[name].groupBy("is_total").agg(*[F.sum(c).alias(c) for c in columns]).collect()}
        assert [sums[True][c] for c in columns] == [sums[False][c] for c in columns], name


def test_blocks_add_up_to_all_outcomes(written):
    sums = table(written["outcome_breakdown"].where("kind <> 'item'"), ["kind", "block"], "n")
    assert sums[("block", "a")] + sums[("block", "b")] == sums[("total", None)]


def test_both_split_shares_make_a_hundred(written):
    for r in written["origin_split"].collect():
        assert abs(r.first_pct + r.second_pct - 100) <= 0.1001
    for r in written["became_cases"].collect():
        assert abs(r.yes_pct + r.no_pct - 100) <= 0.1001


def test_heavy_reporters_and_tarragona(written):
    assert {r.n_contacts_reported for r in written["heavy_reporters"].collect()} == {25.0}
    merged = table(written["national_summary"], "sve", "cases")
    assert "Tarragona i Terres de L'Ebre" in merged and "Tarragona" not in merged
    assert set(written["infographic"].columns) >= {"Barcelona Ciutat", "Barcelona Sud", "Vallès", "Totals"}


def test_second_run_replaces_tables_and_keeps_history(spark, paths, written, tmp_path):
    before = {tuple(r) for r in readers.read_history(spark, paths["history"]).collect()}
    assert len(before) == 9
    again = report.run_report(spark, paths, str(tmp_path / "again"), AS_OF, export=str(tmp_path / "csv"))
    assert {tuple(r) for r in readers.read_history(spark, paths["history"]).collect()} == before
    for name in ("weekly_summary", "symptomatic", "school_split"):
        assert sorted(map(str, spark.read.parquet(again[name]).collect())) == sorted(map(str, written[name].collect()))
    exported = sinks.read_table(spark, str(tmp_path / "csv"), "week_over_week", AS_OF, "csv")
    assert exported.columns == ["SVE", "I", "NI", "Total", "%_I_SE51", "%_I_SE50", "Variació %"]
    assert exported.where("SVE = 'Totals'").first()["%_I_SE51"].endswith("%")


def test_empty_followups_are_written_as_a_placeholder(spark, paths, tmp_path):
    # three weeks later no snapshot is left, and no follow-up either
    out = report.run_report(spark, {**paths, "history": str(tmp_path / "h")}, str(tmp_path / "o"), AS_OF + timedelta(weeks=9))
    for name in ("followups", "isolation_reasons", "symptomatic"):
        assert [r.sve for r in spark.read.parquet(out[name]).collect()] == ["Sense seguiments"]
    assert spark.read.parquet(out["case_contact_indicators"]).count() == 0


def test_next_week_sees_this_week_as_previous(spark, paths, written):
    inputs = report.read_inputs(spark, paths, AS_OF + timedelta(weeks=1))
    current = table(written["case_contact_indicators"], "sve", "reporting_pct")
    stored = readers.read_history(spark, paths["history"])
    shares = {r.sve: r for r in stored.collect()}
    assert inputs.history.count() == 9
    for sve, r in shares.items():
        assert abs(100 * r.ci / (r.ci + r.cni) - current[sve]) <= 0.0501


def test_snapshot_filter_prunes_partitions(spark, paths):
    text = plan(readers.read_contacts(spark, paths["contacts"], AS_OF, (-2,)))
    assert "PartitionFilters: [isnotnull(snapshot_week" in text and "2020-12-07" in text


def test_followups_scan_only_the_older_snapshots(spark, paths):
    """The week filter passes the territory joins and the distinct down to both scans."""
    patients = readers.read_patients(spark, paths["patients"], AS_OF).withColumn("sve", F.lit("A"))
    contacts = resolve_contact_territory(
        readers.read_contacts(spark, paths["contacts"], AS_OF), patients, readers.read_gazetteer(spark, paths["gazetteer"]),
        partition_keys=("snapshot_week",),
    )
    text = plan(followup_cube(contacts, AS_OF, weeks=FOLLOWUP_WEEKS))
    assert "2020-11-30" in text and "2020-12-07" in text
    found = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", text)
    found = [f for f in found if "snapshot_week" in f]
    # contacts and patients; no scan keeps only the three-week filter it was read with
    assert len(found) >= 2 and all(re.search(r"IN \(2020-11-30,2020-12-07\)", f) for f in found), found


def test_csv_inputs_give_the_same_rows(spark, paths, tmp_path):
    source = spark.read.parquet(paths["patients"])
    source.write.partitionBy("snapshot_week").option("header", True).csv(str(tmp_path / "csv"))
    a = readers.read_patients(spark, paths["patients"], AS_OF)
    b = readers.read_patients(spark, str(tmp_path / "csv"), AS_OF, fmt="csv").select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_optional_region_column(spark, paths, tmp_path):
    spark.read.parquet(paths["patients"]).drop("regió").write.parquet(str(tmp_path / "p"))
    got = readers.read_patients(spark, str(tmp_path / "p"), AS_OF)
    assert got.where("region IS NOT NULL").count() == 0 and got.count() == 360


def test_reference_tables_need_an_order(spark, paths, tmp_path):
    spark.read.parquet(paths["converter"]).drop("source_row").write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="source_row"):
        readers.read_converter(spark, str(tmp_path / "c"))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_sheets_are_named_as_in_the_report(written):
    folders = {Path(df.inputFiles()[0].removeprefix("file://")).parent.name for df in (written["infographic"], written["followups"], written["contacts_per_case"])}
    assert {unquote(f) for f in folders} == {SHEET_NAMES[n] for n in ("infographic", "followups", "contacts_per_case")}


def test_headers_and_texts_of_the_sheets(spark, paths, written, tmp_path):
    sheets = {name: sinks.labelled(name, df, AS_OF) for name, df in written.items()}
    assert sheets["case_contact_indicators"].columns == [
        "SVE", "1.1-casos_totals", "1.2-N_casos_reporten_contactes", "1.3-%casos amb contactes", "2.1-N total de CE", "2.2-Mitjana", "2.2Mediana", "2.2-IQR", "2.2-Min", "2.2-max",
    ]
    totals = sheets["case_contact_indicators"].where("SVE = 'Totals'").first()
    plain = written["case_contact_indicators"].where("is_total").first()
    number = lambda x: f"{x:.3f}".rstrip("0").rstrip(".")
    assert totals["2.2-IQR"] == f"{number(plain.iqr_contacts)} ({number(plain.q25_contacts)}-{number(plain.q75_contacts)})"
    assert sheets["outcome_by_territory"].columns == ["SVE", *OUTCOMES, "<NA>"]
    assert sheets["setting_by_territory"].columns == ["SVE", *SETTINGS, "<NA>"]
    assert sheets["setting_by_territory_age"].columns == ["SVE", "Rang_edat", *SETTINGS, "<NA>", "Totals"]
    assert sheets["outcome_breakdown"].columns == ["verificació", "N", "Percentatge"]
    labels = {r["verificació"] for r in sheets["outcome_breakdown"].collect()}
    assert {"3.1a", "3.1b", "Totals", "Cip vàlid"} <= labels
    assert sheets["infographic"].columns[0] == "Indicadors" and "Totals" in sheets["infographic"].columns
    assert set(sheets["heavy_reporters"].columns) >= {"CIP", "gènere", "Edat", "social", "N_contactes_segons_pestanya_pacients"}


def test_charts_have_their_legends(written):
    legend = {r.setting for name in ("chart_setting_totals", "chart_setting_by_age") for r in written[name].collect()}
    assert legend <= {x.capitalize() for x in SETTINGS} and "Centre sociosanitari" in legend


def test_a_failed_run_leaves_the_old_week(spark, tmp_path):
    out = str(tmp_path)
    good = spark.createDataFrame([("A", 1)], "sve string, n int")
    sinks.write_tables({"school_no_answer": good, "followups": good}, out, AS_OF)
    bad = good.select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_tables({"school_no_answer": good.union(good), "followups": bad}, out, AS_OF)
    assert sinks.read_table(spark, out, "school_no_answer", AS_OF).count() == 1
    sinks.write_tables({"school_no_answer": good.union(good)}, out, AS_OF)
    assert sinks.read_table(spark, out, "school_no_answer", AS_OF).count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, out, "school_no_answer", AS_OF + timedelta(weeks=1))


def test_report_quartiles_by_rank_equal_percentiles(spark):
    rng = random.Random(8)
    people = spark.createDataFrame([(str(i), rng.choice(["A", "B", None, "C"]), float(rng.choice([0, 1, 2, 3, 9])) if i % 7 else None) for i in range(500)] + [("x", "D", 0.0)], "cip string, sve string, n_contacts double")
    stage = Stage(spark)
    try:
        rows = lambda df: sorted(str(r) for r in df.collect())
        assert rows(cases.case_contact_indicators(people, keep=stage)) == rows(cases.case_contact_indicators(people))
    finally:
        stage.remove()
