"""Summaries scan each fact table once, dates are read once, and the structures behind that give exact results."""

from __future__ import annotations

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from contagrid.functions.numbers import weighted_quantiles
from contagrid.operators import bitmaps, cases, files, shared
from contagrid.operators.cubes import case_cube
from helpers import AS_OF, frame, plan, table

SF_DIR = "/root/testdata/sf0.001"
FACTS = ("orders", "events")


def scans(text, name):
    return len(re.findall(rf"FileScan parquet [^\n]*/{name}\.parquet", text))


@pytest.mark.parametrize(
    "name",
    [
        "weekly_summary", "infographic", "province_rollup", "national_summary", "national_summary_es", "single_measures", "school_split", "followup_counts", "followup_reasons",
        "symptom_evolution", "asymptomatic_evolution", "week_over_week", "informed_unpivot", "outcome_breakdown_blocks", "school_no_answer", "setting_by_territory_age", "outcome_by_territory",
        "reverse_running_share",
    ],
)
def test_fact_tables_are_scanned_once(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    assert all(scans(text, fact) <= 1 for fact in FACTS) and scans(text, "customer") <= 1


def test_heavy_reporters_scan_orders_twice_when_run(spark):
    """Once for the cases, whose shuffle the filter shares, and once for the contacts."""
    df = queries()["heavy_reporters"](spark, "/root/testdata/sf0.01")
    assert df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert scans(final, "orders") <= 2 and "bitmap_construct_agg" in final


def test_weekly_summary_runs_no_job_before_it_is_asked_for(spark):
    spark.sparkContext.setJobGroup("building", "building")
    try:
        queries()["weekly_summary"](spark, SF_DIR)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []


@pytest.mark.parametrize("name, most", [("setting_by_territory_age", 1), ("outcome_by_territory", 0), ("age_years", 1), ("invalid_dates_to_null", 1), ("setting_by_age_band", 1), ("followup_counts", 3)])
def test_a_date_is_read_by_one_expression(spark, name, most):
    text = plan(queries()[name](spark, SF_DIR))
    assert len(re.findall(r"regexp_\w+\(|RLIKE", text)) <= most


def test_weighted_quantiles_are_those_of_the_repeated_values(spark):
    rng = random.Random(2)
    groups = [[(float(rng.choice([1, 1, 2, 3, 5, 8, 100])), rng.randint(1, 4)) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    df = frame(spark, [(i, g) for i, g in enumerate(groups)], "i int, counts array<struct<value: double, n: bigint>>")
    got = table(df.select("i", weighted_quantiles(F.col("counts"), (0.0, 0.25, 0.5, 0.75, 1.0)).alias("q")), "i", "q")
    for i, group in enumerate(groups):
        values = sorted(v for v, n in group for _ in range(n))
        quartiles = statistics.quantiles(values, n=4, method="inclusive") if len(values) > 1 else values * 3
        assert got[i] == pytest.approx([values[0], *quartiles, values[-1]])


def test_quantiles_of_nothing_are_missing(spark):
    df = frame(spark, [([],), (None,)], "counts array<struct<value: double, n: bigint>>")
    assert [r[0] for r in df.select(weighted_quantiles(F.col("counts"), (0.5,))).collect()] == [None, None]


def people_and_contacts(spark, seed):
    rng = random.Random(seed)
    people = [(rng.choice([str(rng.randint(0, 30)), None]), rng.choice(["A", "B", None]), rng.choice([0.0, 1.0, 25.0, None])) for _ in range(80)]
    listed = [(rng.choice([str(rng.randint(10, 45)), None, "12"]), rng.choice(["A", "C", None]), rng.choice(["escolar", "social", None]), rng.choice(["rebutja", None])) for _ in range(200)]
    return (
        people, listed,
        frame(spark, people, "cip string, sve string, n_contacts double"),
        frame(spark, listed, "case_cip string, sve string, setting string, outcome string"),
    )


def test_case_files_lose_nothing(spark):
    people, listed, patients, contacts = people_and_contacts(spark, 3)
    made = files.case_files(patients, contacts)
    assert made.count() == len({p[0] for p in people} | {c[0] for c in listed})
    rows = files.file_rows(made).groupBy("kind", "sve", "n_contacts", "setting", "outcome").agg(F.sum("n").alias("n")).collect()
    got = {tuple(r)[:5]: r["n"] for r in rows}
    expected = {}
    for _, sve, n in people:
        expected["case", sve, n, None, None] = expected.get(("case", sve, n, None, None), 0) + 1
    for _, sve, setting, outcome in listed:
        expected["contact", sve, None, setting, outcome] = expected.get(("contact", sve, None, setting, outcome), 0) + 1
    assert got == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_school_split_against_brute_force(spark, seed):
    people, listed, patients, contacts = people_and_contacts(spark, seed)
    got = table(files.school_split(files.case_counts(patients, contacts)), ["sve", "is_total"], "cases_with_school", "cases_without_school", "school_contacts", "other_contacts")
    at_school = {c[0] for c in listed if c[0] is not None and c[2] == "escolar"}
    reports = {p[0] for p in people if (p[2] or 0) > 0}
    for sve in {p[1] for p in people} | {c[1] for c in listed}:
        mine, theirs = [p for p in people if p[1] == sve], [c for c in listed if c[1] == sve]
        school = sum(c[2] == "escolar" for c in theirs)
        assert got[sve, False] == (sum(p[0] in at_school for p in mine), sum(p[0] not in at_school and p[0] in reports for p in mine), school, len(theirs) - school)


@pytest.mark.parametrize("buckets", [1, 3, bitmaps.BUCKETS])
def test_filters_of_ids_drop_none_of_them(spark, buckets):
    ids = spark.range(0, 3000).selectExpr("cast(id * 7 as string) AS k").unionByName(frame(spark, [(None,)], "k string"))
    made = bitmaps.id_filter(ids, "k", buckets)
    rows = spark.range(0, 30000).selectExpr("cast(id as string) AS k", "id AS n").unionByName(frame(spark, [(None, -1)], "k string, n long"))
    kept = bitmaps.may_be_in(rows, "k", made, buckets)
    assert made.count() <= buckets and kept.columns == ["k", "n"]
    numbers = {r["n"] for r in kept.collect()}
    assert numbers >= {7 * i for i in range(3000) if 7 * i < 30000} and -1 not in numbers
    if buckets == bitmaps.BUCKETS:
        assert len(numbers) < 4300 + 30
    assert bitmaps.may_be_in(rows, "k", bitmaps.id_filter(ids.limit(0), "k", buckets), buckets).count() == 0


def test_filter_prunes_contacts_before_their_shuffle(spark):
    schema = "cip string, gender string, birth_date string, place_name string, sve string, n_contacts double"
    people = frame(spark, [("7", "dona", "21/12/2000", "P", "A", 20.0), ("8", "home", None, "P", "A", 3.0)], schema)
    contacts = spark.range(20000).selectExpr("cast(id % 5000 as string) AS case_cip", "'social' AS setting")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = cases.heavy_reporters(people, contacts, AS_OF)
        text = plan(df)
        assert [(r["cip"], r["social"]) for r in df.collect()] == [("7", 4)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = text.index("BroadcastHashJoin")
    # the counts of contacts, with their exchange, stand above the filter's join
    assert text.rindex("Exchange hashpartitioning(case_cip", 0, join) >= 0 and "LeftSemi" not in text


def test_summary_quartiles_equal_the_indicators(spark):
    rng = random.Random(9)
    people = frame(spark, [(str(i), rng.choice(["A", "B", None]), float(rng.choice([0, 1, 2, 4, 9])), None) for i in range(300)], "cip string, sve string, n_contacts double, origin string")
    summary = shared.summary_facts(shared.territory_facts([shared.tall("case", case_cube(people))]))
    got = table(summary, ["sve", "is_total"], "quartiles")
    same = table(cases.case_contact_indicators(people), ["sve", "is_total"], "min_contacts", "q25_contacts", "median_contacts", "q75_contacts", "max_contacts")
    assert {k: tuple(v) for k, v in got.items()} == same
