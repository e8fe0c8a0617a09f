"""Order statistics, running totals, weekly cubes, distinct by digest and rows without a key."""

from __future__ import annotations

import itertools
import pathlib
import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from contagrid.operators import bitmaps, cases, distribution, lookups, outcomes, windows
from contagrid.operators.cubes import case_cube, contact_cube
from contagrid.session import Stage
from contagrid.sources.published import Folder
from contagrid.sources.weekly import WeeklyCubes, merge
from helpers import AS_OF, CASES, CONTACTS, frame, plan, table


@pytest.fixture
def keep(spark):
    stage = Stage(spark)
    yield stage
    stage.remove()


def few_parts(spark, n):
    """No coalescing, so that a small sort has several parts."""
    return {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_parts(spark):
    settings = few_parts(spark, 8)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_quantiles_of_all_different_values(spark, keep, many_parts):
    rng = random.Random(3)
    values = [rng.random() * 1000 for _ in range(3000)]
    rows = [(rng.choice(["a", "b", None]), v if i % 17 else None) for i, v in enumerate(values)] + [("none", None)]
    got = table(distribution.quantiles(frame(spark, rows, "g string, v double"), "v", ["g"], (0.25, 0.5, 0.75), keep), "g", "n", "quantiles")
    for g in ("a", "b", None):
        mine = [v for k, v in rows if k == g and v is not None]
        assert got[g][0] == len(mine) and got[g][1] == pytest.approx(statistics.quantiles(mine, n=4, method="inclusive"))
    assert got["none"] == (0, None)


def test_weighted_quantiles_of_one_group(spark, keep, many_parts):
    rows = [(1.0, 5), (2.0, 1), (10.0, 4), (None, 9)]
    got = distribution.quantiles(frame(spark, rows, "v double, w long"), "v", [], (0.0, 0.5, 1.0), keep, weight="w").collect()
    assert [(r["n"], r["quantiles"]) for r in got] == [(10, [1.0, 1.5, 10.0])]


def test_quantiles_sort_no_group_in_one_task(spark, keep, many_parts):
    """One group of different values: its sorted rows lie in several parts of about their share."""
    df = spark.range(0, 8000, 1, 4).select(F.lit("all").alias("g"), F.rand(1).alias("v"))
    seen = []

    def keeping(table_, name):
        kept = keep(table_, name)
        if "__part" in kept.columns:
            seen.extend(r["count"] for r in kept.groupBy("__part").count().collect())
        return kept

    assert distribution.quantiles(df, "v", ["g"], (0.5,), keeping).first()["n"] == 8000
    assert len(seen) >= 6 and max(seen) < 2500


def test_running_totals_across_parts(spark, keep, many_parts):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, 5, None])) for i in range(2000)]
    shuffled = rng.sample(rows, len(rows))
    got = table(distribution.running_totals(frame(spark, shuffled, "i long, g string, n long"), "n", ["i"], ["g"], keep), "i", "running")
    for g in ("a", "b", None):
        mine = [r for r in rows if r[1] == g]
        for (i, *_), total in zip(mine, itertools.accumulate(r[2] or 0 for r in mine)):
            assert got[i] == total
    whole = table(distribution.running_totals(frame(spark, shuffled, "i long, g string, n long"), "n", ["i"], [], keep), "i", "running")
    assert whole[1999] == sum(r[2] or 0 for r in rows)


def test_running_total_of_labels_has_a_fixed_order(spark):
    extra = [("1", "A", None, "un altre", None, None), ("1", "A", None, "estrany", None, None), ("1", "A", None, "estrany", None, None), ("1", "A", None, "rebutja", None, None)]
    contacts = frame(spark, extra, CONTACTS)
    for parts in (1, 5):
        breakdown = outcomes.outcome_breakdown(contact_cube(contacts.repartition(parts), AS_OF))
        got = table(outcomes.chart_outcomes(breakdown), "label", "ord", "pct", "running_pct", "label_position")
        assert got["Estrany"] == (11, 50.0, 75.0, 50.0) and got["Un altre"] == (11, 25.0, 100.0, 12.5)
    assert "Window" not in plan(outcomes.chart_outcomes(breakdown))


def test_overall_beside_each_row(spark):
    df = frame(spark, [("a", 1), ("b", 3)], "k string, n long")
    assert table(windows.with_overall(df, "all", F.sum("n")), "k", "n", "all") == {"a": (1, 4), "b": (3, 4)}
    assert windows.with_overall(df.limit(0), "all", F.sum("n")).count() == 0


# ---- weekly cubes ------------------------------------------------------------

WEEKS = [date(2020, 11, 30), date(2020, 12, 7), date(2020, 12, 14)]


def people(spark, seed):
    rng = random.Random(seed)
    return frame(spark, [(str(i), rng.choice(["A", "B", None]), float(rng.choice([0, 1, 3, 7])), "eCap") for i in range(200)], CASES)


def test_merged_weeks_equal_recomputation(spark, tmp_path):
    stored = WeeklyCubes(spark, str(tmp_path / "cubes"))
    for k, week in enumerate(WEEKS):
        stored.store(week, {"cases": case_cube(people(spark, k))})
    stored.store(WEEKS[1], {"cases": case_cube(people(spark, 9))})
    whole = people(spark, 0).unionAll(people(spark, 9)).unionAll(people(spark, 2))
    rows = lambda df: sorted(map(str, cases.case_contact_indicators(df).collect()))
    assert rows(stored.merged("cases", WEEKS)) == rows(whole)
    assert rows(stored.merged("cases", WEEKS[:1])) == rows(people(spark, 0))


def test_a_corrected_week_leaves_the_others_alone(spark, tmp_path):
    stored = WeeklyCubes(spark, str(tmp_path / "cubes"))
    for k, week in enumerate(WEEKS):
        stored.store(week, {"cases": case_cube(people(spark, k))})
    files = lambda week: {p: p.stat().st_mtime_ns for p in pathlib.Path(tmp_path / "cubes" / f"snapshot_week={week}").rglob("*.parquet")}
    before = {week: files(week) for week in WEEKS}
    stored.store(WEEKS[2], {"cases": case_cube(people(spark, 5)).limit(0)})
    assert files(WEEKS[0]) == before[WEEKS[0]] and files(WEEKS[1]) == before[WEEKS[1]]
    assert stored.read("cases", WEEKS[2:]).count() == 0
    read = stored.read("cases", WEEKS[:1]).inputFiles()
    assert read and all("2020-11-30" in f for f in read)
    with pytest.raises(ValueError, match="no stored week"):
        stored.read("cases", [date(2019, 1, 7)])


def test_a_failed_week_leaves_the_old_one(spark, tmp_path):
    stored = WeeklyCubes(spark, str(tmp_path / "cubes"))
    stored.store(WEEKS[0], {"cases": case_cube(people(spark, 0)), "more": spark.range(3)})
    bad = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        stored.store(WEEKS[0], {"cases": case_cube(people(spark, 1)), "more": bad})
    assert stored.read("more", WEEKS[:1]).count() == 3
    assert merge(stored.read("cases", WEEKS[:1]).drop("snapshot_week")).agg(F.sum("n")).first()[0] == 200


def test_folders_keep_two_versions(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    assert folder.current() is None
    for n in range(4):
        folder.replace(lambda path, n=n: spark.range(n).write.parquet(path))
        assert spark.read.parquet(folder.current()).count() == n
    assert len(folder.versions()) == 2
    assert len([p for p in (tmp_path / "f").iterdir() if p.name.startswith("v-")]) == 2


# ---- distinct by digest, rows without a key ----------------------------------


@pytest.mark.parametrize("digest", [F.xxhash64, lambda *c: F.xxhash64(c[0]) % 3], ids=["strong", "weak"])
def test_distinct_rows_are_the_distinct_rows(spark, digest):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", None]), rng.choice([0.5, None])) for _ in range(40)] + [(100 + i, "w" * 50, 1.0) for i in range(300)]
    df = frame(spark, rows + rows[-5:], "a long, `b c` string, d double")
    got = sorted(map(str, bitmaps.distinct_rows(df, digest).collect()))
    assert got == sorted(map(str, df.distinct().collect())) and len(got) == len(set(rows))
    assert bitmaps.distinct_rows(df.limit(0)).count() == 0


def test_rows_without_a_copy_are_not_shuffled(spark, tmp_path):
    """What is written to shuffles is a digest of each row, and not the wide column, which doesn't compress."""
    df = spark.range(0, 5000, 1, 4).select("id", F.concat(*[F.sha2((F.col("id") * 9 + i).cast("string"), 512) for i in range(4)]).alias("wide"))
    df = df.unionByName(df.where("id < 5"))
    out = bitmaps.distinct_rows(df)
    assert out.count() == 5000
    assert shuffled_rows(spark, out, tmp_path, "shuffleWriteBytes") < 200_000 < 500 * 5000


def dim(spark):
    return frame(spark, [("a", "A", 1), ("b", "B", 2)], "k string, sve string, source_row long")


@pytest.mark.parametrize("bypass", [True, False])
@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_rows_without_a_key_are_kept(spark, bypass, broadcast):
    rows = [("a", 1), (None, 2), ("b", 3), ("z", 4), (None, 2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = lookups.lookup(frame(spark, rows, "k string, n int"), dim(spark), {"k": "k"}, {"sve": "sve"}, split_hot_keys=True, bypass_missing=bypass)
        assert sorted(map(str, [tuple(r) for r in df.collect()])) == sorted(map(str, [("a", 1, "A"), (None, 2, None), ("b", 3, "B"), ("z", 4, None), (None, 2, None)]))
        assert df.columns == ["k", "n", "sve"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_rows(spark, df, tmp_path, what="shuffleWriteRecords"):
    """Rows or bytes written to shuffles while ``df`` runs."""
    seen = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    df.write.mode("overwrite").parquet(str(tmp_path / "out"))
    store = spark.sparkContext._jsc.sc().statusStore()
    total = 0
    for job in set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - seen:
        stages = store.job(job).stageIds()
        for i in range(stages.size()):
            total += getattr(store.lastStageAttempt(stages.apply(i)), what)()
    return total


def test_missing_keys_add_no_shuffled_row(spark, tmp_path):
    with_key = spark.range(0, 2000, 1, 2).selectExpr("cast(id as string) AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = []
        for extra in (0, 1000):
            df = with_key.unionByName(spark.range(extra).selectExpr("cast(null as string) AS k"))
            moved.append(shuffled_rows(spark, lookups.lookup(df, dim(spark), {"k": "k"}, {"sve": "sve"}, split_hot_keys=True, bypass_missing=True), tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved[0] == moved[1] >= 2000
