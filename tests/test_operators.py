from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from contagrid.operators import aggregates, filters, lookups, ordering, reshape, windows
from helpers import frame, plan, table


def test_not_equal_or_null_and_exclusions(spark):
    df = frame(spark, [("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.where(filters.not_equal_or_null(F.col("x"), "a")).collect()} == {"b", None}
    assert {r.x for r in df.where(filters.known_and_not_in(F.col("x"), ["a"])).collect()} == {"b"}


def test_row_difference_matches_missing_and_keeps_duplicates(spark):
    df = frame(spark, [("a", None), ("a", None), ("b", 1), ("b", 1), ("c", 2)], "k string, v int")
    minus = frame(spark, [("a", None), ("c", 3)], "k string, v int")
    assert sorted(r.k for r in filters.row_difference(df, minus).collect()) == ["b", "b", "c"]


def test_fix_literals(spark):
    df = frame(spark, [("FALS",), ("FALSET",), (None,)], "x string")
    fixed = df.select(filters.fix_literals(F.col("x"), {"FALS": "FONOLLOSA"}).alias("x"))
    assert [r.x for r in fixed.collect()] == ["FONOLLOSA", "FALSET", None]


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="sve"):
        filters.require_columns(frame(spark, [(1,)], "x int"), "x", "sve")


def test_placeholder_only_when_empty(spark):
    schema = "sve string, status string, n bigint"
    empty, full = frame(spark, [], schema), frame(spark, [("A", "x", 2)], schema)
    mark = "Sense seguiments"
    assert [tuple(r) for r in filters.with_placeholder(empty, mark).collect()] == [(mark, mark, 0)]
    assert [tuple(r) for r in filters.with_placeholder(full, mark).collect()] == [("A", "x", 2)]


def test_drop_placeholder(spark):
    mark = "Sense seguiments"
    only = frame(spark, [(mark, 0), (mark, 0)], "sve string, n int")
    mixed = frame(spark, [(mark, 0), ("A", 1), (None, 2)], "sve string, n int")
    assert [tuple(r) for r in filters.drop_placeholder(only, mark).collect()] == [(mark, 0)]
    assert {tuple(r) for r in filters.drop_placeholder(mixed, mark).collect()} == {("A", 1), (None, 2)}


def test_lookup_takes_the_first_row_and_never_multiplies(spark):
    left = frame(spark, [("a",), ("a",), ("b",), (None,)], "k string")
    dim = frame(spark, [("a", "late", 9), ("a", "early", 3), (None, "no", 1)], "k string, v string, source_row bigint")
    for split in (False, True):
        got = lookups.lookup(left, dim, {"k": "k"}, {"v": "found"}, split_hot_keys=split)
        assert sorted(map(tuple, got.collect()), key=str) == [("a", "early"), ("a", "early"), ("b", None), (None, None)]
        assert got.columns == ["k", "found"]


def test_members_and_non_members(spark):
    df = frame(spark, [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    ids = frame(spark, [("a",), ("a",), (None,)], "id string")
    assert [r.v for r in lookups.members(df, ids, "k", "id").collect()] == [1]
    assert sorted(r.v for r in lookups.non_members(df, ids, "k", "id").collect()) == [2, 3]


def test_hot_key_is_split_between_tasks(spark):
    """A third of the rows on one key, no broadcast: the join must read that key in pieces."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60000, 1, 4).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("h")
        )
        dim = spark.range(0, 60000, 1, 4).select((F.col("id") % 30000).alias("k"), F.col("id").alias("source_row"))
        joined = lookups.lookup(left, dim, {"k": "k"}, {"source_row": "v"}, split_hot_keys=True)
        result = joined.groupBy("v").agg(F.count("*").alias("n"), F.max("h"))
        assert {r.v: r.n for r in result.collect()}[7] == 20001
        assert "skew=true" in plan(result)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_duplicate_keys(spark):
    df = frame(spark, [("1", "A"), ("1", "B"), ("2", "A"), ("2", "A")], "cip string, sve string")
    assert table(lookups.duplicate_keys(df, "cip", "sve"), "cip", "n_values") == {"1": 2}


def test_totals_row_recomputes_each_measure(spark):
    df = frame(spark, [("A", 1.0), ("A", 3.0), ("B", 8.0), (None, 0.0)], "sve string, v double")
    got = aggregates.with_totals(df, "sve", {"mean": F.avg("v"), "n": F.count("*")})
    assert table(got, ["sve", "is_total"], "mean", "n") == {
        ("A", False): (2.0, 2), ("B", False): (8.0, 1), (None, False): (0.0, 1), ("Totals", True): (3.0, 4),
    }


def test_totals_of_nothing_is_nothing(spark):
    assert aggregates.with_totals(frame(spark, [], "sve string, n int"), "sve", ["n"]).count() == 0


def test_crosstab_keeps_unexpected_and_missing_values(spark):
    df = frame(spark, [("A", "x"), ("A", "z"), ("A", None), ("B", "y y")], "sve string, c string")
    got = aggregates.crosstab(df, "sve", "c", ["x", "y y"])
    assert table(got, "sve", "x", "y_y", "unknown") == {"A": (1, 0, 2), "B": (0, 1, 0)}


def test_counts_agree_on_rows_and_on_a_cube(spark):
    rng = random.Random(5)
    rows = [(rng.choice("AB"), rng.choice(["x", "y", None])) for _ in range(200)]
    df = frame(spark, rows, "sve string, c string")
    cube = df.groupBy("sve", "c").agg(F.count("*").alias("n"))
    key = lambda d: table(aggregates.crosstab(d, "sve", "c", ["x", "y"]), "sve", "x", "y", "unknown")
    assert key(df) == key(cube)
    assert table(aggregates.count_by(df, "c"), "c", "n") == table(aggregates.count_by(cube, "c"), "c", "n")


def test_block_subtotals_add_up(spark):
    df = frame(spark, [("a", "p", 1), ("a", "q", 2), ("b", "r", 4)], "block string, label string, n int")
    got = table(aggregates.block_subtotals(df, "block", "label"), ["kind", "block", "label"], "n")
    assert got[("block", "a", None)] == 3 and got[("block", "b", None)] == 4 and got[("total", None, None)] == 7


def test_align_measures_is_a_zero_filled_full_join(spark):
    a = frame(spark, [("A", 1), (None, 5)], "sve string, x bigint")
    b = frame(spark, [("B", 2), (None, 6)], "sve string, y bigint")
    got = reshape.align_measures({"x": (a, "x"), "y": (b, "y")}, "sve")
    assert table(got, "sve", "x", "y") == {"A": (1, 0), "B": (0, 2), None: (5, 6)}
    kept = reshape.align_measures({"x": (a, "x"), "y": (b, "y")}, "sve", fill=None)
    assert table(kept, "sve", "x", "y")["A"] == (1, None)


def test_union_and_sum(spark):
    a = frame(spark, [("A", 1), ("B", 1)], "sve string, n bigint")
    assert table(reshape.union_and_sum([a, a.limit(1)], ["sve"], ["n"]), "sve", "n") == {"A": 2, "B": 1}


def test_transpose_and_append(spark):
    df = frame(spark, [("A", 1, 2.5), ("Totals", 3, 4.0)], "sve string, x bigint, y double")
    got = reshape.transpose(df, "sve", ["x", "y"], ["A", "Totals"])
    assert table(got, "measure", "A", "Totals") == {"x": (1.0, 3.0), "y": (2.5, 4.0)}
    assert table(reshape.append_row(df, sve="C", x=9), "sve", "x", "y")["C"] == (9, None)


def test_running_positions(spark):
    df = frame(spark, [(1, 20.0), (2, 30.0), (3, 50.0)], "ord int, pct double")
    running = windows.running_total(df, "pct", "ord")
    assert table(windows.middle_of_segment(running, "pct", "running"), "ord", "label_position") == {1: 10.0, 2: 35.0, 3: 75.0}
    assert table(windows.middle_from_end(running, "pct", "running"), "ord", "label_position") == {1: 90.0, 2: 65.0, 3: 25.0}


def test_shares(spark):
    df = frame(spark, [("a", "x", 1), ("a", "y", 3), ("b", "x", 4)], "g string, c string, n bigint")
    assert sum(r.pct for r in windows.share_of_total(df).collect()) == 100.0
    assert table(windows.share_within(df, "g"), ["g", "c"], "share") == {("a", "x"): 0.25, ("a", "y"): 0.75, ("b", "x"): 1.0}


def test_totals_last_in_catalan_order(spark):
    df = frame(spark, [("Totals", True), ("Vallès", False), ("Àrea", False), ("Camp", False)], "sve string, is_total boolean")
    assert [r.sve for r in ordering.totals_last(df).collect()] == ["Àrea", "Camp", "Vallès", "Totals"]


def test_level_order(spark):
    df = frame(spark, [("other",), ("b",), ("a",)], "c string")
    assert [r.c for r in ordering.by_level(df, "c", ["b", "a"]).collect()] == ["b", "a", "other"]
    n = frame(spark, [("a", 1), ("b", 5)], "c string, n int")
    assert [r.c for r in ordering.by_measure(n, "n", "c").collect()] == ["b", "a"]
