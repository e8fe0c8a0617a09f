"""The library's operators over the driver's tables, one query per operator family."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from contagrid.fixed_values import FOLLOWUP_WEEKS
from contagrid.functions import dates, numbers, text
from contagrid.operators import (
    aggregates,
    cases as case_ops,
    distribution,
    files,
    filters,
    followup as follow,
    history as past,
    lookups,
    ordering,
    outcomes,
    quality,
    reshape,
    settings,
    shared,
    summaries,
    territory,
)
from contagrid.operators.bitmaps import distinct_rows
from contagrid.operators.cubes import case_cube, contact_birth_date, contact_cube
from contagrid.plans import roles
from contagrid.plans.roles import AS_OF_EVENTS, AS_OF_ORDERS, DRIVER, table
from contagrid.session import Stage, temporary_folder
from contagrid.sources import readers, sinks
from contagrid.sources.schemas import CONVERTER_COLUMNS
from contagrid.sources.weekly import WeeklyCubes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _indicators(spark, sf_dir):
    return case_ops.case_contact_indicators(case_cube(roles.cases(spark, sf_dir)), DRIVER)


def _contact_cube(spark, sf_dir, *by):
    """The cube with the keys a query reads; a key that is not asked for is not computed."""
    contacts = roles.contacts(spark, sf_dir, placed="sve" in by)
    return contact_cube(contacts, AS_OF_ORDERS, by)


def _setting_base(spark, sf_dir, *by):
    return settings.setting_base(_contact_cube(spark, sf_dir, "setting", "age_band", *by), DRIVER)


def _followups(spark, sf_dir):
    """Follow-ups and the study week's first answers, from one scan of the three weeks."""
    contacts = roles.event_contacts(spark, sf_dir, (-1, -2, -3))
    return follow.followup_cube(contacts, AS_OF_EVENTS, weeks=FOLLOWUP_WEEKS, vocab=DRIVER, first_week=-1)


def _facts(spark, sf_dir):
    """What the summaries are made of, a row per territory: every table of facts is scanned once."""
    people = shared.tall(None, files.file_rows(roles.case_files(spark, sf_dir)))
    return shared.territory_facts([people, shared.tall("slot", _followups(spark, sf_dir))], DRIVER)


def _weeks(spark, sf_dir, offsets=(-1, -2)):
    return past.weekly_counts(readers.select_snapshots(roles.event_cases(spark, sf_dir, offsets), AS_OF_EVENTS, offsets))


def _week_over_week(spark, sf_dir):
    return past.week_over_week(_weeks(spark, sf_dir), AS_OF_EVENTS, DRIVER)


# ---- scans and filters -------------------------------------------------------


@query
def typed_scan_distinct(spark, sf_dir):
    """All columns read as text, every row twice, whole rows made distinct, and typed again."""
    rows = readers.scan_text(spark, f"{sf_dir}/events.parquet")
    kinds = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "value": "double"}
    return rows.unionAll(rows).distinct().withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


@query
def snapshot_week_filter(spark, sf_dir):
    rows = readers.select_snapshots(roles.event_contacts(spark, sf_dir, (-2, -3)), AS_OF_EVENTS, (-2, -3))
    return rows.groupBy("snapshot_week").agg(F.count("*").alias("n"))


@query
def not_equal_or_null(spark, sf_dir):
    rows = roles.contacts(spark, sf_dir).where(filters.not_equal_or_null(F.col("setting"), DRIVER.school))
    return aggregates.count_by(rows, "sve", "setting")


@query
def outcome_exclusions(spark, sf_dir):
    return summaries.verified_contacts(roles.contacts(spark, sf_dir), DRIVER)


@query
def previous_week_window(spark, sf_dir):
    day = F.col("ts").cast("date")
    rows = table(spark, sf_dir, "events").where(dates.in_previous_week(day, AS_OF_EVENTS))
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))


@query
def literal_fixes(spark, sf_dir):
    """Misspelt names corrected, commas stripped, then counted."""
    fixes = {"small ring": "ring", "red widget": "widget", "blue gear": "gear"}
    name = territory.clean_place(F.concat_ws(",", F.lit(""), filters.fix_literals(F.col("p_name"), fixes)), {})
    return table(spark, sf_dir, "part").groupBy(name.alias("place_name")).agg(F.count("*").alias("n"))


@query
def invalid_dates_to_null(spark, sf_dir):
    born = contact_birth_date(F.col("birth_date"), AS_OF_ORDERS)
    rows = roles.contacts(spark, sf_dir, placed=False).select("contact_id", born.alias("birth_date"))
    return rows


@query
def row_difference(spark, sf_dir):
    """Contacts without the school no-answers, removed as whole rows."""
    rows = roles.contacts(spark, sf_dir, placed=False)
    kept = filters.without(rows, outcomes.is_school_no_answer(DRIVER))
    return aggregates.count_by(kept, "setting", "outcome")


@query
def membership_filter(spark, sf_dir):
    """Cases that have a school contact."""
    ids = case_ops.school_case_ids(roles.contacts(spark, sf_dir), DRIVER)
    return lookups.members(roles.cases(spark, sf_dir), ids, "cip", "case_cip").select("cip", "sve")


@query
def cases_without_contacts(spark, sf_dir):
    return case_ops.cases_without_school(roles.cases(spark, sf_dir), roles.contacts(spark, sf_dir), DRIVER)


@query
def followup_placeholder(spark, sf_dir):
    """A follow-up day nobody has: the written table holds one placeholder row."""
    empty = follow.followup(roles.event_contacts(spark, sf_dir), 99, AS_OF_EVENTS, vocab=DRIVER)["status"]
    return filters.drop_placeholder(filters.with_placeholder(empty, DRIVER.placeholder), DRIVER.placeholder)


@query
def followup_without_placeholder(spark, sf_dir):
    """Follow-ups of day 7, stored beside the placeholder of an earlier, empty run: only the real rows stay."""
    weeks = roles.event_contacts(spark, sf_dir, (-2,))
    real = follow.followup(readers.select_snapshots(weeks, AS_OF_EVENTS, (-2,)), 7, AS_OF_EVENTS, week=-2, vocab=DRIVER)["status"]
    empty = filters.with_placeholder(real.where("false"), DRIVER.placeholder)
    return filters.drop_placeholder(filters.with_placeholder(real, DRIVER.placeholder).unionByName(empty), DRIVER.placeholder)


@query
def drifting_text_weeks(spark, sf_dir):
    """Weeks of events as delimited text whose columns change, rows that don't fit their header set aside and counted."""
    folder = temporary_folder(spark, "contagrid-weeks")
    events = roles.events_of_weeks(spark, sf_dir, (-1, -2, -3)).select("event_id", "user_id", "event_type", F.col("ts").cast("string").alias("stamp"), F.to_date(F.date_trunc("week", "ts")).alias("snapshot_week"))
    # a comma too many in some rows
    broken = events.withColumn("event_type", F.when(F.col("event_id") % 50 == 0, F.concat("event_type", F.lit(",x"))).otherwise(F.col("event_type")))
    columns = {-1: ["event_type", "event_id", "user_id", "stamp"], -2: ["event_id", "event_type"], -3: ["event_id", "user_id", "event_type"]}
    for offset, names in columns.items():
        week = dates.snapshot_monday(AS_OF_EVENTS, offset)
        rows = broken.where(F.col("snapshot_week") == F.lit(week)).select(*names)
        rows.write.option("header", True).option("quote", "").csv(f"{folder}/snapshot_week={week}")
    good, bad = readers.scan_weeks(spark, folder, [dates.snapshot_monday(AS_OF_EVENTS, o) for o in columns])
    kept = good.groupBy("snapshot_week").agg(
        F.count("*").alias("n_rows"), F.count("user_id").alias("n_users"), F.count("stamp").alias("n_stamps"), F.countDistinct("event_id").alias("n_events")
    )
    return kept.join(readers.malformed_counts(bad), "snapshot_week", "left").na.fill(0, ["n_malformed"])


# ---- lookups and joins -------------------------------------------------------


@query
def first_match_lookup(spark, sf_dir):
    people = roles.persons(spark, sf_dir).select("cip", "municipality")
    return lookups.lookup(people, roles.gazetteer(spark, sf_dir), {"municipality": "place_name"}, {"sve": "first_sve"}, split_hot_keys=True)


@query
def coalesced_territory(spark, sf_dir):
    contacts = roles.contacts(spark, sf_dir).select("contact_id", "case_cip", F.upper("municipality").alias("municipality"))
    return territory.resolve_contact_territory(
        contacts, roles.cases(spark, sf_dir), roles.gazetteer(spark, sf_dir), DRIVER
    ).select("contact_id", "sve")


@query
def scalar_lookup(spark, sf_dir):
    suppliers = roles.with_nation(table(spark, sf_dir, "supplier"), spark, sf_dir, "s_nationkey")
    return territory.add_province(suppliers.select("s_suppkey", "sve"), roles.converter(spark, sf_dir))


@query
def region_disambiguation(spark, sf_dir):
    people = territory.resolve_territory(
        roles.persons(spark, sf_dir), roles.gazetteer(spark, sf_dir), roles.converter(spark, sf_dir), DRIVER
    )
    ambiguous = people.where(F.col("sve_source").isin("name_and_region", "first_name"))
    return ambiguous.groupBy("place_name", "region", "sve", "sve_source").agg(F.count("*").alias("n"))


@query
def place_classes(spark, sf_dir):
    places = territory.place_directory(roles.gazetteer(spark, sf_dir), DRIVER)
    return places.select("place_name", "place_class", "settlement_sve", "first_sve")


@query
def resolve_territory(spark, sf_dir):
    people = territory.resolve_territory(
        roles.persons(spark, sf_dir), roles.gazetteer(spark, sf_dir), roles.converter(spark, sf_dir), DRIVER
    )
    return people.select("cip", "place_name", "sve", "sve_source")


@query
def unresolved_places(spark, sf_dir):
    people = territory.resolve_territory(
        roles.persons(spark, sf_dir), roles.gazetteer(spark, sf_dir), roles.converter(spark, sf_dir), DRIVER
    )
    return territory.unresolved(people)


@query
def left_join_named_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000")
    return lookups.lookup(orders, rich, {"o_custkey": "c_custkey"}, {"c_mktsegment": "segment"}, unique=True)


@query
def duplicate_case_territories(spark, sf_dir):
    """Places that carry more than one territory: what first match leaves out."""
    return lookups.duplicate_keys(roles.gazetteer(spark, sf_dir), "place_name", "sve")


@query
def full_join_zero_fill(spark, sf_dir):
    nation = lambda t, k: roles.with_nation(table(spark, sf_dir, t), spark, sf_dir, k)
    customers = nation("customer", "c_nationkey").where("c_acctbal < -900").groupBy("sve").agg(F.count("*").alias("n"))
    suppliers = nation("supplier", "s_nationkey").where("s_acctbal < 0").groupBy("sve").agg(F.count("*").alias("n"))
    cases = roles.cases(spark, sf_dir).where("n_contacts >= 6").groupBy("sve").agg(F.count("*").alias("n"))
    return reshape.align_measures({"poor_customers": (customers, "n"), "poor_suppliers": (suppliers, "n"), "heavy_cases": (cases, "n")}, "sve")


@query
def full_join_two_keys(spark, sf_dir):
    rows = roles.contacts(spark, sf_dir)
    ill = aggregates.count_by(rows.where(F.col("symptoms_day0") == DRIVER.yes), "sve", "outcome")
    school = aggregates.count_by(rows.where(F.col("setting") == DRIVER.school), "sve", "outcome")
    return reshape.align_measures({"ill": (ill, "n"), "school": (school, "n")}, ["sve", "outcome"])


# ---- indicators --------------------------------------------------------------


@query
def case_contact_indicators(spark, sf_dir):
    return _indicators(spark, sf_dir).withColumns({c: F.round(c, 2) for c in ("q25_contacts", "median_contacts", "q75_contacts", "iqr_contacts")})


@query
def origin_split(spark, sf_dir):
    return case_ops.origin_split(roles.cases(spark, sf_dir), DRIVER)


@query
def contacts_per_case_distribution(spark, sf_dir):
    return case_ops.contacts_per_case(roles.cases(spark, sf_dir))


@query
def school_split(spark, sf_dir):
    return files.school_split(roles.case_counts(spark, sf_dir), DRIVER)


@query
def heavy_reporters(spark, sf_dir):
    return case_ops.heavy_reporters(
        roles.cases(spark, sf_dir, urgent_only=False), roles.contacts(spark, sf_dir, placed=False), AS_OF_ORDERS, 20, DRIVER
    )


@query
def became_cases(spark, sf_dir):
    return case_ops.became_cases(_contact_cube(spark, sf_dir, "sve", "outcome"), _indicators(spark, sf_dir), DRIVER)


@query
def sum_all_measures(spark, sf_dir):
    rows = roles.with_nation(table(spark, sf_dir, "supplier"), spark, sf_dir, "s_nationkey")
    sums = aggregates.sum_measures(rows, "sve", ["s_acctbal", "s_suppkey"])
    return sums.select("sve", F.round("s_acctbal", 2).alias("s_acctbal"), "s_suppkey")


@query
def setting_totals(spark, sf_dir):
    return settings.setting_totals(_setting_base(spark, sf_dir))


@query
def setting_by_territory(spark, sf_dir):
    return settings.setting_by_territory(_setting_base(spark, sf_dir, "sve"), DRIVER)


@query
def setting_by_age_band(spark, sf_dir):
    return settings.setting_by_age(_setting_base(spark, sf_dir), DRIVER)


@query
def setting_by_territory_age(spark, sf_dir):
    return settings.setting_by_territory_age(_setting_base(spark, sf_dir, "sve"), DRIVER)


@query
def setting_by_outcome(spark, sf_dir):
    return settings.setting_by_outcome(_setting_base(spark, sf_dir, "outcome"), DRIVER)


@query
def outcome_by_territory(spark, sf_dir):
    return outcomes.outcome_by_territory(_contact_cube(spark, sf_dir, "sve", "outcome"), DRIVER)


@query
def outcome_totals(spark, sf_dir):
    return outcomes.outcome_totals(_contact_cube(spark, sf_dir, "outcome"))


@query
def outcome_breakdown_blocks(spark, sf_dir):
    return outcomes.outcome_breakdown(_contact_cube(spark, sf_dir, "setting", "outcome"), DRIVER)


@query
def school_no_answer(spark, sf_dir):
    return outcomes.school_no_answer(_contact_cube(spark, sf_dir, "sve", "setting", "outcome"), DRIVER)


# ---- follow-ups --------------------------------------------------------------


@query
def followup_counts(spark, sf_dir):
    return follow.followup_table(_followups(spark, sf_dir), vocab=DRIVER)


@query
def followup_single_slot(spark, sf_dir):
    """Day 7 of the snapshot two weeks back, first slot only."""
    rows = readers.select_snapshots(roles.event_contacts(spark, sf_dir, (-2,)), AS_OF_EVENTS, (-2,))
    return follow.followup(rows, 7, AS_OF_EVENTS, slots=(1,), week=-2, vocab=DRIVER)["status"]


@query
def followup_reasons(spark, sf_dir):
    return follow.isolation_reasons(_followups(spark, sf_dir))


@query
def symptom_evolution(spark, sf_dir):
    return follow.symptom_evolution(None, _followups(spark, sf_dir), vocab=DRIVER)


@query
def asymptomatic_evolution(spark, sf_dir):
    return follow.symptom_evolution(None, _followups(spark, sf_dir), DRIVER.no, vocab=DRIVER)


@query
def union_reaggregate(spark, sf_dir):
    """Day-10 follow-ups of two snapshots, added where territory and status agree."""
    parts = []
    for week in (-2, -3):
        rows = readers.select_snapshots(roles.event_contacts(spark, sf_dir, (week,)), AS_OF_EVENTS, (week,))
        parts.append(follow.followup(rows, 10, AS_OF_EVENTS, week=week, vocab=DRIVER)["status"])
    return reshape.union_and_sum(parts, ["sve", "status"], ["followup_day10"])


# ---- history, summaries, charts ----------------------------------------------


@query
def week_over_week(spark, sf_dir):
    return _week_over_week(spark, sf_dir)


@query
def informed_unpivot(spark, sf_dir):
    return past.chart_week_over_week(_week_over_week(spark, sf_dir), AS_OF_EVENTS)


@query
def history_upsert(spark, sf_dir):
    """Store last week, then this week twice; the second run adds nothing."""
    path = temporary_folder(spark, "contagrid-history")
    sinks.update_history(path, _weeks(spark, sf_dir, (-2,)))
    sinks.update_history(path, _weeks(spark, sf_dir, (-1,)))
    return sinks.update_history(path, _weeks(spark, sf_dir, (-1,)))


@query
def weekly_cubes(spark, sf_dir):
    """Three weeks' cubes; one week came without its Sunday and was corrected later. Indicators of the merged cube."""
    stored = WeeklyCubes(spark, temporary_folder(spark, "contagrid-cubes"))
    weeks = {offset: dates.snapshot_monday(AS_OF_EVENTS, offset) for offset in (-1, -2, -3)}
    cube = lambda people: people.groupBy("sve", "n_contacts").agg(F.count("*").alias("n"))
    for offset, week in weeks.items():
        people = readers.select_snapshots(roles.event_cases(spark, sf_dir, (offset,), last_day=offset != -2), AS_OF_EVENTS, (offset,))
        stored.store(week, {"cases": cube(people)})
    corrected = readers.select_snapshots(roles.event_cases(spark, sf_dir, (-2,)), AS_OF_EVENTS, (-2,))
    stored.store(weeks[-2], {"cases": cube(corrected)})
    table_ = case_ops.case_contact_indicators(stored.merged("cases", list(weeks.values())), DRIVER)
    return table_.withColumns({c: F.round(c, 2) for c in ("q25_contacts", "median_contacts", "q75_contacts", "iqr_contacts")})


@query
def order_quartiles(spark, sf_dir):
    """Quartiles of a column whose values are nearly all different, by territory and over all, each found by rank."""
    keep = Stage(spark)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = lookups.lookup(orders, nations, {"o_custkey": "c_custkey"}, {"c_nationkey": "nation"}, unique=True)
    both = [F.struct(F.lit(total).alias("is_total"), key.alias("nation"), "o_totalprice") for total, key in ((False, F.col("nation")), (True, F.lit(None).cast("int")))]
    placed = placed.select(F.inline(F.array(*both)))
    found = distribution.quantiles(placed, "o_totalprice", ["is_total", "nation"], (0.25, 0.5, 0.75), keep)
    quartile = lambda i, name: F.round(F.get("quantiles", F.lit(i)), 4).alias(name)
    return found.select("is_total", F.col("nation").cast("bigint").alias("nation"), "n", quartile(0, "q25"), quartile(1, "median"), quartile(2, "q75"))


@query
def running_cases(spark, sf_dir):
    """Events in order of time with the running number of those that report contacts, by kind."""
    people = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts"), (F.floor("value") > 0).cast("bigint").alias("reports"))
    return distribution.running_totals(people, "reports", ["ts", "event_id"], ["event_type"], Stage(spark)).select("event_id", "event_type", "running")


@query
def digest_distinct(spark, sf_dir):
    """Events, some of them delivered twice, made distinct by digest."""
    rows = table(spark, sf_dir, "events")
    return distinct_rows(rows.unionByName(rows.where("event_id % 10 = 0")))


@query
def missing_key_lookup(spark, sf_dir):
    """People, a part of them without a place, who go round the lookup."""
    people = roles.persons(spark, sf_dir).select("cip", "municipality")
    return lookups.lookup(people, roles.gazetteer(spark, sf_dir), {"municipality": "place_name"}, {"sve": "first_sve"}, split_hot_keys=True, bypass_missing=True)


@query
def province_rollup(spark, sf_dir):
    table_ = summaries.province_summary(shared.territory_measures(_facts(spark, sf_dir)), roles.converter(spark, sf_dir), DRIVER)
    return table_.withColumn("contacts", F.round("contacts", 2))


@query
def national_summary(spark, sf_dir):
    return summaries.national_summary(shared.territory_measures(_facts(spark, sf_dir)), DRIVER)


@query
def national_summary_es(spark, sf_dir):
    national = summaries.national_summary(shared.territory_measures(_facts(spark, sf_dir)), DRIVER)
    return summaries.national_summary_es(national, DRIVER)


@query
def single_measures(spark, sf_dir):
    return shared.single_measures(_facts(spark, sf_dir), ["symptomatic", "confirmed"], DRIVER)


@query
def infographic(spark, sf_dir):
    return summaries.infographic(shared.summary_facts(_facts(spark, sf_dir), DRIVER))


@query
def infographic_transpose(spark, sf_dir):
    """Its columns are the territories in the data, so the table is written once, to read its names and then its rows."""
    table_ = Stage(spark)(summaries.infographic(shared.summary_facts(_facts(spark, sf_dir), DRIVER)), "infographic")
    return summaries.infographic_transposed(table_, summaries.territory_columns(table_)).drop("label")


@query
def weekly_summary(spark, sf_dir):
    lines = summaries.weekly_summary(shared.summary_facts(_facts(spark, sf_dir), DRIVER), AS_OF_EVENTS)
    return lines.withColumn("value", F.round("value", 2))


@query
def published_report(spark, sf_dir):
    """The province summary as the report publishes it, with a converter read from a reference table, read back.

    A second run of the week that fails on the way leaves the published tables as they were.
    """
    folder = temporary_folder(spark, "contagrid-report")
    raw = roles.converter(spark, sf_dir).withColumnsRenamed({new: old for old, new in CONVERTER_COLUMNS.items()})
    raw.write.parquet(f"{folder}/converter")
    measures = shared.territory_measures(_facts(spark, sf_dir))
    summary = summaries.province_summary(measures, readers.read_converter(spark, f"{folder}/converter"), DRIVER)
    sinks.write_tables({"province_summary": sinks.labelled("province_summary", summary, AS_OF_EVENTS)}, folder, AS_OF_EVENTS)
    broken = table(spark, sf_dir, "nation").select(F.raise_error(F.lit("this run fails")).alias("x"))
    try:
        sinks.write_tables({"province_summary": table(spark, sf_dir, "nation"), "infographic": broken}, folder, AS_OF_EVENTS)
    except Exception as error:
        if "this run fails" not in str(error):
            raise
    return sinks.read_table(spark, folder, "province_summary", AS_OF_EVENTS).withColumn("Total de CE", F.round("Total de CE", 2))


@query
def indicator_sheet(spark, sf_dir):
    """The indicators with the headers and texts readers see."""
    return sinks.labelled("case_contact_indicators", _indicators(spark, sf_dir).drop("contacts_per_case"), AS_OF_EVENTS)


@query
def chart_legend(spark, sf_dir):
    return settings.chart_labels(settings.chart_setting_by_age(_setting_base(spark, sf_dir)), DRIVER).withColumn("share", F.round("share", 6))


@query
def running_share(spark, sf_dir):
    out = settings.chart_setting_totals(_setting_base(spark, sf_dir))
    return out.withColumns({c: F.round(c, 2) for c in ("running_pct", "label_position")})


@query
def reverse_running_share(spark, sf_dir):
    out = outcomes.chart_outcomes(outcomes.outcome_breakdown(_contact_cube(spark, sf_dir, "setting", "outcome"), DRIVER))
    return out.withColumns({c: F.round(c, 2) for c in ("running_pct", "label_position")})


@query
def share_in_group(spark, sf_dir):
    out = settings.chart_setting_by_age(_setting_base(spark, sf_dir))
    return out.withColumn("share", F.round("share", 6))


# ---- names, scalars, order ---------------------------------------------------


@query
def territory_names(spark, sf_dir):
    names = roles.converter(spark, sf_dir).select("uve", "sve")
    return territory.territory_display_name(names, DRIVER)


@query
def scalar_text(spark, sf_dir):
    """Text functions over page addresses and part names."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.upper(url).alias("upper_case"),
        text.sentence_case(F.upper(url)).alias("sentence"),
        text.replace_first(url, "th", "TH").alias("first_replaced"),
        text.replace_all(url, ((r"\.example", ".sample"), ("x$", "y"))).alias("all_replaced"),
        text.parenthesised(F.concat(F.lit("a ("), url, F.lit(") b"))).alias("in_brackets"),
        text.strip_commas(F.concat(F.lit("a,b,"), url)).alias("no_commas"),
        text.outcome_label(F.concat(F.lit("migrat sve "), "page_id")).alias("label"),
        text.format_number(F.col("page_id") / 8).alias("number_text"),
        text.percent_label(F.col("page_id").cast("double")).alias("percent_text"),
    )


@query
def scalar_dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    written = F.date_format("o_orderdate", "d/M/yyyy H:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.week_start(day).alias("week_start"),
        dates.iso_year(day).cast("bigint").alias("iso_year"),
        dates.iso_week(day).cast("bigint").alias("iso_week"),
        dates.parse_datetime_as_date(written).alias("from_text"),
        F.date_diff(F.lit(AS_OF_ORDERS), day).cast("bigint").alias("days_since"),
        F.date_add(dates.week_start(day), -7).alias("previous_monday"),
    )


#: Order dates in the forms people write; the last can't be read.
DATE_FORMS = ("d/M/yyyy", "dd-MM-yy", "yyyyMMdd", "yyyy.M.d", "ddMMyyyy", "d MMM")


def _written_dates(spark, sf_dir):
    form = F.col("o_orderkey") % len(DATE_FORMS)
    written = F.coalesce(*[F.when(form == i, F.date_format("o_orderdate", f)) for i, f in enumerate(DATE_FORMS)])
    return table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))


@query
def written_dates(spark, sf_dir):
    read = dates.parse_date(F.col("written"), dates.DAY_MONTH_YEAR, dates.YEAR_MONTH_DAY)
    return _written_dates(spark, sf_dir).select("o_orderkey", read.alias("read"))


@query
def unreadable_dates(spark, sf_dir):
    orders = (dates.DAY_MONTH_YEAR, dates.YEAR_MONTH_DAY)
    return quality.unreadable_dates(_written_dates(spark, sf_dir), {"written": orders}, "orders")


@query
def scalar_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_custkey").cast("string"))
    number = numbers.to_number(raw)
    return rows.select(
        "c_custkey",
        number.alias("number"),
        numbers.percent(number, F.lit(7)).alias("pct"),
        numbers.ratio(number, F.col("c_custkey") % 4, 2).alias("ratio"),
        numbers.sum_nulls_as_zero(number, F.lit(1), F.lit(None).cast("double")).alias("total"),
    )


@query
def age_years(spark, sf_dir):
    born = contact_birth_date(F.col("birth_date"), AS_OF_ORDERS)
    rows = roles.contacts(spark, sf_dir, placed=False).select(dates.age_years(born, AS_OF_ORDERS).alias("age"))
    rows = rows.select(F.col("age").cast("bigint").alias("age"), dates.age_band(F.col("age")).alias("age_band"))
    return rows.groupBy("age", "age_band").agg(F.count("*").alias("n"))


def _positions(df: DataFrame, *order) -> DataFrame:
    """Number the rows of a small sorted result table."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@query
def totals_last_sort(spark, sf_dir):
    rows = _indicators(spark, sf_dir).select("sve", "is_total", "cases")
    return _positions(rows, *ordering.territory_order())


@query
def level_order_sort(spark, sf_dir):
    rows = settings.setting_totals(_setting_base(spark, sf_dir))
    return _positions(rows, ordering.level_position(F.col("setting"), DRIVER.settings))


@query
def measure_order_sort(spark, sf_dir):
    rows = outcomes.outcome_totals(_contact_cube(spark, sf_dir, "outcome"))
    return _positions(rows, F.col("n_contacts").desc(), F.col("outcome").asc_nulls_last())


@query
def append_category_row(spark, sf_dir):
    rows = settings.setting_totals(_setting_base(spark, sf_dir)).select("setting", "n_contacts")
    return reshape.append_row(rows, sums=["n_contacts"], setting="Totals")


@query
def pivot_settings(spark, sf_dir):
    """Contacts per case by setting, with the row total."""
    levels = roles.ALL_SETTINGS
    per_case = aggregates.crosstab(roles.contacts(spark, sf_dir, placed=False), "case_cip", "setting", levels)
    return aggregates.row_total(per_case, aggregates.level_columns(levels))
