"""The driver's tables read as cases, contacts, gazetteer and converter.

territory = nation, province and region = region, case = customer with urgent
orders as its contacts, contact = order, gazetteer = part, and for follow-ups
contact = event. Columns the tables lack are derived from their keys, so every
frame grows with its table and meets every branch of the operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from contagrid.fixed_values import DOMAIN, OUTCOMES, SCHOOL_SETTING, SETTINGS, UNKNOWN_SETTING
from contagrid.functions.dates import snapshot_monday
from contagrid.operators.files import CASE, CONTACT
from contagrid.operators.lookups import lookup

AS_OF_ORDERS = date(2003, 6, 15)
AS_OF_EVENTS = date(2024, 1, 22)

ALL_SETTINGS = (*SETTINGS, SCHOOL_SETTING, UNKNOWN_SETTING)

DRIVER = replace(
    DOMAIN,
    settlement_categories=("Municipi", "Poble"),
    patient_place_fixes={"BRAND#1/1": "BRAND#2/2"},
    contact_place_fixes={"BRAND#1/1": "BRAND#2/2"},
    display_rules=((r"NATION_1$", "NATION_1 Ciutat"), ("NATION_2 Sud", "NATION_2"), ("NATION_(7|8)$", "NATION_78")),
    merged_territories={"NATION_3": "NATION_3 i NATION_4", "NATION_4": "NATION_3 i NATION_4"},
    origins=("AUTOMOBILE", "BUILDING"),
)


# explicit schemas: inferring one costs a job per table
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def one_of(values, index: str) -> str:
    """SQL for the value at a 0-based place; missing beyond the end."""
    return f"get(array({', '.join(repr(v) for v in values)}), int({index}))"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    return lookup(nation, region, {"n_regionkey": "r_regionkey"}, {"r_name": "r_name"}, unique=True)


def converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).select(
        F.col("n_name").alias("sve"),
        F.concat(F.lit("UVE"), "n_nationkey").alias("uve"),
        F.col("r_name").alias("region"),
        F.col("r_name").alias("province"),
        F.col("n_name").alias("sve_display"),
        F.col("n_nationkey").cast("bigint").alias("source_row"),
    )


def with_nation(df: DataFrame, spark: SparkSession, sf_dir: str, key: str, name: str = "sve") -> DataFrame:
    return lookup(df, table(spark, sf_dir, "nation"), {key: "n_nationkey"}, {"n_name": name}, unique=True)


def cases(spark: SparkSession, sf_dir: str, urgent_only: bool = True) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    if urgent_only:
        orders = orders.where("o_orderpriority = '1-URGENT'")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("__n"))
    customer = with_nation(table(spark, sf_dir, "customer"), spark, sf_dir, "c_nationkey")
    joined = lookup(customer, counts, {"c_custkey": "o_custkey"}, {"__n": "__n"}, unique=True)
    return joined.selectExpr(
        "c_custkey AS cip",
        "sve",
        "c_mktsegment AS origin",
        "double(coalesce(__n, 0)) AS n_contacts",
        f"{one_of(('dona', 'home'), 'c_custkey % 3')} AS gender",
        "date_format(add_months(DATE '2001-02-28', -int(c_custkey % 1100)), 'd/M/yyyy') AS birth_date",
        "concat('PLACE ', c_custkey % 40) AS place_name",
    )


PLACE = "concat('Brand#', o_custkey % 25 + 1, '/', o_orderkey % 50 + 1)"
BORN = "add_months(date(o_orderdate), -12 * int(o_custkey % 100))"
CONTACT_COLUMNS = (
    "o_orderkey AS contact_id",
    "o_custkey AS case_cip",
    f"{PLACE} AS municipality",
    f"{one_of(ALL_SETTINGS, '(int(substr(o_orderpriority, 1, 1)) - 1) * 2 + o_custkey % 2')} AS setting",
    f"{one_of(OUTCOMES, 'CASE o_orderstatus WHEN "F" THEN 0 WHEN "O" THEN 4 ELSE 8 END + o_orderkey % 4')} AS outcome",
    f"{one_of(('Sí', 'No'), 'o_orderkey % 3')} AS symptoms_day0",
    f"""CASE o_orderkey % 20 WHEN 0 THEN '30/2/1990' WHEN 1 THEN '1/1/2050' WHEN 2 THEN '1/1/1890' WHEN 3 THEN NULL
        WHEN 4 THEN date_format({BORN}, 'M/d/yyyy') WHEN 5 THEN date_format({BORN}, 'yyyy-MM-dd')
        ELSE date_format({BORN}, 'd/M/yyyy')
        END AS birth_date""",
)


def contacts(spark: SparkSession, sf_dir: str, placed: bool = True) -> DataFrame:
    """Orders as contacts, in the territory of their customer unless ``placed`` is false."""
    orders = table(spark, sf_dir, "orders").selectExpr(*CONTACT_COLUMNS)
    if not placed:
        return orders
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cip"), "c_nationkey")
    placed = lookup(orders, customer, {"case_cip": "cip"}, {"c_nationkey": "__nation"}, unique=True)
    return with_nation(placed, spark, sf_dir, "__nation").drop("__nation")


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of customers as cases and their orders as contacts; ``orders`` is scanned once for both."""
    orders = table(spark, sf_dir, "orders").selectExpr(*CONTACT_COLUMNS, "o_orderpriority = '1-URGENT' AS urgent")
    counts = orders.groupBy("case_cip", "setting", "outcome", "urgent").agg(F.count("*").alias("n"))
    per_case = counts.groupBy("case_cip").agg(
        F.sum(F.when(F.col("urgent"), F.col("n"))).alias("n_contacts"), F.collect_list(F.struct("setting", "outcome", "n")).alias("listed")
    )
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cip"), "c_nationkey")
    both = customer.join(per_case, F.col("cip") == F.col("case_cip"), "full")
    both = with_nation(both, spark, sf_dir, "c_nationkey")
    n_contacts = F.coalesce(F.col("n_contacts"), F.lit(0)).cast("double").alias("n_contacts")
    case = F.struct("sve", n_contacts, F.lit(1).alias("n")).cast(CASE)
    contact = lambda c: F.struct(F.col("sve"), c["setting"], c["outcome"], c["n"]).cast(CONTACT)
    return both.select(
        F.coalesce("cip", "case_cip").alias("cip"),
        F.when(F.col("cip").isNotNull(), F.array(case)).otherwise(F.array().cast(f"array<{CASE}>")).alias("cases"),
        F.coalesce(F.transform("listed", contact), F.array().cast(f"array<{CONTACT}>")).alias("contacts"),
    )


def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: its row, and its orders in and out of school; ``orders`` is scanned once."""
    orders = table(spark, sf_dir, "orders").selectExpr(*CONTACT_COLUMNS, "o_orderpriority = '1-URGENT' AS urgent")
    school = F.col("setting").eqNullSafe(F.lit(SCHOOL_SETTING))
    counts = orders.groupBy("case_cip").agg(
        F.count_if("urgent").alias("n_contacts"), F.count_if(school).alias("school_contacts"), F.count_if(~school).alias("other_contacts")
    )
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cip"), "c_nationkey")
    both = with_nation(customer.join(counts, F.col("cip") == F.col("case_cip"), "full"), spark, sf_dir, "c_nationkey")
    is_case = F.col("cip").isNotNull()
    return both.select(
        F.coalesce("cip", "case_cip").alias("cip"),
        "sve",
        is_case.cast("long").alias("cases"),
        (is_case & (F.coalesce("n_contacts", F.lit(0)) > 0)).cast("long").alias("reporting"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("school_contacts", "other_contacts")],
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("__nation", F.expr("int(p_partkey % 25)"))
    return with_nation(part, spark, sf_dir, "__nation").selectExpr(
        "upper(concat(p_brand, '/', p_size)) AS place_name",
        """CASE p_type WHEN 'STANDARD' THEN 'Municipi' WHEN 'PROMO' THEN 'Barri' WHEN 'ECONOMY' THEN 'Veïnat'
           WHEN 'MEDIUM' THEN 'Caseria' WHEN 'LARGE' THEN 'Masia' END AS category""",
        "sve",
        "upper(p_name) AS municipality_name",
        "p_partkey AS source_row",
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as people who name a place, a unit or only a region."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    placed = lookup(orders, customer, {"o_custkey": "c_custkey"}, {"c_nationkey": "__nation"}, unique=True)
    placed = lookup(placed, nations(spark, sf_dir), {"__nation": "n_nationkey"}, {"r_name": "__region"}, unique=True)
    return placed.selectExpr(
        "string(o_orderkey) AS cip",
        f"CASE WHEN o_orderkey % 17 = 0 THEN 'NULL' WHEN o_orderkey % 19 <> 0 THEN upper({PLACE}) END AS municipality",
        "CASE o_orderkey % 10 WHEN 0 THEN concat('UVE', o_custkey % 30) WHEN 1 THEN 'N/A' END AS uve",
        "CASE WHEN o_orderkey % 7 <> 0 THEN __region END AS region",
    )


EVENT_COLUMNS = (
    "event_id AS contact_id",
    "int(user_id % 25) AS __nation",
    "date(date_trunc('week', ts)) AS snapshot_week",
    "date_format(ts, 'd/M/yyyy H:mm:ss') AS verified_at",
    "CASE event_type WHEN 'click' THEN 'Sí' WHEN 'view' THEN 'No' END AS symptoms_day0",
    """CASE event_type WHEN 'click' THEN 'Realitzat' WHEN 'view' THEN 'Realitzat' WHEN 'purchase' THEN 'Pendent'
       WHEN 'signup' THEN 'Anul·lat' END AS status_1""",
    f"date_format(date_add(ts, {one_of((7, 10, 14, 8), 'event_id % 4')}), 'd/M/yyyy') AS date_1",
    f"{one_of(('No', 'Sí'), 'event_id % 3')} AS isolated_1",
    f"{one_of(('motiu 0', 'motiu 1', 'motiu 2'), 'event_id % 4')} AS reason_1",
    "CASE WHEN event_id % 7 < 3 THEN 'Sí' WHEN event_id % 7 < 6 THEN 'No' END AS symptoms_1",
    f"{one_of(('Realitzat', 'Realitzat', 'Pendent', 'Anul·lat'), 'event_id % 5')} AS status_2",
    f"date_format(date_add(ts, {one_of((10, 7, 14, 10, 3, 14), 'event_id % 6')}), 'd/M/yyyy') AS date_2",
    f"{one_of(('No', 'Sí'), 'event_id % 2')} AS isolated_2",
    f"{one_of(('motiu 0', 'motiu 1', 'motiu 2'), 'user_id % 4')} AS reason_2",
    "CASE WHEN user_id % 7 < 3 THEN 'Sí' WHEN user_id % 7 < 6 THEN 'No' END AS symptoms_2",
)


def events_of_weeks(spark: SparkSession, sf_dir: str, offsets: Sequence[int]) -> DataFrame:
    """Events from the first to the last of the given snapshot weeks, a range of time stamps the scan can prune by."""
    first, last = (snapshot_monday(AS_OF_EVENTS, f(offsets)) for f in (min, max))
    stamp = F.col("ts")
    after = F.lit(f"{last + timedelta(days=7)} 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where((stamp >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz")) & (stamp < after))


def event_contacts(spark: SparkSession, sf_dir: str, offsets: Sequence[int] = (-1, -2, -3)) -> DataFrame:
    """Events of some weeks as contacts verified at their time stamp, with two follow-up slots."""
    frame = events_of_weeks(spark, sf_dir, offsets).selectExpr(*EVENT_COLUMNS)
    return with_nation(frame, spark, sf_dir, "__nation").drop("__nation")


def event_cases(spark: SparkSession, sf_dir: str, offsets: Sequence[int] = (-1, -2, -3), last_day: bool = True) -> DataFrame:
    """Events of some weeks as cases of their week; an error event reports no contacts. Sundays only with ``last_day``."""
    events = events_of_weeks(spark, sf_dir, offsets)
    frame = (events if last_day else events.where("weekday(ts) < 6")).selectExpr(
        "event_id AS cip",
        "int(user_id % 25) AS __nation",
        "date(date_trunc('week', ts)) AS snapshot_week",
        "double(CASE WHEN event_type = 'error' THEN 0 ELSE floor(value) END) AS n_contacts",
    )
    return with_nation(frame, spark, sf_dir, "__nation").drop("__nation")
