"""Case files: what is known of a case id, its own rows and its contacts, in one row.

Either table is scanned once and counted before it is shuffled, so the file of a
case with a third of all contacts is a few rows a task and, in the end, one entry
for each combination of categories. All that needs a case beside its contacts is
then an expression over one row, without joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from contagrid.fixed_values import DOMAIN, Vocabulary
from contagrid.functions.numbers import ratio
from contagrid.operators.aggregates import with_totals

CASE = "struct<sve: string, n_contacts: double, n: bigint>"
CONTACT = "struct<sve: string, setting: string, outcome: string, n: bigint>"


def case_files(patients: DataFrame, contacts: DataFrame) -> DataFrame:
    """(cip, cases, contacts): a row for each id of a case, of a contact's case, or of both.

    ``cases`` holds the id's rows by territory and number of contacts,
    ``contacts`` those listed under it by territory, setting and outcome. Rows
    without an id are in the file of the missing id, which stands for no case.
    """
    cases = patients.groupBy("cip", "sve", "n_contacts").agg(F.count("*").alias("n"))
    listed = contacts.groupBy(F.col("case_cip").alias("cip"), "sve", "setting", "outcome").agg(F.count("*").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = cases.select("cip", F.struct("sve", "n_contacts", "n").cast(CASE).alias("case"), none(CONTACT).alias("contact")).unionByName(
        listed.select("cip", none(CASE).alias("case"), F.struct("sve", "setting", "outcome", "n").cast(CONTACT).alias("contact"))
    )
    return rows.groupBy("cip").agg(F.collect_list("case").alias("cases"), F.collect_list("contact").alias("contacts"))


def file_rows(files: DataFrame) -> DataFrame:
    """(kind, sve, n_contacts, setting, outcome, n): the counts of all files as rows again, of cases and of contacts."""
    none = lambda kind: F.lit(None).cast(kind)
    row = "struct<kind: string, sve: string, n_contacts: double, setting: string, outcome: string, n: bigint>"
    as_row = lambda kind, *values: F.struct(F.lit(kind), *values).cast(row)
    cases = F.transform("cases", lambda c: as_row("case", c["sve"], c["n_contacts"], none("string"), none("string"), c["n"]))
    listed = F.transform("contacts", lambda c: as_row("contact", c["sve"], none("double"), c["setting"], c["outcome"], c["n"]))
    return files.select(F.inline(F.concat(cases, listed)))


COUNTS = ("cases", "reporting", "school_contacts", "other_contacts")


def case_counts(patients: DataFrame, contacts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """(cip, sve, cases, reporting, school_contacts, other_contacts): rows of an id and its contacts, by where they live.

    One union in place of a join: either table is counted before the shuffle by id and territory.
    """
    school = F.col("setting").eqNullSafe(F.lit(vocab.school))
    flags = {"cases": F.lit(1), "reporting": (F.col("n_contacts") > 0).cast("int"), "school_contacts": school.cast("int"), "other_contacts": (~school).cast("int")}
    of = lambda key, names: [F.col(key).alias("cip"), "sve", *[(flags[c] if c in names else F.lit(None).cast("int")).alias(c) for c in COUNTS]]
    rows = patients.select(*of("cip", COUNTS[:2])).unionByName(contacts.select(*of("case_cip", COUNTS[2:])))
    return rows.groupBy("cip", "sve").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def school_split(counts: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Cases and contacts in and out of school, with contacts per case, from ``case_counts``.

    A case counts as one of school if any of its contacts is, else if any of its rows reports
    some; contacts count where they live, whatever their case. A missing id is no case of school.
    """
    whole = Window.partitionBy("cip")
    in_school = F.col("cip").isNotNull() & (F.max("school_contacts").over(whole) > 0)
    reports = F.max("reporting").over(whole) > 0
    flagged = counts.withColumns({"in_school": in_school, "reports": reports})
    rows = flagged.select(
        "sve",
        F.when(F.col("in_school"), F.col("cases")).otherwise(0).alias("cases_with_school"),
        F.when(~F.col("in_school") & F.col("reports"), F.col("cases")).otherwise(0).alias("cases_without_school"),
        "school_contacts",
        "other_contacts",
    )
    columns = ["cases_with_school", "cases_without_school", "school_contacts", "other_contacts"]
    by_territory = rows.groupBy("sve").agg(*[F.sum(c).alias(c) for c in columns])
    zero = F.lit(0.0)
    return (
        with_totals(by_territory, "sve", columns, vocab.total)
        .withColumn("school_ratio", F.coalesce(ratio(F.col("school_contacts"), F.col("cases_with_school")), zero))
        .withColumn("other_ratio", F.coalesce(ratio(F.col("other_contacts"), F.col("cases_without_school")), zero))
    )
