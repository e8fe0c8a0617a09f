"""Follow-up of contacts 7, 10 and 14 days after verification.

A contact row has two follow-up slots. They become two rows inside the same
task (no self-join, no row id), and one aggregation gives a small cube from
which all four kinds of result are sums: status counts, reasons for not
isolating, symptomatic and asymptomatic counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.fixed_values import DOMAIN, FOLLOWUP_WEEKS, Vocabulary
from contagrid.functions.dates import DAY_MONTH_YEAR, in_previous_week, parse_date, parse_datetime_as_date, snapshot_monday
from contagrid.operators.aggregates import count_by, with_totals
from contagrid.operators.filters import require_columns
from contagrid.operators.reshape import union_all

SLOT_FIELDS = ("status", "date", "isolated", "reason", "symptoms")


def followup_slots(
    contacts: DataFrame, as_of: date, slots: Sequence[int] = (1, 2), vocab: Vocabulary = DOMAIN, first: Column | None = None
) -> DataFrame:
    """Long form: one row per slot done or pending in the week before ``as_of``.

    Contacts for which ``first`` holds also give their answer of day 0, as a slot without
    status. ``repeats`` marks a second slot with the same status and day as the first,
    so that a contact can be counted once without grouping by contact.
    """
    if not set(slots) <= {1, 2}:
        raise ValueError(f"no such follow-up slot: {slots}")
    require_columns(contacts, "sve", "verified_at", *[f"{f}_{s}" for s in slots for f in SLOT_FIELDS])
    live = {s: F.col(f"status_{s}").isin(*vocab.live_status) for s in slots}
    week = [c for c in ("snapshot_week",) if c in contacts.columns]
    # the status test needs no parsing and reaches the scan
    wanted = live[1] | live[2] if len(slots) == 2 else live[slots[0]]
    if first is not None:
        require_columns(contacts, "symptoms_day0")
        first = F.coalesce(first & F.col("symptoms_day0").isNotNull(), F.lit(False))
        wanted = wanted | first
    rows = contacts.where(wanted)
    rows = rows.withColumns(
        {
            "__verified": parse_datetime_as_date(F.col("verified_at")),
            **{f"__on_{s}": parse_date(F.col(f"date_{s}"), DAY_MONTH_YEAR) for s in slots},
        }
    ).withColumns(
        {
            f"__live_{s}": F.coalesce(live[s] & in_previous_week(F.col(f"__on_{s}"), as_of), F.lit(False))
            for s in slots
        }
    )
    same = (
        F.col("__live_1")
        & F.col("__live_2")
        & (F.col("status_1") == F.col("status_2"))
        & (F.col("__on_1") == F.col("__on_2"))
        if len(slots) == 2
        else F.lit(False)
    )
    structs = [
        F.struct(
            F.col(f"__live_{s}").alias("live"),
            F.date_diff(F.col(f"__on_{s}"), F.col("__verified")).alias("day"),
            F.col(f"status_{s}").alias("status"),
            (F.col(f"isolated_{s}") == vocab.no).alias("not_isolated"),
            F.col(f"reason_{s}").alias("reason"),
            F.col(f"symptoms_{s}").alias("symptoms"),
            (same if s == 2 else F.lit(False)).alias("repeats"),
        )
        for s in slots
    ]
    if first is not None:
        kind = "struct<live: boolean, day: int, status: string, not_isolated: boolean, reason: string, symptoms: string, repeats: boolean>"
        answer = F.struct(first, F.lit(0), F.lit(None), F.lit(False), F.lit(None), F.col("symptoms_day0"), F.lit(False))
        structs.append(answer.cast(kind))
    return rows.select(*week, "sve", F.inline(F.array(*structs))).where("live").drop("live")


def followup_cube(
    contacts: DataFrame,
    as_of: date,
    days: Sequence[int] = tuple(FOLLOWUP_WEEKS),
    slots: Sequence[int] = (1, 2),
    weeks: Mapping[int, Sequence[int]] | None = None,
    vocab: Vocabulary = DOMAIN,
    first_week: int | None = None,
) -> DataFrame:
    """(sve, day, status, not_isolated, reason, symptoms, n, n_first) of a study week.

    ``n`` counts slots and ``n_first`` counts a contact once per status and day.
    With ``weeks`` (day -> snapshot week offsets) only rows of those snapshots
    count, and the filter reaches the scan as a partition filter. With ``first_week`` too the
    answers of day 0 of that snapshot are counted on the way, without a status.
    """
    allowed, first = F.col("day").isin(*days), None
    if weeks is not None:
        require_columns(contacts, "snapshot_week")
        wanted = {d: [snapshot_monday(as_of, w) for w in weeks[d]] for d in days}
        scanned = {w for ws in wanted.values() for w in ws}
        allowed = F.lit(False)
        for d, ws in wanted.items():
            allowed = allowed | (F.col("status").isNotNull() & (F.col("day") == d) & F.col("snapshot_week").isin(ws))
        if first_week is not None:
            study = snapshot_monday(as_of, first_week)
            scanned |= {study}
            first, allowed = F.col("snapshot_week") == F.lit(study), allowed | F.col("status").isNull()
        contacts = contacts.where(F.col("snapshot_week").isin(sorted(scanned)))
    rows = followup_slots(contacts, as_of, slots, vocab, first).where(allowed)
    # a reason only counts for contacts that do not isolate
    rows = rows.withColumn("not_isolated", F.coalesce("not_isolated", F.lit(False))).withColumn(
        "reason", F.when(F.col("not_isolated"), F.col("reason"))
    )
    return rows.groupBy("sve", "day", "status", "not_isolated", "reason", "symptoms").agg(
        F.count("*").alias("n"), F.count_if(~F.col("repeats")).alias("n_first")
    )


def status_counts(cube: DataFrame) -> DataFrame:
    return cube.where("status IS NOT NULL").groupBy("sve", "day", "status").agg(F.sum("n_first").alias("n"))


def reason_counts(cube: DataFrame) -> DataFrame:
    return cube.where("not_isolated").groupBy("sve", "day", "reason").agg(F.sum("n").alias("n"))


def symptom_counts(cube: DataFrame, value: str) -> DataFrame:
    return cube.where(F.col("symptoms") == value).groupBy("sve", "day").agg(F.sum("n").alias("n"))


def followup(
    contacts: DataFrame,
    day: int,
    as_of: date,
    slots: Sequence[int] = (1, 2),
    week: int | None = None,
    vocab: Vocabulary = DOMAIN,
) -> dict[str, DataFrame]:
    """The four result tables for one day, keyed by kind.

    ``week`` is the snapshot offset of the contacts; a day that cannot fall in
    the study week from that snapshot is refused.
    """
    if week is not None and week not in FOLLOWUP_WEEKS.get(day, (week,)):
        raise ValueError(f"day {day} cannot be followed up from snapshot week {week}")
    cube = followup_cube(contacts, as_of, days=(day,), slots=slots, vocab=vocab)
    tables = {
        "status": status_counts(cube),
        "reason": reason_counts(cube),
        "symptomatic": symptom_counts(cube, vocab.yes),
        "asymptomatic": symptom_counts(cube, vocab.no),
    }
    return {kind: df.drop("day").withColumnRenamed("n", f"followup_day{day}") for kind, df in tables.items()}


def _by_day(counts: DataFrame, keys: Sequence[str], days: Sequence[int]) -> DataFrame:
    """Days side by side, zero-filled."""
    return counts.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("day") == d, F.col("n")).otherwise(F.lit(0))).alias(f"day{d}") for d in days]
    )


def followup_table(cube: DataFrame, days: Sequence[int] = tuple(FOLLOWUP_WEEKS), vocab: Vocabulary = DOMAIN) -> DataFrame:
    """Follow-ups by territory and status, with one totals row."""
    columns = [f"day{d}" for d in days]
    body = _by_day(status_counts(cube), ["sve", "status"], days)
    rolled = body.groupingSets([["sve", "status"], []], "sve", "status").agg(
        (F.grouping("status") == 1).alias("is_total"), *[F.sum(c).alias(c) for c in columns]
    )
    of_total = lambda label, column: F.when(F.col("is_total"), F.lit(label)).otherwise(F.col(column)).alias(column)
    return rolled.select(of_total(vocab.total, "sve"), "is_total", of_total("---", "status"), *columns)


def isolation_reasons(cube: DataFrame, days: Sequence[int] = tuple(FOLLOWUP_WEEKS)) -> DataFrame:
    """Reasons for not isolating by territory, without a totals row."""
    return _by_day(reason_counts(cube), ["sve", "reason"], days)


def symptom_evolution(
    contacts: DataFrame | None,
    cube: DataFrame,
    value: str | None = None,
    days: Sequence[int] = tuple(FOLLOWUP_WEEKS),
    vocab: Vocabulary = DOMAIN,
) -> DataFrame:
    """Contacts answering ``value`` on day 0 and on each follow-up day.

    ``contacts`` are those of the study week, as rows or as a count cube; None where ``cube`` holds their answers.
    """
    value = vocab.yes if value is None else value
    if contacts is None:
        return _evolution(_by_day(symptom_counts(cube, value), ["sve"], (0, *days)), days, vocab)
    answered = contacts.where(F.col("symptoms_day0") == value)
    day0 = count_by(answered, "sve", name="day0")
    columns = ["day0"] + [f"day{d}" for d in days]
    later = _by_day(symptom_counts(cube, value), ["sve"], days)
    none = lambda names: [F.lit(None).cast("bigint").alias(c) for c in names]
    both = union_all([day0.select("sve", "day0", *none(columns[1:])), later.select("sve", *none(["day0"]), *columns[1:])])
    return _evolution(both, days, vocab)


def _evolution(both: DataFrame, days: Sequence[int], vocab: Vocabulary) -> DataFrame:
    columns = [f"day{d}" for d in (0, *days)]
    measures = {c: F.coalesce(F.sum(c), F.lit(0)) for c in columns}
    table = with_totals(both, "sve", measures, vocab.total)
    return table.withColumn("total", sum((F.col(c) for c in columns[1:]), F.col("day0")))
