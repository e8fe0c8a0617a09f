"""Give every person a surveillance territory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.fixed_values import DOMAIN, Vocabulary
from contagrid.functions.text import replace_all, strip_commas
from contagrid.operators.filters import fix_literals, require_columns
from contagrid.operators.lookups import lookup


def place_directory(gazetteer: DataFrame, vocab: Vocabulary = DOMAIN) -> DataFrame:
    """One row per place name: everything the cascade asks of the gazetteer.

    * ``place_class``: ``settlement`` if any row has a settlement category, else
      by the number of rows: ``unique`` for one row, or two of which one has no
      category; ``ambiguous`` otherwise.
    * ``settlement_sve``, ``first_sve``: territory of the first such row.
    * ``place_sves``: the distinct territories of the name.

    One aggregation over the gazetteer answers what would be five lookups.
    """
    settlement = F.col("category").isin(*vocab.settlement_categories)
    row = F.struct("source_row", "sve")
    return (
        gazetteer.where("place_name IS NOT NULL")
        .groupBy(F.upper("place_name").alias("place_name"))
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("category").isNull()).alias("n_uncategorised"),
            F.count_if(settlement).alias("n_settlements"),
            F.min(F.when(settlement, row)).alias("settlement"),
            F.min(row).alias("first"),
            F.collect_set("sve").alias("place_sves"),
        )
        .select(
            "place_name",
            F.when(F.col("n_settlements") > 0, "settlement")
            .when((F.col("n_rows") == 1) | ((F.col("n_rows") == 2) & (F.col("n_uncategorised") > 0)), "unique")
            .otherwise("ambiguous")
            .alias("place_class"),
            F.col("settlement.sve").alias("settlement_sve"),
            F.col("first.sve").alias("first_sve"),
            "place_sves",
        )
    )


def clean_place(c: Column, fixes: dict[str, str]) -> Column:
    return strip_commas(fix_literals(c, fixes))


def resolve_territory(
    patients: DataFrame,
    gazetteer: DataFrame,
    converter: DataFrame,
    vocab: Vocabulary = DOMAIN,
) -> DataFrame:
    """Every patient row plus ``place_name``, ``sve`` and ``sve_source``.

    Priority: surveillance unit, then place name, then region. Names are used
    by class: a settlement or a unique name stands for itself; an ambiguous one
    is settled by the territory of the person's region when the name occurs
    there, else by its first row; what is left takes the region's territory.
    Three left lookups and one ``coalesce``; no row is lost or multiplied.
    """
    require_columns(patients, "municipality", "uve")
    require_columns(gazetteer, "place_name", "category", "sve", "source_row")
    require_columns(converter, "sve", "uve", "region", "source_row")
    if "region" not in patients.columns:
        patients = patients.withColumn("region", F.lit(None).cast("string"))
    people = patients.withColumn("place_name", clean_place(F.col("municipality"), vocab.patient_place_fixes))
    people = people.withColumn("__unit", F.nullif("uve", F.lit(vocab.missing_uve)))
    people = lookup(people, converter, {"__unit": "uve"}, {"sve": "__by_unit"}, split_hot_keys=True)
    people = lookup(people, converter, {"region": "region"}, {"sve": "__by_region"}, split_hot_keys=True)
    people = lookup(
        people,
        place_directory(gazetteer, vocab),
        {"place_name": "place_name"},
        {c: f"__{c}" for c in ("place_class", "settlement_sve", "first_sve", "place_sves")},
        unique=True,
        split_hot_keys=True,
    )
    is_class = lambda name: F.col("__place_class") == name
    nameless = (F.col("place_name") == vocab.missing_place) & F.col("region").isNotNull()
    branches = {
        "uve": F.col("__by_unit"),
        "settlement": F.col("__settlement_sve"),
        "unique_name": F.when(is_class("unique") & ~nameless, F.col("__first_sve")),
        "name_and_region": F.when(
            is_class("ambiguous") & F.array_contains("__place_sves", F.col("__by_region")), F.col("__by_region")
        ),
        "first_name": F.when(is_class("ambiguous"), F.col("__first_sve")),
        "region": F.col("__by_region"),
    }
    source = F.coalesce(*[F.when(value.isNotNull(), F.lit(name)) for name, value in branches.items()])
    return people.select(
        *patients.columns,
        "place_name",
        F.coalesce(*branches.values()).alias("sve"),
        source.alias("sve_source"),
    )


def unresolved(resolved: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """People left without a territory, for manual correction; within each of ``keys``, if any."""
    return resolved.where("sve IS NULL").select(*keys, "cip", "municipality").distinct()


def resolve_contact_territory(
    contacts: DataFrame,
    patients: DataFrame,
    gazetteer: DataFrame,
    vocab: Vocabulary = DOMAIN,
    partition_keys: Sequence[str] = (),
) -> DataFrame:
    """A contact takes its case's territory unless its own place is a settlement.

    ``partition_keys`` (such as the snapshot week) are added to the case key, so
    that several snapshots are resolved in one plan. A case with two territories
    gives the alphabetically first, so contacts are never duplicated.
    """
    require_columns(contacts, "case_cip", "municipality")
    require_columns(patients, "cip", "sve")
    case_key = {**{k: k for k in partition_keys}, "case_cip": "cip"}
    placed = patients.where("sve IS NOT NULL")
    people = lookup(contacts, placed, case_key, {"sve": "__sve_case"}, order=("sve",), split_hot_keys=True)
    people = people.withColumn("__place", clean_place(F.col("municipality"), vocab.contact_place_fixes))
    settlements = gazetteer.where(F.col("category").isin(*vocab.settlement_categories)).withColumn(
        "place_name", F.upper("place_name")
    )
    people = lookup(people, settlements, {"__place": "place_name"}, {"sve": "__sve_own"}, split_hot_keys=True)
    return people.select(*contacts.columns, F.coalesce("__sve_own", "__sve_case").alias("sve"))


def territory_display_name(df: DataFrame, vocab: Vocabulary = DOMAIN, key: str = "sve") -> DataFrame:
    """Report spelling of territory names; applying it twice changes nothing."""
    require_columns(df, key)
    return df.withColumn(key, replace_all(F.col(key), vocab.display_rules))


def add_province(df: DataFrame, converter: DataFrame, key: str = "sve") -> DataFrame:
    """Province of a territory given by its display name."""
    return lookup(df, converter, {key: "sve_display"}, {"province": "province"})
