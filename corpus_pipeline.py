"""The corpus pipeline: five operators of contagrid.llm, each on what the one before kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
docs, and the last adds how many copies of a document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contagrid.llm.common import part_of, table, text_of, written
from contagrid.llm.decontaminate import contained_items
from contagrid.llm.exact_dedup import exact_groups
from contagrid.llm.language_id import FOLDS, UNKNOWN, identify, learn
from contagrid.llm.mixing import mix
from contagrid.llm.simhash import near_groups


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labelled ones teach; those without a letter go.

    Without any labelled document no language is known, and only documents without a letter go.
    """
    model = learn(docs.where(part_of("doc_id", FOLDS) != 0))
    if not model.languages:
        return docs.where(text_of().rlike(r"\p{L}"))
    return identify(docs, model).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` and __row, a number that is never null and different in every row.

    It is 63 bits of the hash of id and text; rows that share those are written with a negative number dealt to each.
    """
    hashed = docs.withColumn("__row", F.xxhash64("doc_id", text_of()).bitwiseAND(F.lit((1 << 63) - 1)))
    shared = written(hashed.groupBy("__row").agg(F.count("*").alias("n")).where("n > 1").select("__row"), "pipeline-shared")
    if shared.isEmpty():
        return hashed
    dealt = hashed.join(shared, "__row", "left_semi").withColumn("__row", -1 - F.monotonically_increasing_id())
    return hashed.join(shared, "__row", "left_anti").unionByName(written(dealt, "pipeline-dealt"))


def by_row(keyed: DataFrame) -> DataFrame:
    """What an operator that decides by doc_id gets, so that it decides by row."""
    return keyed.drop("doc_id").withColumnRenamed("__row", "doc_id")


def all_but(best: Column, keyed: DataFrame, members: DataFrame) -> DataFrame:
    """__row of all but the best of each group; ``members`` has (__row, root) of each member but the root, which is a row too."""
    members = written(members, "pipeline-members")
    members = members.union(members.select("root", "root").distinct())
    placed = written(members.join(keyed.select("__row", "doc_id"), "__row"), "pipeline-placed")
    kept = placed.groupBy("root").agg(best.alias("best")).select(F.col("best.__row").alias("__row"))
    return written(placed.select("__row").join(kept, "__row", "left_anti"), "pipeline-dropped")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the largest doc_id, one without doc_id only if all are."""
    keyed = with_rows(docs)
    members = exact_groups(by_row(keyed)).where("NOT kept").select(F.col("doc_id").alias("__row"), F.col("keep_id").alias("root"))
    largest = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "__row"))
    # What is dropped grows with the corpus, so it is shuffled at every size rather than broadcast at small ones.
    dropped = all_but(largest, keyed, members).hint("shuffle_hash")
    return keyed.join(dropped, "__row", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one row: that with the smallest doc_id, one without doc_id only if all are."""
    keyed = with_rows(docs)
    members = near_groups(by_row(keyed)).where("doc_id <> component_id").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("root"))
    smallest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    return keyed.join(all_but(smallest, keyed, members), "__row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    keyed = with_rows(docs)
    held = contained_items(by_row(keyed), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__row")).distinct()
    return keyed.join(written(held, "pipeline-leaks"), "__row", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the mix takes, each with its ``copies``; documents without words add nothing to a mix and are not taken."""
    keyed = with_rows(docs.drop("copies"))
    copies = (F.col("taken") / F.col("size")).cast("int").alias("copies")
    taken = mix(by_row(keyed)).where("taken > 0").select(F.col("doc_id").alias("__row"), copies)
    # Most documents are taken: shuffled at every size.
    taken = written(taken, "pipeline-mix").hint("shuffle_hash")
    return keyed.join(taken, "__row", "inner").select(*docs.drop("copies").columns, "copies")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mixture),
]
#: SQL can't express the language models, fingerprints and sampling; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
