"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut into chunks at places its own characters choose, so texts that
share a passage share chunks. Chunks are the only thing that carries text through
a shuffle, and each distinct chunk of a task does so once. From then on a document
is its recipe, the ordered list of its chunks' identifiers, and two texts are
equal exactly when their recipes are.

An identifier is the chunk's 64-bit hash, verified against the dictionary of
distinct chunks: where two different chunks have one hash, each gets a variant
number, and the recipes that contain them carry it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from contagrid.llm.common import hot_split_join, text_of, written

SHORTEST, LONGEST = 256, 4096


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text in pieces of ``shortest`` to ``longest`` characters; joined, they are the text again.

    A piece ends behind the first white space after ``shortest`` characters that
    stands between two of a few letters and marks, else at ``longest`` or the end.
    Such places are about as rare as ``shortest`` is long, so texts that share a
    passage soon cut it alike, whatever stands before it. Text
    that isn't valid UTF-8 is one piece, as a regular expression would alter it.
    """
    border = r"(?<=[dgkmpyDGKMPY.,;:!?|ا-دа-и]\s)(?=[b-gB-Gà-êا-رв-м])|(?<=[。!?])"
    pattern = rf"(?s).{{{shortest},{longest}}}?(?:{border})|.{{1,{longest}}}"
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.is_valid_utf8(text), pieces).otherwise(F.array(text))


def exact_groups(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs`` (doc_id, text).

    Of equal texts the row with the largest doc_id stays. A null text counts as
    empty; empty texts are equal to one another. Rows that repeat a doc_id with an
    equal text count each in group_size and share the decision; in a group whose
    ids are all null every row stays, with a null keep_id. Other columns are ignored, an
    empty table gives an empty result. ``chunk_hash`` may be weak: results stay exact.
    """
    cut = docs.select(F.col("doc_id").alias("doc_id"), text_of().alias("text")).withColumn("chunks", chunks(F.col("text")))
    piece = cut.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk")
    distinct = piece.distinct()
    # An aggregate by h alone would meet hot chunks; distinct ones are as many as there are contents.
    shared = distinct.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1").select("h")
    shared = written(shared, "exact-shared-hashes")

    recipes = cut.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.transform("chunks", lambda chunk: chunk_hash(chunk)).alias("recipe"),
    )
    recipes = written(recipes, "exact-recipes")

    # Empty unless hashes collide: then the places of those chunks, and which of the contents each is.
    placed = (
        cut.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        .select("doc_id", "text_sha256", F.posexplode("chunks").alias("place", "chunk"))
        .withColumn("h", chunk_hash(F.col("chunk")))
        .join(shared, "h", "left_semi")
    )
    variant = F.dense_rank().over(Window.partitionBy("h").orderBy("chunk"))
    contents = placed.select("h", "chunk").distinct().withColumn("variant", variant)
    variants = (
        placed.distinct()
        .join(contents, ["h", "chunk"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("place", "variant"))).alias("variants"))
    )
    if not shared.isEmpty():
        variants = written(variants.withColumnRenamed("doc_id", "__id"), "exact-variants")
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (recipes["text_sha256"] == variants["text_sha256"])
        recipes = recipes.join(variants, same, "left").select("doc_id", recipes["text_sha256"], "recipe", "variants")
        none = F.array().cast("array<struct<place:int,variant:int>>")
        identity = F.struct("recipe", F.coalesce("variants", none).alias("variants"))
    else:
        identity = F.struct("recipe")
    named = recipes.select("doc_id", "text_sha256", identity.alias("identity"))
    groups = named.groupBy("identity").agg(F.max("doc_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    joined = hot_split_join(named, groups, ["identity"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
