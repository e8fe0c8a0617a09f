"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A short test item inside a long document has almost no Jaccard similarity with
it, so a signature of fixed length would miss it. Items are partitioned by their number of
shingles, and each partition has its own share: the part of a document's shingles that its bottom-k MinHash
signature needs, so that a document that holds the wanted part of an item has none of the
item's shingles in it with a probability of ``miss`` at most. Documents are partitioned by size too, in steps of an
eighth at most, and a partition's signatures have the shares of its largest size. Signatures never leave
their task: they are looked up in the items' shingles, and only documents that hit are read on.

Of a document that holds the wanted part of an item no more than the rest of the item's shingles
can be missing, so it has one of any set of one more than that. The item's rarest in these documents are
taken, which makes candidates of phrases that many items and documents share only where nothing rarer
is in the item. Candidates are compared by their exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contagrid.llm.common import PLAIN_WORD, ascii_lower, text_of, written

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-6


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(PLAIN_WORD), F.lit(0))


def _places(column: str, shingle: int) -> Column:
    n = F.size(column) - shingle
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def hashes(column: str, shingle: int = SHINGLE) -> Column:
    """A 64-bit hash of each run of ``shingle`` words of an array column."""
    return F.transform(_places(column, shingle), lambda i: F.xxhash64(*[F.get(column, i + k) for k in range(shingle)]))


def shingles(column: str, shingle: int = SHINGLE) -> Column:
    return F.transform(_places(column, shingle), lambda i: F.array_join(F.slice(column, i + 1, shingle), " "))


def _needed(item_shingles: Column, containment: float) -> Column:
    """How many of an item's shingles a document must have."""
    return F.greatest(F.lit(1), F.ceil(item_shingles * F.lit(containment) - F.lit(1e-9))).cast("int")


def signature_share(needed: Column, miss: float = MISS) -> Column:
    """Share of a document's shingles its signature needs, so that a text with ``needed`` shingles in it is missed so seldom."""
    return F.lit(1.0) - F.pow(F.lit(float(miss)), F.lit(1.0) / needed)


def partition_size(n: Column) -> Column:
    """Largest size of the partition of documents with ``n`` shingles: sixteen partitions, at most, from a power of two to the next."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(n.cast("double"))) - 3.0))
    return F.ceil(n / step) * step


def signatures(cut: DataFrame, share: Column, shingle: int = SHINGLE) -> DataFrame:
    """row, h, place, partition: the smallest hashes of a document's shingles, as many as ``share`` of its partition's size, from place 0 on."""
    hashed = cut.select("row", F.sort_array(F.array_distinct(hashes("words", shingle))).alias("hs"))
    sized = hashed.select("row", "hs", partition_size(F.size("hs")).alias("partition"))
    longest = F.ceil(share * F.col("partition")).cast("int")
    return sized.select("row", "partition", F.posexplode(F.slice("hs", F.lit(1), longest)).alias("place", "h"))


def contained_items(
    docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, miss: float = MISS
) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment: each item of which a document holds the wanted part.

    ``docs`` (doc_id, text) are searched for ``items`` (item_id, text): words are
    runs of letters and digits in lower case, and containment is the share of an
    item's distinct shingles that the document has. Null texts and texts of
    fewer words than a shingle hold nothing and are found nowhere; items without item_id are not searched for. Rows that
    repeat an item_id are one item with the shingles of all; rows that repeat a doc_id are
    searched each and give one row with the largest share; rows without doc_id
    give rows without doc_id. Other columns are ignored.
    """
    item_words = items.where("item_id IS NOT NULL").select("item_id", words(text_of()).alias("words"))
    exact = item_words.select("item_id", F.explode(shingles("words", shingle)).alias("s")).distinct()
    sizes = exact.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    sizes = sizes.withColumn("needed", _needed(F.col("item_shingles"), containment))
    exact = written(exact.join(sizes, "item_id"), "decontaminate-items")
    # A hash that several items have is looked for at the largest of their shares.
    probes = item_words.select("item_id", F.explode(hashes("words", shingle)).alias("h")).distinct().join(sizes, "item_id")
    probes = written(probes.groupBy("h").agg(F.max(signature_share(F.col("needed"), miss)).alias("share")), "decontaminate-probes")
    largest = probes.agg(F.max("share")).first()[0] or 0.0

    cut = docs.select("doc_id", text_of().alias("text")).withColumn("words", words(F.col("text")))
    cut = cut.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "words")
    # Coalesced, as a filter of nulls would go below the signatures and cut the texts into words for each shingle.
    within = F.col("place") < F.ceil(F.col("share") * F.coalesce("partition", F.lit(0.0)))
    hits = signatures(cut, F.lit(largest), shingle).join(probes, "h").where(within)
    # Written tables on the right of a join come straight from its shuffle, so that a hot key on the left can be split.
    suspects = written(hits.select("row").distinct(), "decontaminate-suspects")
    held = cut.join(suspects, "row", "left_semi").select("doc_id", "row", F.explode(F.array_distinct(shingles("words", shingle))).alias("s"))
    held = written(held.join(exact.select("s"), "s", "left_semi").distinct(), "decontaminate-held")

    documents = held.groupBy("s").agg(F.count("*").alias("documents"))
    rarest = Window.partitionBy("item_id").orderBy(F.coalesce("documents", F.lit(0)), "s")
    ranked = exact.join(documents, "s", "left").withColumn("rank", F.row_number().over(rarest))
    telling = written(ranked.where("rank <= item_shingles - needed + 1").select("s", "item_id"), "decontaminate-telling")
    candidates = written(held.join(telling, "s").select("doc_id", "row", "item_id").distinct(), "decontaminate-candidates")

    wanted = candidates.join(exact, "item_id")
    shared = (
        wanted.join(held.select("row", "s"), ["row", "s"], "left_semi")
        .groupBy("doc_id", "row", "item_id", "item_shingles", "needed")
        .agg(F.count("*").alias("shared"))
        .where("shared >= needed")
    )
    return shared.groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared").alias("shared")).withColumn(
        "containment", F.col("shared") / F.col("item_shingles")
    )
