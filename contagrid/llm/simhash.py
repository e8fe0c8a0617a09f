"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Every bit position gets a non-zero vector of ``radius + 1`` bits, and every
non-zero such vector ``v`` is one table, whose mask keeps the positions with an
odd inner product with ``v``. Two fingerprints within the radius differ in at
most ``radius`` positions; some ``v`` is orthogonal to all their vectors, and in
its table the two agree on every kept bit. So no pair within the radius is ever
missed, and as a mask keeps half of the bits, others seldom meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from contagrid.llm.common import hot_split_join, written
from contagrid.llm.components import components
from contagrid.llm.texts import word_blocks

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; each is 1 if it is set in over half of the shingles' XXH64 values, repeats counted.

    Fewer words than a shingle are one shingle; no word gives 0.
    """
    ones, total, tail, short = np.zeros(BITS, np.int64), 0, [], []
    for words in word_blocks(text):
        words = tail + words
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
        if len(words) < shingle:
            short = words
            continue
        short = []
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = starts[shingle - 1 :] + sizes[shingle - 1 :]
        n = len(ends)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n
        )
        total += n
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, np.int64)
    if short and not total:
        total = 1
        value = np.array([xxhash.xxh64_intdigest(b" ".join(short), SEED)], np.uint64)
        ones = np.unpackbits(value.view(np.uint8), bitorder="little").astype(np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (a signed long with the 64 bits) for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fingerprint"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(of, "doc_id long, fingerprint long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering tables' masks, as signed longs."""
    top = 2 ** (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    unsigned = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links enough to join each bucket's members that are within the radius: a spanning forest, never all pairs."""
    for batch in batches:
        a, b = [], []
        for members, radius in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes = [m["node"] for m in members]
            bits = np.array([m["fingerprint"] for m in members], np.int64).view(np.uint64)
            left = np.arange(1, len(bits))
            front = [0]
            while left.size or front:
                if not front:
                    front, left = [int(left[0])], left[1:]
                    continue
                here = front.pop()
                near = np.bitwise_count(bits[left] ^ bits[here]) <= radius
                for other in left[near].tolist():
                    a.append(nodes[here])
                    b.append(nodes[other])
                    front.append(other)
                left = left[~near]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _ball(bits: Column, radius: int) -> Column:
    """All values that differ from ``bits`` in up to ``radius`` of its positions."""
    flips = {0}
    for _ in range(radius):
        flips |= {f ^ 1 << i for f in flips for i in range(BITS)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in flips)
    return F.transform(F.array(*map(F.lit, signed)), lambda f: bits.bitwiseXOR(f))


def _hub_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links by common neighbours: two fingerprints within an even radius have a value within half of it of both.

    Any two that share such a hub are within the radius, so each is linked to the
    hub's smallest node. Rows grow in proportion to the nodes, however close they are.
    """
    hubs = nodes.select("node", F.explode(_ball(F.col("fingerprint"), radius // 2)).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    return hot_split_join(hubs, least.drop("n"), ["hub"], "inner").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def links(nodes: DataFrame, radius: int = RADIUS, largest: int = 1024) -> DataFrame:
    """a, b: links between nodes (node, fingerprint; fingerprints distinct) that join exactly those within ``radius``.

    A bucket of up to ``largest`` fingerprints is searched in one task; those of
    larger ones are linked through hubs, which no bucket's size slows down. The
    radius must be even for that.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    places = [F.struct(F.lit(t).cast("byte").alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("kept_bits")) for t, m in enumerate(masks(radius))]
    entries = nodes.select("node", "fingerprint", F.explode(F.array(*places)).alias("at")).select("node", "fingerprint", "at.*")
    key = ["mask", "kept_bits"]
    buckets = written(entries.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    members = hot_split_join(entries, buckets, key, "inner")
    inside = (
        members.where(F.col("n") <= largest)
        .groupBy(*key)
        .agg(F.collect_list(F.struct("node", "fingerprint")).alias("members"))
        .select("members", F.lit(radius).alias("radius"))
        .mapInArrow(_bucket_links, "a long, b long")
    )
    if buckets.where(F.col("n") > largest).isEmpty():
        return inside
    crowded = hot_split_join(entries, buckets.where(F.col("n") > largest), key, "left_semi")
    return inside.union(_hub_links(crowded.select("node", "fingerprint").distinct(), radius))


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs`` (doc_id, text).

    Rows are linked when their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id that links reach, itself included. Null
    and empty texts have fingerprint zero and are linked like any other. Copies
    share a fingerprint and are compared once. Rows that repeat a doc_id are
    one document, whose fingerprints are linked to one another; rows without doc_id
    are linked like any other, and have a null component_id if no id is reached. Other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle), "simhash-fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    nodes = written(nodes, "simhash-nodes")
    found = links(nodes.select(F.col("fingerprint").alias("node"), "fingerprint"), radius).union(_links_of_ids(prints))
    found = components(found).select(F.col("node").alias("fingerprint"), "component")
    placed = written(nodes.join(found, "fingerprint", "left"), "simhash-placed")
    # a component may hold very many fingerprints
    joined_up = placed.where("component IS NOT NULL")
    labels = joined_up.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = hot_split_join(joined_up, labels, ["component"], "left").select("fingerprint", "component_id")
    copies = placed.where("component IS NULL AND n > 1").select("fingerprint", F.col("least").alias("component_id"))
    # a lone fingerprint's document is its own component
    joined = hot_split_join(prints, labelled.union(copies).withColumn("known", F.lit(True)), ["fingerprint"], "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _links_of_ids(prints: DataFrame) -> DataFrame:
    """a, b: each other fingerprint of a repeated id, linked to the id's smallest."""
    known = prints.where("doc_id IS NOT NULL")
    repeated = known.groupBy("doc_id").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("highest"))
    repeated = repeated.where("b < highest").drop("highest")
    others = hot_split_join(known, repeated, ["doc_id"], "inner").where("fingerprint <> b")
    return others.select(F.col("fingerprint").alias("a"), "b").distinct()
