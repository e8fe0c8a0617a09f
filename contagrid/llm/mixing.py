"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is how often each of its documents is wanted. The
whole part is taken of every document; the fraction is an inclusion probability,
and the cube method turns these into 0 or 1. It moves the probabilities of a few
documents at a time along the null space of the constraints, so that the expected
totals of tokens and documents stay as they are, until each document but two has
reached 0 or 1. Blocks of a source move on their own; what is left of each, two
documents at most, meets in the next round's blocks, so rounds grow with the
logarithm of the documents. A landing problem of a few documents a source remains,
solved by trying all its samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from contagrid.llm.common import SPACED_WORD, hot_split_join, text_of, written

WEIGHTS = (1, 2, 3)
CAP = 3.0
BLOCK = 4096
HELD_BACK = 14


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, place, source_size, documents, target: one row for each source of ``sizes`` (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the
    sum of all sizes by weight. A target stops at ``cap`` times its source's size;
    what that leaves is shared by weight among the others, until none is above.
    """
    spark = sizes.sparkSession
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    # Place in the order without one task for all: the place within a sorted part, behind the rows of the parts before.
    ordered = total.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered.select("source", "source_size", "documents", F.expr("at >> 33").alias("part"), F.expr("at & 8589934591").alias("within")), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    placed = ordered.join(parts, "part").withColumn("place", F.col("skip") + F.col("within"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    weighed = written(placed.select("source", "place", "source_size", "documents", weight.alias("weight")), "mix-weights")

    above = lambda rate: F.col("weight") * F.lit(rate) > F.col("source_size") * F.lit(cap)
    rate, capped = 0.0, -1
    whole, weight_sum = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    if whole:
        rate = whole / weight_sum
        while True:
            n, held, free = weighed.agg(
                F.count_if(above(rate)),
                F.sum(F.when(above(rate), F.col("source_size") * cap)),
                F.sum(F.when(~above(rate), F.col("weight"))),
            ).first()
            if n == capped or not free:
                break
            capped, rate = n, (whole - (held or 0.0)) / free
    target = F.when(above(rate), F.col("source_size") * cap).otherwise(F.col("weight") * F.lit(rate))
    return weighed.select("source", "place", "source_size", "documents", target.alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities moved to 0 or 1, all but two, with the totals of tokens and documents kept."""
    p, held = p.tolist(), []
    sizes, draws, used = sizes.tolist(), rng.random(len(p)).tolist(), 0
    for i in range(len(p)):
        if 0.0 < p[i] < 1.0:
            held.append(i)
        if len(held) < 3:
            continue
        s = [sizes[k] for k in held]
        move = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
        if not any(move):
            move = [1.0, -1.0, 0.0]
        up = min((1 - p[k]) / m if m > 0 else p[k] / -m for k, m in zip(held, move) if m)
        down = min(p[k] / m if m > 0 else (1 - p[k]) / -m for k, m in zip(held, move) if m)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        for k, m in zip(held, move):
            p[k] += step * m
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        held = [k for k in held if 0.0 < p[k] < 1.0]
    return np.array(p)


def landing(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, held_back: int = HELD_BACK) -> np.ndarray:
    """The last of a source's probabilities to 0 or 1.

    Some of the largest documents and a few of all sizes are held back while the others fly. They and the
    two that are left are a problem small enough to try all samples and take
    the one whose tokens, and then documents, come nearest.
    """
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) > held_back + 2:
        by_size = open_[np.argsort(sizes[open_], kind="stable")]
        largest = held_back // 2
        held = np.append(by_size[-largest:], by_size[np.linspace(0, len(by_size) - largest - 1, held_back - largest).astype(int)])
        others = np.setdiff1d(open_, held)
        p[others] = flight(p[others], sizes[others], rng)
        open_ = np.union1d(held, others[(p[others] > 0) & (p[others] < 1)])
    if len(open_):
        samples = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(samples @ sizes[open_] - p[open_] @ sizes[open_])
        count = np.abs(samples.sum(1) - p[open_].sum())
        p[open_] = samples[np.lexsort((count, np.round(words + 0.02 * count * sizes[open_].mean(), 6)))[0]]
    return p


def _dealt(sizes: DataFrame, chunk: int = BLOCK) -> DataFrame:
    """``sizes`` with a ``deal`` of its own for each of the rows that are alike, so that no block has them all.

    Rows that are alike are counted and numbered anew, in chunks that tasks share: which of them has
    which number can't be told, and reruns agree.
    """
    counted = written(sizes.groupBy(*sizes.columns).agg(F.count("*").alias("n")), "mix-sizes")
    chunks = counted.where("n > 1").select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {chunk}"))).alias("chunk"))
    first = F.col("chunk") * chunk
    numbers = F.sequence(first, F.least(first + chunk, F.col("n")) - 1)
    alike = chunks.repartition("deal", "chunk").select(*sizes.columns, F.explode(numbers).alias("number"))
    return counted.where("n = 1").select(*sizes.columns).unionByName(alike.withColumn("deal", F.xxhash64("deal", "number")).drop("number"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of ``docs`` (doc_id, text, source).

    size counts the words between ASCII white space, null texts have none; taken
    is size times the copies the mix takes, at most ``cap`` rounded up. A source's
    taken words come near its target, as near as the landing problem's samples do. The
    order of rows plays no part and nothing is random: reruns agree. Rows that
    repeat a doc_id are documents of their own; texts without words are taken
    with no words; a null source is a source. Other columns are ignored.
    """
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(SPACED_WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", text_of()).alias("deal"),
    )
    sizes = _dealt(sizes)
    sources = source_targets(sizes, weights, cap)

    # The key is never null, and equal for equal sources only.
    key: Column = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    keyed = sources.select(key.alias("key"), "place", "source_size", "target", F.ceil(F.col("documents") / block).cast("long").alias("blocks"))
    joined = hot_split_join(sizes.withColumn("key", key), keyed, ["key"], "left").drop("key", "source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + F.lit(1e-9))
    units = joined.select(
        "doc_id", "size", "place", "source_size", "target", "blocks", "deal",
        whole.alias("whole"), F.greatest(wanted - whole, F.lit(0.0)).alias("p"),
    ).withColumn("block", F.expr("pmod(deal, blocks)"))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["deal", "doc_id", "size"], kind="stable")
        rng = np.random.default_rng([int(group["place"].iloc[0]), int(group["block"].iloc[0]), len(group)])
        move = landing if group["blocks"].iloc[0] == 1 else flight
        return group.assign(p=move(group["p"].to_numpy(float), group["size"].to_numpy(float), rng))

    done, blocks = [], keyed.agg(F.max("blocks")).first()[0] or 1
    while True:
        moved = written(units.groupBy("place", "block").applyInPandas(settle, units.schema), "mix-moved")
        settled = F.col("p").isin(0.0, 1.0)
        done.append(moved.where(settled))
        if blocks == 1:
            break
        # Two documents at most are left of a block.
        fewer = F.ceil(F.col("blocks") / (block // 2)).cast("long")
        units = moved.where(~settled).withColumn("blocks", fewer).withColumn("block", F.expr("block % blocks"))
        blocks = -(-blocks // (block // 2))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    taken = (F.col("whole") + F.col("p").cast("long")) * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
