"""Fill-in-middle transformation with cut places found in a Fenwick tree over text blocks.

A text is cut between units: a word with the white space before it, or white space
at the end. Its UTF-8 bytes fall into blocks of a fixed size; a Fenwick tree holds how
many units end in each block and how many code points start there. Binary-lifting
descent finds the block in which the k-th unit ends and the code points before it;
only that block is then searched for the very place. Tasks find the cuts, the
texts themselves are put together and taken apart in the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contagrid.llm.common import text_of

BLOCK = 4096
PIECE = 256  # blocks looked at together while counting, which bounds the memory beside the text
SEED = 42
CHANGED_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class BlockTree(NamedTuple):
    """Fenwick trees over the blocks of a text: entry i covers the i & -i blocks up to block i, from 1."""

    data: np.ndarray
    units: np.ndarray
    points: np.ndarray
    n_units: int
    block: int


def unit_ends(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """For each byte of a range, whether a unit ends with it: the last of a word, or of the text."""
    space = _SPACE[data[start : end + 1]]
    ends = ~space[: end - start]
    if end < len(data):
        ends &= space[1:]
    else:
        ends[:-1] &= space[1:]
        ends[-1] = True
    return ends


def point_starts(data: np.ndarray) -> np.ndarray:
    """For each byte, whether it is the first of a code point."""
    return (data & 0xC0) != 0x80


def _fenwick(counts: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(counts)])
    places = np.arange(len(before))
    return before - before[places - (places & -places)]


def block_tree(text: str, block: int = BLOCK) -> BlockTree:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    units, points = [], []
    for start in range(0, len(data), block * PIECE):
        end = min(start + block * PIECE, len(data))
        places = np.arange(0, end - start, block)
        units.append(np.add.reduceat(unit_ends(data, start, end), places, dtype=np.int64))
        points.append(np.add.reduceat(point_starts(data[start:end]), places, dtype=np.int64))
    units = np.concatenate(units) if units else np.zeros(0, np.int64)
    points = np.concatenate(points) if points else np.zeros(0, np.int64)
    return BlockTree(data, _fenwick(units), _fenwick(points), int(units.sum()), block)


def code_points_before(tree: BlockTree, k: int) -> int:
    """Code points of the first ``k`` units."""
    if k == 0:
        return 0
    at, points, last = 0, 0, len(tree.units) - 1
    step = 1 << last.bit_length()
    while step := step >> 1:
        if at + step <= last and tree.units[at + step] < k:
            at += step
            k -= int(tree.units[at])
            points += int(tree.points[at])
    start, end = at * tree.block, min((at + 1) * tree.block, len(tree.data))
    place = start + int(np.flatnonzero(unit_ends(tree.data, start, end))[k - 1]) + 1
    return points + int(point_starts(tree.data[start:place]).sum())


CUTS = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def cut(text: str, one: int, other: int, block: int = BLOCK) -> dict[str, int]:
    """Units of the text, and the code points of prefix and middle; each draw picks a place modulo the places."""
    tree = block_tree(text, block)
    first, second = sorted((one % (tree.n_units + 1), other % (tree.n_units + 1)))
    prefix = code_points_before(tree, first)
    return {"n": tree.n_units, "prefix_chars": prefix, "middle_chars": code_points_before(tree, second) - prefix}


def _cuts(block: int):
    @F.arrow_udf("struct<n: bigint, prefix_chars: bigint, middle_chars: bigint>")
    def cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        # a text at a time becomes a Python object
        rows = zip(texts, one.to_pylist(), other.to_pylist())
        return pa.array([cut(text.as_py(), a, b, block) for text, a, b in rows], CUTS)

    return cuts


def draw(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th group of eight digits, from 1, of the seeded hash of an id, as an unsigned number."""
    known = F.coalesce(doc_id.cast("string"), F.lit(""))
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), known).cast("binary"), 256)
    return F.conv(F.substring(digits, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of ``docs`` (doc_id, text).

    n counts units. form is plain, psm (prefix, suffix, middle) or spm (suffix,
    prefix, middle); cut sizes are in code points and null where it is plain, for
    which the output is the text as it is. Empty texts and texts with one of the
    marks stay plain, so that every output can be taken apart again. A null text
    counts as empty, a null id as the empty id; rows that repeat an id are
    cut by the same draws, each in its own text. Other columns are ignored; an empty table gives an
    empty result.
    """
    text = text_of()
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (draw(F.col("doc_id"), 3, seed) % 100 >= CHANGED_PERCENT)
    suffix_first = draw(F.col("doc_id"), 4, seed) % 100 < SUFFIX_FIRST_PERCENT
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        text.alias("text"),
        F.when(plain, "plain").when(suffix_first, "spm").otherwise("psm").alias("form"),
        _cuts(block)(text, draw(F.col("doc_id"), 1, seed), draw(F.col("doc_id"), 2, seed)).alias("cuts"),
    )
    changed = F.col("form") != "plain"
    sizes = [F.when(changed, F.col(f"cuts.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")]
    rows = rows.select("doc_id", "text", "form", F.col("cuts.n").alias("n"), *sizes)
    places = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix = F.substring("text", F.lit(1), places[0])
    middle = F.substring("text", places[0] + 1, places[1])
    suffix = F.substring("text", places[0] + places[1] + 1, F.char_length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from; a mark in it can only be one that was put there."""
    part = lambda i: F.element_at(F.split(output, "<[PSM]>", -1), i)
    return (
        F.when(form == "psm", F.concat(part(2), part(4), part(3)))
        .when(form == "spm", F.concat(part(3), part(4), part(2)))
        .otherwise(output)
    )
