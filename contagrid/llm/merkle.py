"""Merkle manifest of a dataset, with inclusion proofs by pointer jumping.

Rows are leaves, in order within their language; every eight neighbours become
one node, up to one subroot a language, and the subroots likewise become the root. The
children of one node share all that is above them, so an inner node is the unit of
the jumps: it points to an ancestor and holds the sibling segments on the way
there, one for each level. A join of the nodes with themselves doubles the distance
and puts the segments together; after as many rounds as the depth has bits,
every node, and through its parent every leaf, has reached the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contagrid.llm.common import hot_split_join, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: The space of the nodes above the subroots; languages have theirs from 0.
TOP = -1
STEP = "struct<left: binary, right: binary>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_of(digests: Column) -> Column:
    """Digests as the lower-case text that is hashed further up."""
    return F.lower(F.hex(digests))


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**replaced: Column) -> Column:
    """The leaf of a row of ``documents``, with some of its fields replaced."""
    return digest(*[encoded(replaced.get(name, F.col(name))) for name in FIELDS])


def fold(proof: Column, leaf: Column) -> Column:
    """The root (lower-case text) that a leaf and the siblings of its proof give."""
    return F.aggregate(
        proof, hex_of(leaf), lambda below, step: F.sha2(F.concat(hex_of(step["left"]), below, hex_of(step["right"])), 256)
    )


def siblings(proof: Column) -> Column:
    """The proof's digests, leaf to root and left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: hex_of(F.concat(step["left"], step["right"]))), "")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``at``, their place in the order from 0; the order is a distributed sort.

    The place is that within a sorted part, behind the rows of the parts before it.
    """
    ordered = rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = ordered.withColumns({"part": F.expr("at >> 33"), "at": F.expr("at & 8589934591")})
    ordered = written(ordered, name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return ordered.join(parts, "part").withColumn("at", F.col("at") + F.col("skip")).drop("part", "skip")


def levels(width: int) -> int:
    """Levels above so many neighbours."""
    n = 0
    while width > 1:
        width, n = -(-width // ARITY), n + 1
    return n


def _runs(nodes: DataFrame, *carried: str) -> DataFrame:
    """space, level, up, width, members: the children of each node to be, in order."""
    member = F.struct("i", "digest", *carried)
    up = F.expr(f"i div {ARITY}").alias("up")
    return nodes.groupBy("space", "level", "width", up).agg(F.array_sort(F.collect_list(member)).alias("members"))


def _parents(runs: DataFrame) -> DataFrame:
    """The nodes above the runs that have more than one node beside them, or one run only."""
    inside = F.array_join(F.transform("members", lambda m: hex_of(m["digest"])), "")
    return runs.where("width > 1").select(
        "space", (F.col("level") + 1).alias("level"), F.col("up").alias("i"), F.expr(f"(width + {ARITY - 1}) div {ARITY}").alias("width"), digest(inside).alias("digest")
    )


def _beside(member: str, members: str = "members") -> Column:
    """The siblings left and right of a member of a run."""
    joined = lambda test: F.unhex(F.array_join(F.transform(F.filter(members, test), lambda m: F.hex(m["digest"])), ""))
    return F.struct(
        joined(lambda m: m["i"] < F.col(member)["i"]).alias("left"), joined(lambda m: m["i"] > F.col(member)["i"]).alias("right")
    )


def _parent_id(top_levels: int) -> Column:
    """Where the children of a run point: a subroot stands in the space above, and nothing is pointed to at the root."""
    last = F.col("width") <= ARITY
    inside = F.struct("space", (F.col("level") + 1).cast("int").alias("level"), F.col("up").alias("i"))
    subroot = F.struct(F.lit(TOP).cast("long").alias("space"), F.lit(0).alias("level"), F.col("space").alias("i"))
    parent = F.when((F.col("space") != TOP) & last, subroot).otherwise(inside)
    at_root = (parent["space"] == TOP) & (parent["level"] == top_levels)
    return F.when(~at_root, parent)


def proofs(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, claimed, subroot, root, proof: one row for each row of ``docs`` (``FIELDS``).

    leaf, subroot and root are digests. ``proof`` has a step for each level that a
    leaf goes up, with the siblings left and right of it; folded from the leaf,
    they give the root. ``claimed`` is the digest of a row as somebody presents it
    (null: as it is), to be folded in the leaf's place.

    Leaves ascend by doc_id within their language, null first; rows that repeat an id
    by their digest. Null and empty languages are two. Equal rows have a leaf each. A table of one row has an empty
    proof, and its leaf is the root. Other columns are ignored; an empty table gives an empty result.
    """
    claimed = F.lit(None).cast("binary") if claimed is None else claimed
    leaves = docs.select("lang", "doc_id", leaf_digest().alias("digest"), claimed.alias("claimed"))
    # Equal rows are alike in any order, and so a part of the sort needn't hold all of them.
    leaves = written(leaves.withColumn("dealt", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("dealt")]
    leaves = numbered(leaves, order, "merkle-order")
    langs = leaves.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("width"))
    langs = written(numbered(langs, [F.col("first")], "merkle-lang-order").withColumnRenamed("at", "space"), "merkle-langs")
    n_langs, widest = langs.agg(F.count("*"), F.max("width")).first()
    top_levels = levels(n_langs)

    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias("key")
    keyed = hot_split_join(leaves.withColumn("key", key(F.col("lang"))), langs.select(key(F.col("lang")), "space", "first", "width"), ["key"], "left")
    nodes = keyed.select("space", F.lit(0).alias("level"), "width", (F.col("at") - F.col("first")).alias("i"), "digest", "doc_id", "claimed")
    leaf_runs = written(_runs(nodes, "doc_id", "claimed"), "merkle-leaf-runs")

    # Subroots: the lone leaves, and of each level the nodes that have nothing beside them.
    subroots = [leaf_runs.where("width = 1").select("space", F.expr("members[0].digest").alias("digest"))]
    inner, runs = [], leaf_runs
    for _ in range(levels(widest or 0)):
        above = _parents(runs)
        runs = written(_runs(above), "merkle-runs")
        subroots.append(runs.where("width = 1").select("space", F.expr("members[0].digest").alias("digest")))
        inner.append(runs.where("width > 1"))
    subroot = subroots[0]
    for more in subroots[1:]:
        subroot = subroot.union(more)
    subroot = written(subroot, "merkle-subroots")
    nodes = subroot.select(F.lit(TOP).cast("long").alias("space"), F.lit(0).alias("level"), F.lit(n_langs).cast("long").alias("width"), F.col("space").alias("i"), "digest")
    for _ in range(top_levels):
        runs = written(_runs(nodes), "merkle-top-runs")
        inner.append(runs)
        nodes = _parents(runs)
    root = nodes.select("digest").first()

    reached = _jump(inner, top_levels, max(levels(widest or 0) - 1, 0) + top_levels)
    lang_of = langs.select("space", "lang").join(subroot.withColumnRenamed("digest", "subroot"), "space")
    lone = F.struct(F.lit(TOP).cast("long").alias("space"), F.lit(0).alias("level"), F.col("space").alias("i"))
    pointing = F.when(F.col("width") > 1, _parent_id(top_levels)).when(F.lit(top_levels > 0), lone)
    placed = leaf_runs.withColumn("__to", pointing)
    if reached is None:
        placed = placed.withColumn("above", F.array().cast(f"array<{STEP}>"))
    else:
        placed = placed.join(reached.select(F.col("id").alias("__to"), F.col("segment").alias("above")), "__to", "left")
    placed = hot_split_join(placed, lang_of, ["space"], "left")
    none = F.array().cast(f"array<{STEP}>")
    step = F.when(F.col("width") > 1, F.array(_beside("member").cast(STEP))).otherwise(none)
    rows = placed.select("lang", "width", "members", "above", "subroot", F.explode("members").alias("member"))
    return rows.select(
        F.col("member.doc_id").alias("doc_id"),
        "lang",
        F.col("member.digest").alias("leaf"),
        F.coalesce("member.claimed", "member.digest").alias("claimed"),
        "subroot",
        F.lit(bytes(root[0]) if root else None).cast("binary").alias("root"),
        F.concat(step, F.coalesce("above", none)).alias("proof"),
    )


def _jump(inner: list[DataFrame], top_levels: int, depth: int) -> DataFrame | None:
    """id, segment: each inner node but the root, with all steps from there to the root.

    A round replaces the node pointed to by the one that it points to, so
    distances double; only nodes at least that high are pointed to, an eighth
    to the power of the distance of all.
    """
    if not inner:
        return None
    edges = [
        runs.select("space", "level", "width", "up", "members", F.explode("members").alias("member")).select(
            F.struct("space", F.col("level").cast("int").alias("level"), F.col("member.i").alias("i")).alias("id"),
            _parent_id(top_levels).alias("to"),
            F.array(_beside("member").cast(STEP)).alias("segment"),
        )
        for runs in inner
    ]
    nodes = edges[0]
    for more in edges[1:]:
        nodes = nodes.union(more)
    nodes, distance = written(nodes, "merkle-edges"), 1
    while distance < depth:
        high = (F.col("id.space") == TOP) | (F.col("id.level") > distance)
        ahead = nodes.where(high).select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("segment").alias("more"))
        jumped = nodes.where("to IS NOT NULL").join(ahead, "to")
        jumped = jumped.select("id", F.col("next").alias("to"), F.concat("segment", "more").alias("segment"))
        nodes, distance = written(nodes.where("to IS NULL").unionByName(jumped), "merkle-jumps"), 2 * distance
    return nodes.select("id", "segment")
