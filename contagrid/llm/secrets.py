"""Secret scan by a trigram inverted index, in DataFrame operations only.

From each rule's regular expression follows a Boolean query of trigrams that a text
must hold to match. The index has, for each block of texts and each trigram that
a query names, the postings: the texts of the block that hold it. Queries are
answered by intersecting and uniting postings block by block, and only the texts they
leave are read with the rule's expression. A rule without mandatory trigrams reads all texts.

A text stands in the index under a hash of itself and of one of a few slices its id
falls into: copies share postings, and yet no key has all rows of a hot text. Two texts
of one hash share candidates, which the expressions then tell apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contagrid.llm.common import hot_split_join, text_of, written
from contagrid.llm.secret_rules import RULES, Rule
from contagrid.llm.trigrams import ALL, alternatives, required

BLOCK = 4096
SLICES = 64
#: Matches of a text whose places are added up together; the sums of such parts are added up in turn.
PART = 256
SPAN = "struct<start: int, rank: int, kind: string, end: int>"


def _any_of(grams: Sequence[str]) -> str:
    """An expression that finds a trigram at each place where one begins, overlapping ones too."""
    literal = lambda text: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in text)
    possible = "".join(f"[{literal(sorted({g[i] for g in grams}))}]" for i in range(3))
    tails: dict[str, list[str]] = {}
    for g in sorted(grams):
        tails.setdefault(g[0], []).append(g[1:])
    branches = "|".join(f"{literal(first)}(?:{'|'.join(map(literal, rest))})" for first, rest in tails.items())
    return f"(?={possible})(?=({branches}))"


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    slice_ = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
    return docs.select(F.col("doc_id").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text", slice_))


def index(keyed: DataFrame, grams: Sequence[str], block: int = BLOCK) -> DataFrame:
    """block, gram, keys: the postings of ``grams`` in ``keyed`` (text, key), about ``block`` texts a block.

    Trigrams are of the lower-cased text, which for ASCII letters in whatever surroundings is a-z.
    """
    blocks = max(1, -(-keyed.count() // block))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(grams)), F.lit(1)))
    rows = keyed.select("key", F.explode(found).alias("gram")).select(F.pmod("key", F.lit(blocks)).alias("block"), "gram", "key")
    return rows.repartition("block").groupBy("block", "gram").agg(F.collect_set("key").alias("keys"))


def candidates(postings: DataFrame, queries: Sequence[set[frozenset[str]]]) -> DataFrame:
    """key, met: the texts that meet queries (sets of trigrams, one of which a text must hold), and which by number.

    Within a block, the postings of a set's trigrams are intersected, shortest first, and what the sets leave is united.
    """
    held = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("postings"))
    sets = [(n, sorted(grams)) for n, query in enumerate(queries) for grams in sorted(query, key=sorted)]
    asked = F.array(*[F.struct(F.lit(n).alias("query"), F.array(*map(F.lit, grams)).alias("grams")) for n, grams in sets])
    none = F.array().cast("array<bigint>")

    def intersected(grams: Column) -> Column:
        lists = F.transform(grams, lambda g: F.coalesce(F.element_at("postings", g), none))
        lists = F.array_sort(lists, lambda a, b: F.size(a) - F.size(b))
        return F.aggregate(lists, lists[0], F.array_intersect)

    answers = F.transform(asked, lambda s: F.struct(s["query"].alias("query"), intersected(s["grams"]).alias("keys")))
    each = held.select("block", F.inline(answers)).select("block", "query", F.explode("keys").alias("key"))
    return each.groupBy("block", "key").agg(F.collect_set("query").alias("met")).select("key", "met")


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Start, rank, kind and end of the rule's matches in the text, leftmost first; places are code points, the end exclusive.

    The text splits at its matches, so places are sums of lengths. They are added up
    in parts, as a sum that grows a list is quadratic in its length.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = [F.transform(x, F.char_length) for x in (F.split(text, rule.pattern, -1), whole)]
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.char_length(g) >= rule.shortest)
    steps = F.arrays_zip(F.slice(lengths[0], F.lit(1), F.size(whole)).alias("gap"), lengths[1].alias("size"), kept.alias("kept"))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / PART).cast("int")), lambda p: F.slice(steps, p * PART + 1, F.lit(PART))
    )

    def add(sofar: Column, step: Column) -> Column:
        start = sofar["at"] + step["gap"]
        end = start + step["size"]
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(step["kept"], F.array_append(sofar["found"], span)).otherwise(sofar["found"]).alias("found"))

    def behind(sofar: Column, part: Column) -> Column:
        moved = F.struct(sofar["at"].alias("at"), part["found"].alias("found"))
        return F.struct((sofar["at"] + part["at"]).alias("at"), F.array_append(sofar["parts"], moved).alias("parts"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("found"))
    summed = F.transform(parts, lambda part: F.aggregate(part, empty, add))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at: int, found: array<struct<start: int, end: int>>>>").alias("parts"))
    placed = F.aggregate(summed, none, behind)["parts"]
    moved = F.transform(
        placed,
        lambda p: F.transform(
            p["found"],
            lambda s: F.struct(
                (p["at"] + s["start"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (p["at"] + s["end"]).alias("end")
            ),
        ),
    )
    return F.when(F.regexp_like(text, pattern), F.flatten(moved)).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, block: int = BLOCK) -> DataFrame:
    """doc_id, spans: one row for each row of ``docs`` (doc_id, text), spans by start, then in the rules' order.

    A rule's matches are leftmost and don't overlap; those whose group is too short
    are dropped after that. A null text counts as empty; empty texts have no
    spans. Rows that repeat an id or a text have spans each; ids may be null. Other columns are ignored; an
    empty table gives an empty result.
    """
    queries = [required(rule.pattern) for rule in rules]
    indexed = [n for n, q in enumerate(queries) if q is not ALL]
    keyed = _keyed(docs)
    asked = F.array().cast("array<int>")
    if indexed:
        sets = [alternatives(queries[n]) for n in indexed]
        grams = sorted({g for query in sets for s in query for g in s})
        postings = written(index(keyed, grams, block), "secret-postings")
        found = written(candidates(postings, sets), "secret-candidates")
        keyed = hot_split_join(keyed, found, ["key"], "left")
        asked = F.coalesce("met", asked)
    text, parts = F.col("text"), []
    for rank, rule in enumerate(rules):
        here = spans(text, rule, rank)
        parts.append(F.when(F.array_contains("asked", indexed.index(rank)), here).otherwise(_no_spans()) if rank in indexed else here)
    return keyed.withColumn("asked", asked).select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def written_spans(spans_: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
