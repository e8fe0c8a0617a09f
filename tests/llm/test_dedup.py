"""Exact and near deduplication, components and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from contagrid.llm import decontaminate, simhash
from contagrid.llm.common import written
from contagrid.llm.components import components
from contagrid.llm.decontaminate import contained_items
from contagrid.llm.exact_dedup import chunks, exact_groups
from samples import awkward, documents, sentence, simple


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_groups(spark, clashing):
    got = exact_groups(documents(spark, clashing=clashing))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(awkward())


def test_exact_groups_with_a_hash_that_collides(spark):
    rng = random.Random(3)
    parts = [sentence(rng, 80) + ".\n" for _ in range(6)]
    texts = ["".join(rng.choice(parts) for _ in range(3)) for _ in range(40)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    got = exact_groups(documents(spark, rows), chunk_hash=lambda c: F.length(c).cast("long") % 2)
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)


def test_chunks_are_the_text(spark):
    df = documents(spark).select("text", F.array_join(chunks(F.col("text")), "").alias("again"), F.array_max(F.transform(chunks(F.col("text")), F.length)).alias("m"))
    for r in df.collect():
        assert (r["again"] or "") == (r["text"] or "") and (r["m"] or 0) <= 4096


def test_chunks_follow_content(spark):
    rng = random.Random(4)
    shared = sentence(rng, 3000, "abcdefghijklmnopqrstuvwxyz")
    df = simple(spark, [sentence(rng, 50) + " " + shared, sentence(rng, 333) + " " + shared])
    a, b = (set(r[0]) for r in df.select(chunks(F.col("text"))).collect())
    assert len(a & b) > 0.7 * len(a)


def test_exact_groups_of_nothing(spark):
    assert exact_groups(documents(spark, [])).count() == 0


def brute_simhash(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """prints: list of (id, fingerprint); rows of one id are one node."""
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_near_groups(spark):
    rng = random.Random(5)
    base = [sentence(rng, 200) for _ in range(5)]
    texts = [b.replace(b.split()[k], "changed", 1) for b in base for k in range(0, 40, 5)] + ["", None, "one", "two words", "A B C d", "a b c D"]
    rows = [(100 - i, t, "en", "s", None) for i, t in enumerate(texts)] + [(1, texts[0], "en", "s", None), (1, texts[9], "en", "s", None)]
    got = simhash.near_groups(documents(spark, rows, clashing=True)).collect()
    prints = [(i, brute_simhash(t)) for i, t, *_ in rows]
    groups = brute_components(prints)
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted((i, f"{f:016x}", groups[i]) for i, f in prints)


def brute_groups(rows):
    """(doc_id, fingerprint, component_id) of rows (doc_id, text): rows are linked by near fingerprints and by equal ids."""
    prints = [brute_simhash(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(filter(lambda x: x is not None, (least.get(root(i)), doc_id)), default=None)
    return sorted((str(d), f"{f:016x}", str(least[root(i)])) for i, ((d, _), f) in enumerate(zip(rows, prints)))


@pytest.mark.parametrize("seed", range(3))
def test_near_groups_of_repeated_and_missing_ids(spark, seed):
    rng = random.Random(seed)
    base = [sentence(rng, 30) for _ in range(12)]
    near = [t.replace(t.split()[3], "other", 1) for t in base]
    rows = [(rng.choice([rng.randint(0, 30), rng.randint(0, 30), None]), rng.choice(base + near)) for _ in range(60)]
    rows += [(5, base[0]), (5, base[1]), (3, base[1]), (90, "lone text of this row"), (None, "another lone text here"), (91, "a b c d e"), (None, "a b c d e")]
    got = simhash.near_groups(documents(spark, [(i, t, "en", "s", None) for i, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == brute_groups(rows)


def test_an_id_with_two_texts_joins_their_groups(spark):
    a, b = "the first text of it is this one", "something else altogether stands in here"
    got = simhash.near_groups(documents(spark, [(5, a, "en", "s", None), (5, b, "en", "s", None), (3, b, "en", "s", None), (9, "x y z w v", "en", "s", None), (None, "x y z w v", "en", "s", None)]))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got.collect()) == [("3", 3), ("5", 3), ("5", 3), ("9", 9), ("None", 9)]


def test_a_hot_id_with_many_texts_is_one_component(spark):
    rows = [(7, f"text number {i} of the hot id {i * i}", "en", "s", None) for i in range(300)] + [(i, f"other {i} {i * 7} text {i * 3}", "en", "s", None) for i in range(100, 130)]
    got = simhash.near_groups(documents(spark, rows)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] == 7} == {7}


def test_near_groups_of_awkward_rows(spark):
    got = simhash.near_groups(documents(spark)).collect()
    expected = {i: brute_simhash(t) for i, t, *_ in awkward()}
    assert len(got) == len(awkward()) and all(r["fingerprint"] == f"{expected[r['doc_id']]:016x}" for r in got)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_groups(documents(spark, [])).count() == 0


def test_every_pair_within_the_radius_shares_a_table():
    rng = random.Random(6)
    tables = simhash.masks(4)
    assert len(tables) == 31
    for _ in range(3000):
        flips = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        assert any(flips & (m & (1 << 64) - 1) == 0 for m in tables)


@pytest.mark.parametrize("largest", [1024, 3])
def test_crowded_buckets_lose_no_link(spark, largest):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({c ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fingerprint long")
    found = {r["node"]: r["component"] for r in components(simhash.links(nodes, largest=largest)).collect()}
    groups = brute_components(list(enumerate(values)))
    assert {i: found.get(i, i) for i in groups} == groups


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 30)] + [(3, 3), (5, None), (7, 8)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {x: 7 for x in range(7, 30)}


ITEMS = "item_id long, text string"


def brute_contained(docs, items, share=0.8):
    def runs(t):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}

    out = {}
    for item, t in items:
        want = runs(t)
        for i, text, *_ in docs:
            shared = len(want & runs(text))
            if want and shared >= share * len(want):
                out[i, item] = (len(want), max(shared, out.get((i, item), (0, 0))[1]))
    return out


def test_contained_items(spark):
    rng = random.Random(8)
    items = [(k, sentence(rng, rng.randint(6, 60))) for k in range(12)] + [(20, None), (21, ""), (22, "too short"), (23, "exactly five words are here")]
    docs = []
    for i in range(60):
        k = rng.randrange(12)
        words = items[k][1].split()
        if i % 3 == 0:  # a part, with one word changed
            words[rng.randrange(len(words))] = "other"
        around = [sentence(rng, rng.choice([3, 400, 6000])) for _ in range(2)]
        docs.append((i, f"{around[0]}, {' '.join(words).upper()}! {around[1]}" if i % 5 else around[0], "en", "s", None))
    docs += [(None, items[3][1], "en", "s", None), (7, items[4][1], "en", "s", None), (90, "well, exactly five; words ARE here.", "en", "s", None)]
    got = contained_items(documents(spark, docs, clashing=True), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared"]) for r in got} == brute_contained(docs, items)
    assert all(r["containment"] == r["shared"] / r["item_shingles"] for r in got)


def test_contained_items_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, "same text here and there again")], ITEMS)
    got = contained_items(documents(spark), items)
    assert sorted(r["doc_id"] for r in got.collect()) == [9, 10]
    assert contained_items(documents(spark, []), items).count() == 0
    assert contained_items(documents(spark), items.limit(0)).count() == 0


def test_signature_share_grows_as_items_shrink(spark):
    shares = [r[0] for r in spark.createDataFrame([(7,), (16,), (160,)], "needed int").select(decontaminate.signature_share(F.col("needed"))).collect()]
    assert shares[0] > shares[1] > shares[2] > 0 and (1 - shares[1]) ** 16 <= 1.01e-6


def test_partitions_of_sizes(spark):
    rows = spark.range(5000).select("id", decontaminate.partition_size(F.col("id")).alias("p")).collect()
    assert all(r["id"] <= r["p"] <= max(r["id"] * 9 / 8, 0) for r in rows)


@pytest.mark.parametrize("miss, most, least", [(2e-3, 0.2, 0.99), (1e-6, 0.42, 1.0)])
def test_signatures_are_short_and_miss_little(spark, miss, most, least):
    """Items of 40 words, of which documents hold just the wanted part."""
    rng = random.Random(11)
    items = [(k, sentence(rng, 40)) for k in range(150)]
    docs = []
    for k, text in items:
        words = text.split()[: 40 - 7]  # 29 of 36 shingles
        docs.append((k, f"{sentence(rng, 300)} {' '.join(words)} {sentence(rng, 300)}", "en", "s", None))
    df, probed = documents(spark, docs), spark.createDataFrame(items, ITEMS)
    assert len(brute_contained(docs, items)) == len(items)
    assert contained_items(df, probed, miss=miss).count() >= least * len(items)
    cut = df.select("doc_id", F.col("doc_id").alias("row"), decontaminate.words(F.col("text")).alias("words"))
    sized = decontaminate.signatures(cut, decontaminate.signature_share(F.lit(29), miss)).groupBy("row").agg(F.count("*").alias("k"), F.max("partition").alias("n"))
    assert all(r["k"] <= most * r["n"] + 1 for r in sized.collect())


def test_a_phrase_that_all_share_makes_no_candidates(spark, monkeypatch):
    rng = random.Random(12)
    phrase = "which of the following is true"
    items = [(k, f"{phrase} {sentence(rng, 20)}") for k in range(200)]
    docs = [(k, f"{sentence(rng, 30)} {phrase} {sentence(rng, 30)}", "en", "s", None) for k in range(200)]
    docs.append((900, f"{sentence(rng, 50)} {items[5][1]}", "en", "s", None))
    sizes = {}

    def counted(df, name):
        table = written(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(decontaminate, "written", counted)
    got = contained_items(documents(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in got] == [(900, 5, 1.0)]
    assert sizes["decontaminate-candidates"] == 1


def test_a_leaking_text_that_repeats_very_often(spark):
    rng = random.Random(13)
    item = sentence(rng, 30)
    rows = [(None, f"{sentence(rng, 5)} {item}", "en", "s", None)] * 3000 + [(i, sentence(rng, 12), "en", "s", None) for i in range(3000)]
    got = contained_items(documents(spark, rows), spark.createDataFrame([(1, item), (None, item)], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["shared"]) for r in got] == [(None, 1, 26)]


@pytest.mark.parametrize("name", ["op5_decontaminate", "op9_exact_dedup"])
def test_native_queries_stay_in_the_jvm(spark, name):
    from contagrid.llm.queries import QUERIES
    from helpers import plan

    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    for bad in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"):
        assert bad not in text
