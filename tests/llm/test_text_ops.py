"""License scan, surrogates, revisits and mixing: brute force and properties."""

from __future__ import annotations

import itertools
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from contagrid.llm import licenses, mixing, pii, warc
from contagrid.llm.license_rules import BASE, LICENSES, rules
from contagrid.llm.queries import QUERIES
from samples import awkward, documents, sentence, simple

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_license(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["Under the MIT License,", "under the\tmit-license", "Apache License, Version 2.0", "CC-BY-NC", "cc by nc sa 4.0", "MIT", "license", "naïve", "undér the mit license"]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.5 else sentence(rng, 3) for _ in range(12)) for _ in range(80)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)] + [(500 + k, r[1], *r[2:]) for k, r in enumerate(awkward())]
    got = licenses.summary(licenses.scan_licenses(documents(spark, rows, clashing=True))).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == {i: brute_license(t) for i, t, *_ in rows}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: MIT-0", {"mit-0"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2"}),
        ("licensed under the GNU General Public License, version 3", {"gpl-3"}),
        ("licensed under the GNU Lesser General Public License version 2.1", {"lgpl-2.1"}),
        ("released under the terms of the Mozilla Public License 2.0", {"mpl-2"}),
        ("see https://opensource.org/licenses/BSD-3-Clause", {"bsd-3-clause"}),
        ("shared as CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
        ("a license to drive", set()),
    ],
)
def test_stronger_and_longer_rules_suppress_those_within(text, labels):
    found = licenses.Scanner().scan(licenses.as_words(text))
    assert {d["label"] for d in found if d["kept"]} == labels


def test_rules_are_hundreds_and_their_keywords_gate_nothing_they_match():
    made = rules()
    assert len(made) > 300 and len(LICENSES) > 80
    scanner, open_ = licenses.Scanner(), licenses.Scanner([r._replace(keyword="") for r in made])
    texts = [" ".join(re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\[cs\]", "s", names.split("|")[k])).replace("?", "").split())
             for _, _, _, names, _, _ in LICENSES for k in range(names.count("|") + 1) if "(" not in names and "[a" not in names]
    for text in texts:
        data = licenses.as_words(f"see {text} here")
        strip = lambda found: [(d["label"], d["form"], d["first"], d["last"], d["kept"]) for d in found]
        assert strip(scanner.scan(data)) == strip(open_.scan(data)) != []


def samples_of(parsed):
    """A text for each choice of alternatives and optional parts of a parsed pattern; of a class of characters the first."""
    kinds = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            kinds.append([chr(arg)])
        elif op == "IN":
            first, value = arg[0]
            kinds.append([chr(value if str(first) == "LITERAL" else value[0])])
        elif op == "SUBPATTERN":
            kinds.append(samples_of(arg[3]))
        elif op == "BRANCH":
            kinds.append([x for branch in arg[1] for x in samples_of(branch)])
        elif op == "MAX_REPEAT":
            kinds.append([""] * (arg[0] == 0) + samples_of(arg[2]))
        else:
            raise ValueError(op)
    return ["".join(x) for x in itertools.product(*kinds)]


def test_keywords_stand_in_every_alternative():
    for rule in rules():
        texts = samples_of(re._parser.parse(rule.pattern))
        assert texts and all(re.fullmatch(rule.pattern, x) for x in texts)
        assert all(rule.keyword in x for x in texts), rule


@pytest.mark.parametrize(
    "text, labels",
    [
        ("under the GNU Library General Public License version 2", {"lgpl-2"}),
        ("licensed under the GNU Library General Public License, version 2.0", {"lgpl-2"}),
        ("see http://license.coscl.org.cn/MulanPSL2", {"mulanpsl-2"}),
    ],
)
def test_texts_without_the_usual_keyword(text, labels):
    found = licenses.Scanner().scan(licenses.as_words(text))
    assert {d["label"] for d in found if d["kept"]} == labels


def test_kept_detections_by_brute_force():
    rng = random.Random(2)
    made = rules()
    for _ in range(200):
        spots = [(a := rng.randrange(20), a + rng.randint(1, 6), k, rng.choice(made)) for k in range(rng.randint(1, 12))]
        order = sorted(range(len(spots)), key=lambda i: (spots[i][3].priority // 1000, spots[i][0] - spots[i][1], spots[i][2], spots[i][0]))
        kept = []
        for i in order:
            if not any(spots[j][0] <= spots[i][0] and spots[i][1] <= spots[j][1] for j in kept):
                kept.append(i)
        assert licenses.Scanner._kept(spots) == [i in kept for i in range(len(spots))]


KEY = b"test key"
TEXT = "Mr. John Smith (john.smith@mail.example.org, 10.1.2.3 and 8.8.4.4) called +1 (212) 555-0199; Mrs. Jane Smith paid with 4111 1111 1111 1111. John.Smith@mail.example.org again."


def test_surrogates_keep_type_and_coreference(spark):
    texts = [TEXT, "write to john.smith@mail.example.org", "nothing here", None, ""]
    got = {r["doc_id"]: r for r in pii.pseudonymise(simple(spark, texts), KEY).collect()}
    assert [got[i]["text"] for i in (2, 3, 4)] == texts[2:] and got[2]["entities"] == []
    new = got[0]["text"]
    for secret in ("John", "Jane", "Smith", "smith@", "10.1.2.3", "8.8.4.4", "4111 1111", "212"):
        assert secret not in new
    mail = re.findall(r"[a-z]+\.[a-z]+@[a-z]+\.[a-z]+\.org", new.lower())
    assert len(mail) == 2 and mail[0] == mail[1] and got[1]["text"] == f"write to {mail[0]}"
    kinds = [e["kind"] for e in got[0]["entities"]]
    assert sorted(kinds) == sorted(["name", "name", "email", "email", "ipv4", "ipv4", "phone", "card"])
    for e in got[0]["entities"]:
        part = new[e["start"] : e["end"]]
        if e["kind"] == "card":
            assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", part) and pii.luhn(part.replace(" ", "")) == 0
        if e["kind"] == "name":
            given, surname = part.split(" ")
            gender = "m" if new[: e["start"]].endswith("Mr. ") else "f"
            assert given in pii.GIVEN["latin", gender].split()
            surnames = surname
            assert surname[0].isupper() and surname[1:].islower() and len(surname) == 5
    assert new.count(surnames) == 2


@pytest.mark.parametrize("kind, make", [
    ("ipv4", lambda i: f"10.0.{i // 250}.{i % 250}"), ("ipv4", lambda i: f"{i % 223 + 1}.{i * 7 % 256}.{i // 250}.{i % 250}"),
    ("ipv4", lambda i: f"192.168.{i // 250}.{i % 250}"), ("phone", lambda i: f"+1212555{i:04d}"), ("email", lambda i: f"ab{i}@x.org"), ("ssn", lambda i: f"123-45-{i:04d}"),
])
def test_different_entities_have_different_surrogates(kind, make):
    real = [make(i) for i in range(1500)]
    out = [pii.surrogate(kind, x, KEY) for x in real]
    assert len(set(out)) == len(real) and all(re.sub(r"\d+", "", a).count(".") == re.sub(r"\d+", "", b).count(".") for a, b in zip(real, out))
    assert out == [pii.surrogate(kind, x, KEY) for x in real] != [pii.surrogate(kind, x, b"other") for x in real]


@pytest.mark.parametrize("text, names", [
    ("Señor Juan Carlos García López dijo", ["Juan Carlos García López"]), ("Frau Anna von Berg kam", ["Anna von Berg"]), ("Frau von der Leyen und Herr Klaus", ["von der Leyen", "Klaus"]),
    ("Monsieur Jean de la Croix de", ["Jean de la Croix"]), ("Mme Jeanne d’Arc est", ["Jeanne d’Arc"]), ("Mr Adam Żak Łoś", ["Adam Żak Łoś"]), ("Mr. von nobody", []), ("Mr A Mrs B", ["A", "B"]),
])
def test_whole_names_are_replaced(text, names):
    found = pii.Detector().find(text)
    assert [text[a:b] for a, b, *_ in found] == names
    for _, _, kind, canon, gender, _ in found:
        words, new = canon.split(" "), pii.surrogate(kind, canon, KEY, 0, gender).split(" ")
        assert len(words) == len(new) and all((w == n) == (w in pii.PARTICLES) for w, n in zip(words, new) if len(w) > 2)
    new = pii.permuted("Żak Łoś ğİı", KEY, "surname")
    assert not set("ŻŁśğ") & set(new) and [c.isupper() for c in new] == [c.isupper() for c in "Żak Łoś ğİı"]


@pytest.mark.parametrize("first", [t for ts in pii.TITLES.values() for t in ts.split()])
def test_titles_in_a_row_are_no_names(first):
    for second in (t for ts in pii.TITLES.values() for t in ts.split()):
        for dots in ("", "."):
            text = f"{first}{dots} {second}{dots} Anna Berg"
            found = pii.Detector().find(text)
            assert [text[e.start : e.end] for e in found] == ["Anna Berg"], text
            genders = [pii._TITLE[t] for t in (first, second)]
            assert found[0].gender == next((g for g in genders if g != "x"), "x")


@pytest.mark.parametrize("text, found", [
    ("Dr. Anna Schmidt wrote it. Anna Schmidt lives here, Schmidt said. Schmidt's house, the schmidt, Schmidtson.", ["Anna Schmidt", "Anna Schmidt", "Schmidt", "Schmidt"]),
    ("Berg came first. Frau Anna von Berg and von nobody; von Berg left Anna", ["Berg", "Anna von Berg", "Berg", "Anna"]),
    ("г-н Иван Петров и доктор Анна Белова, Петров", ["Иван Петров", "Анна Белова", "Петров"]), ("Mr Paul Meier, Mrs Paul Stone; Paul Stone, Paul Meier", ["Paul Meier", "Paul Stone", "Paul Stone", "Paul Meier"]),
    ("password: correcthorsebattery", ["correcthorsebattery"]), ("the secret: patience", []), ("secret = 'patience'", ["patience"]), ("call 555-123-4567 or 555.123.4567", ["555-123-4567", "555.123.4567"]),
    ("from 0049 30 1234567 on", ["0049 30 1234567"]), ("at 12:34:56 and 2001:db8:0:0:0:ff00:42:8329 or fe80::1ff:fe23:4567:890a", ["2001:db8:0:0:0:ff00:42:8329", "fe80::1ff:fe23:4567:890a"]), ("a::b::c 1:2:3", []),
])
def test_what_is_found(text, found):
    assert [text[e.start : e.end] for e in pii.Detector().find(text)] == found


def test_no_planted_entity_stays_and_each_keeps_one_surrogate(spark):
    """Texts of literals and planted entities: literals stay, an entity is the same surrogate everywhere and no two share one."""
    rng = random.Random(12)
    people = {f"{g} {s}": rng.choice("mfx") for g, s in zip(["Paul", "Anna", "Ivo", "Marie", "Lotte", "Hugo"], ["Meier", "Quandt", "Zorn", "Petit", "Adler", "Kranz"])}
    titles = {"m": ["Herr", "Mr.", "Herr Dr."], "f": ["Frau", "Mme", "Frau Prof."], "x": ["Dr.", "Prof."]}
    others = ["ann.lee@post.example.org", "+49 30 1234567", "555-123-4567", "8.8.4.4", "2001:db8:0:0:0:ff00:42:8329", "4111 1111 1111 1111", "078-05-1120"]
    rows, plans = [], []
    for _ in range(60):
        pieces, here = [], rng.sample(sorted(people), 2)
        for k in range(rng.randint(2, 8)):
            pieces.append(("", rng.choice(["here it says that ", "and then, ", "once more: "])))
            if rng.random() < 0.4:
                pieces.append(("other", rng.choice(others)))
            else:
                person = rng.choice(here)
                gender = people[person] if rng.random() < 0.7 else "x"
                pieces += [("", rng.choice(titles[gender]) + " "), ("person", person), ("", "; "), ("surname", person)]
            pieces.append(("", " . "))
        plans.append(pieces)
        rows.append("".join(p.split(" ")[1] if kind == "surname" else p for kind, p in pieces))
    got = [r["text"] for r in pii.pseudonymise(simple(spark, rows), KEY).orderBy("doc_id").collect()]
    seen = {}
    for pieces, text in zip(plans, got):
        m = re.fullmatch("".join("(.+?)" if kind else re.escape(p) for kind, p in pieces), text)
        assert m, text
        for (kind, p), new in zip([x for x in pieces if x[0]], m.groups()):
            seen.setdefault(p, set()).add(new.split(" ")[-1] if kind == "surname" else new)
            if kind == "person":
                seen.setdefault("sur" + p, set()).add(new.split(" ")[1])
        words = set(re.findall(r"\w+", text))
        assert not words & {w for p in people for w in p.split(" ")} and not any(o in text for o in others)
    for person in people:
        whole = {s for s in seen[person] if " " in s}
        assert len(whole) == 1 and seen[person] - whole <= seen["sur" + person] and len(seen["sur" + person]) == 1
    surrogates = [s for p, new in seen.items() if not p.startswith("sur") for s in new if p not in people or " " in s]
    assert len(surrogates) == len(set(surrogates)) == len(people) + len(others)


def test_meeting_surrogates_are_drawn_again(spark):
    """Two-digit local parts fill their space, so surrogates must meet entities, and given names meet each other."""
    names = [f"Mr. {a}{b}rn Stone" for a in "ABCDEFGHKLMNPRST" for b in "aeiou"]
    rows = [". ".join(names), "10.0.0.1 10.0.0.2 192.168.0.1", "7@x.org 8@x.org 9@x.org"]
    found = pii.entities(simple(spark, rows)).drop("text_key")
    table = pii.dictionary(found, KEY).collect()
    real = {(r["kind"], r["canon"]) for r in table}
    assert len({(r["kind"], r["surrogate"]) for r in table}) == len(real) == len(table)
    assert not real & {(r["kind"], r["surrogate"]) for r in table}
    texts = [r["text"] for r in pii.pseudonymise(simple(spark, rows), KEY).orderBy("doc_id").collect()]
    assert len(set(re.findall(r"Mr\. (\w+ \w+)", texts[0]))) == len(names)


def test_surrogates_of_awkward_rows(spark):
    got = pii.pseudonymise(documents(spark, clashing=True), KEY)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted((str(i), t or "") for i, t, *_ in awkward())
    assert pii.pseudonymise(documents(spark, []), KEY).count() == 0


def test_surrogate_query_gives_every_document(spark, tmp_path):
    simple(spark, [TEXT, "nothing here", None, ""]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op4_pii_surrogates"](spark, str(tmp_path)).collect()}
    assert [tuple(got[i])[1:] for i in (1, 2, 3)] == [(0, "", "nothing here"), (0, "", None), (0, "", "")]
    assert len(got) == 4 and got[0]["n_entities"] == 8 and got[0]["text"] != TEXT


RECORDS = "record_id long, url string, captured_at timestamp, kind string, status int, digest string, headers map<string,string>"


def brute_revisits(rows, keys):
    out = []
    for i, url, at, kind, _, digest, headers in rows:
        if kind != "revisit":
            continue
        fits = [r for r in rows if r[3] == "response" and r[4] == 200 and url and r[1] and keys[r[1]] == keys[url] and at and r[2] and (r[2], r[0]) < (at, i)]
        if not fits:
            out.append((i, "missing", None, None, None))
            continue
        r = max(fits, key=lambda r: (r[2], r[0]))
        mine, theirs = headers or {}, r[6] or {}
        strip = lambda tag: tag and tag.removeprefix("W/")
        pairs = [(digest, r[5]), (strip(mine.get("etag")), strip(theirs.get("etag"))), (mine.get("last-modified"), theirs.get("last-modified"))]
        same = next((a == b for a, b in pairs if a is not None and b is not None), None)
        if same is False:
            out.append((i, "changed", None, None, None))
        else:
            merged = theirs | {k: v for k, v in mine.items() if k in warc.PERMITTED}
            out.append((i, "unchecked" if same is None else "resolved", r[0], r[5], tuple(sorted(merged.items()))))
    return sorted(out, key=str)


def test_revisits_against_brute_force(spark):
    rng = random.Random(3)
    urls = ["http://www.A.org/x/", "https://a.org/x?utm_source=f#top", "http://a.org/x?b=2&a=1", "a.org:80/x?a=1&b=2", "http://b.org", None]
    rows = []
    for i in range(300):
        revisit = rng.random() < 0.5
        headers = {k: rng.choice(["1", "2"]) for k in ("last-modified", "date", "content-type") if rng.random() < 0.5}
        if rng.random() < 0.5:
            headers["etag"] = rng.choice(['"1"', 'W/"1"', '"2"'])
        at = datetime(2024, 1, rng.randint(1, 4), rng.randint(0, 23)) if rng.random() < 0.97 else None
        digest = rng.choice([None, "d1", "d2"]) if revisit else rng.choice(["d1", "d2"])
        rows.append((i, rng.choice(urls), at, "revisit" if revisit else "response", 304 if revisit else rng.choice([200, 200, 404]), digest, headers if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, RECORDS)
    keys = {r["url"]: r["k"] for r in df.select("url", warc.canonical_url(df["url"]).alias("k")).distinct().collect()}
    assert keys[urls[0]] == keys[urls[1]] == "a.org/x" and keys[urls[2]] == keys[urls[3]] == "a.org/x?a=1&b=2"
    got = warc.resolve_revisits(df.selectExpr("*", "1 AS block", "2 AS response", "'x' AS outcome"))
    pack = lambda h: None if h is None else tuple(sorted(h.items()))
    assert sorted(((r["record_id"], r["outcome"], r["response_id"], r["digest"], pack(r["headers"])) for r in got.collect()), key=str) == brute_revisits(rows, keys)
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    assert warc.crawl(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_crawl_has_every_outcome(spark):
    """Pages that share a canonical URL are captured in turns: brute force over the crawl's own records."""
    urls = ["http://a.org/x", "https://www.a.org/x/", "http://b.org/?b=2&a=1", "http://b.org?a=1&b=2", "http://c.org/1", "http://c.org/2"]
    pages = [(i, urls[i % 6] if i % 4 else f"http://d.org/{i}", f"<p>{i % 5}</p>" if i % 7 else None) for i in range(120)] + [(None, urls[0], "x"), (500, None, "y")]
    records = warc.crawl(spark.createDataFrame(pages, "page_id long, url string, html string")).persist()
    rows = [tuple(r) for r in records.select("record_id", "url", "captured_at", "kind", "status", "digest", "headers").collect()]
    keys = {r["url"]: r["k"] for r in records.select("url", warc.canonical_url(records["url"]).alias("k")).distinct().collect()}
    pack = lambda h: None if h is None else tuple(sorted(h.items()))
    got = [(r["record_id"], r["outcome"], r["response_id"], r["digest"], pack(r["headers"])) for r in warc.resolve_revisits(records).collect()]
    assert sorted(got, key=str) == brute_revisits(rows, keys)
    assert {g[1] for g in got} == {"resolved", "changed", "unchecked", "missing"}
    assert {r[4] for r in rows} == {200, 304, 503}


def test_a_url_with_most_captures_at_one_time(spark):
    """It stands in several ranges, each of its share, and revisits find the response across them."""
    at = datetime(2024, 1, 1)
    rows = [(0, "http://a.org", at, "response", 200, "d", {"date": "0"})] + [(i, "http://a.org", at, "revisit", 304, "d", None) for i in range(1, 4000)]
    rows += [(i, f"http://b.org/{i}", at, "revisit", 304, None, None) for i in range(4000, 5000)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS).repartition(6)).collect()
    assert {(r["outcome"], r["response_id"]) for r in got if r["record_id"] < 4000} == {("resolved", 0)} and len(got) == 4999
    assert {r["outcome"] for r in got if r["record_id"] >= 4000} == {"missing"}


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s] + 1e-9]:
        free -= set(over)
        target |= {s: 3.0 * sizes[s] for s in over}
        left = float(sum(sizes.values())) - sum(target.values())
    return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


@pytest.mark.parametrize("block", [8, 4096])
def test_mix_meets_targets(spark, block):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.choice([1, 5, 30, 200])), "en", rng.choice(["b", "a", "é", "Z", None, "a", "a", "a"]), None) for i in range(300)]
    rows += [(900, "tiny", "en", "tiny", None), (901, None, "en", "none", None), (None, "a b c", "en", "a", None), (5, "x y", "en", "a", None)]
    got = mixing.mix(documents(spark, rows, clashing=True), block=block).collect()
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    target = brute_targets(size)
    by_total = {}
    assert len(got) == len(rows)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by_total.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert set(by_total) == {(size[s], round(target[s], 6)) for s in size}
    for s in ("a", "b", "Z", "é"):
        # With tiny blocks few documents are left to balance the last ones.
        assert abs(sum(by_total[size[s], round(target[s], 6)]) - target[s]) <= (0.02 * target[s] + 2 if block > 8 else 200)
    again = mixing.mix(documents(spark, rows).repartition(7), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rows_that_are_alike_are_dealt_to_many_blocks(spark):
    """A third of the rows alike, without ids: no block has more than about its share, and reruns agree."""
    rows = [(None, "same words here", "en", "a", None)] * 4000 + [(i, f"word {i} of it", "en", "a", None) for i in range(8000)]
    sizes = documents(spark, rows).select("doc_id", "source", F.lit(3).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("deal"))
    dealt = mixing._dealt(sizes, chunk=100)
    blocks = dealt.groupBy(F.expr("pmod(deal, 24)").alias("block")).count().collect()
    assert sum(r["count"] for r in blocks) == 12000 and max(r["count"] for r in blocks) < 700
    again = mixing._dealt(sizes.repartition(9), chunk=100)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, again.collect()))
    got = mixing.mix(documents(spark, rows), block=512)
    taken = got.agg(F.sum("taken"), F.max("target"), F.count("*")).first()
    assert taken[2] == 12000 and abs(taken[0] - taken[1]) <= 0.02 * taken[1]


def test_flight_keeps_totals():
    rng = np.random.default_rng(5)
    p, sizes = rng.random(500), rng.integers(1, 3000, 500).astype(float)
    out = mixing.flight(p, sizes, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ sizes - p @ sizes) < 1e-3


def test_flight_keeps_inclusion_probabilities():
    p, sizes = np.array([0.2, 0.5, 0.3, 0.7, 0.6, 0.7]), np.array([1.0, 2, 3, 4, 5, 6])
    mean = np.mean([mixing.flight(p, sizes, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_mix_of_awkward_rows(spark):
    assert len(mixing.mix(documents(spark)).collect()) == len(awkward())
    assert mixing.mix(documents(spark, [])).count() == 0
