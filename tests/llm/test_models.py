"""Language identification, toxicity and language-model scores: held-out quality and brute force."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np

from contagrid.llm import language_id, lm_scoring, toxicity
from contagrid.llm.queries import QUERIES
from samples import awkward, documents, sentence

SF = "/root/testdata/sf0.001"
LETTERS = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "opqrstuv"}


def labelled(n=90, seed=1, first=0):
    rng = random.Random(seed)
    return [(first + i, sentence(rng, 30, LETTERS[lang]), lang, "s", None) for i, lang in zip(range(n), itertools.cycle(LETTERS))]


def test_languages_and_mixtures(spark):
    rng = random.Random(2)
    model = language_id.learn(documents(spark, labelled()))
    assert model.languages == ["aa", "bb", "cc"]
    rows = labelled(30, seed=3, first=1000)
    mixed = [(2000 + i, sentence(rng, 60, LETTERS["aa"]) + " " + sentence(rng, 40, LETTERS["cc"]), None, "s", None) for i in range(6)]
    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, rows + mixed, clashing=True), model).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["lang_shares"] == {lang: 1.0} for i, _, lang, *_ in rows)
    for i, *_ in mixed:
        r = got[i]
        assert r["lang_pred"] == "aa" and set(r["lang_shares"]) == {"aa", "cc"} and abs(r["lang_score"] - 0.6) < 0.05


def test_proportions_are_a_maximum():
    """The chosen mixture is as likely as the best point of a grid."""
    rng = np.random.default_rng(4)
    scores = rng.normal(-20, 3, (50, 2))
    shares = language_id.proportions(scores, np.array([0]), penalty=0.0)[0]
    value = lambda a: np.log(np.exp(scores) @ np.array([a, 1 - a])).sum()
    best = max(value(a) for a in np.linspace(0, 1, 501))
    assert value(shares[0]) > best - 0.6 * math.log(50)


def test_language_of_awkward_rows(spark):
    model = language_id.learn(documents(spark, labelled()))
    got = language_id.identify(documents(spark, clashing=True), model).collect()
    assert len(got) == len(awkward())
    for r in got:
        letterless = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == letterless and 0 <= r["lang_score"] <= 1
    none = language_id.learn(documents(spark, []))
    assert {r["lang_pred"] for r in language_id.identify(documents(spark), none).collect()} == {"und"}
    assert language_id.identify(documents(spark, []), model).count() == 0


def test_predictions_ignore_lang_source_and_id(spark):
    model = language_id.learn(documents(spark, labelled()))
    text = labelled(1, seed=9)[0][1]
    rows = [(1, text, "bb", "x", None), (77, text, None, None, None)]
    got = language_id.identify(documents(spark, rows), model).collect()
    assert len({(r["lang_pred"], r["lang_score"]) for r in got}) == 1


def test_language_query_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op10_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)


INSULTS = ["scoundrel", "blockhead", "numbskull"]


def toxic_rows(n, seed, words):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = sentence(rng, rng.randint(20, 120)).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((" ".join(text), int(bad)))
    return out


def test_toxicity_of_unseen_misspellings():
    seen = toxic_rows(1500, 1, INSULTS)
    model = toxicity.fit([t for t, _ in seen], np.array([y for _, y in seen]), np.ones(len(seen)))
    for words, least in ((INSULTS, 0.95), (["scoundrell", "blokhead", "numbskul"], 0.7)):
        other = toxic_rows(200, 2, words)
        p = np.array([toxicity.log_odds(t, model, {}) > 0 for t, _ in other])
        y = np.array([y for _, y in other])
        assert p[y == 1].mean() >= least and p[y == 0].mean() < 0.05
    assert toxicity.log_odds("", model, {}) == toxicity.log_odds(None, model, {}) == model.bias


def test_toxicity_reads_every_segment():
    """A passage counts whole wherever it stands, also across any fixed border."""
    rng = random.Random(4)
    model = toxicity.Model(np.random.default_rng(4).normal(0, 1, toxicity.BUCKETS).tolist(), 0.25)
    for n in (0, 1, 23, 24, 25, 40, 100):
        words = [w.encode() for w in sentence(rng, n, "abc").split()]
        value = {w: np.mean([model.odds[i] for i in toxicity.word_buckets(w)]) for w in words}
        best = max(sum(value[w] for w in set(words[a : a + 24])) for a in range(max(1, n - 23)))
        assert abs(toxicity.log_odds(b" ".join(words).decode(), model, {}) - best / 24 - 0.25) < 1e-9
    seen = toxic_rows(1500, 1, INSULTS)
    model = toxicity.fit([t for t, _ in seen], np.array([y for _, y in seen]), np.ones(len(seen)))
    text = ["the"] * 20 + INSULTS + ["the"] * 40
    odds = [toxicity.log_odds(" ".join(["the"] * k + text), model, {}) for k in range(24)]
    assert max(odds) - min(odds) < 1e-9


def test_toxicity_reads_long_runs_to_their_end():
    """Text without blanks is one run of letters; what stands far behind in it counts."""
    rng = random.Random(6)
    for n in (65, 66, 90, 150, 1000):
        word = "".join(rng.choice("abcé東京🙂") for _ in range(n)).encode()
        parts = toxicity.bag_words(word.decode())
        assert len(parts) > 1 and all(p.decode() and len(p) <= toxicity.PIECE for p in parts)
        assert all(any(word[i : i + 5] in p for p in parts) for i in range(len(word) - 4))
    assert toxicity.bag_words("x" * 64 + " yz") == [b"x" * 64, b"yz"]

    def rows(seed, n):
        rng = random.Random(seed)
        plain = lambda n: "".join(rng.choice("的一是了我不人在他有這個上們來到時大地為子中你說生國年著就那和") for _ in range(n))
        return [(plain(40) + rng.choice(["混蛋傻瓜", "白痴廢物"]) * (i % 4 == 0) + plain(20), int(i % 4 == 0)) for i in range(n)]

    seen, other = rows(1, 1500), rows(2, 400)
    model = toxicity.fit([t for t, _ in seen], np.array([y for _, y in seen]), np.ones(len(seen)))
    p, y = np.array([toxicity.log_odds(t, model, {}) > 0 for t, _ in other]), np.array([y for _, y in other])
    assert p[y == 1].mean() >= 0.9 and p[y == 0].mean() < 0.05


def test_toxicity_of_awkward_rows(spark):
    seen = toxic_rows(100, 3, INSULTS)
    rows = [(1000 + i, t, "en", "s", None) for i, (t, _) in enumerate(seen)]
    labels = spark.createDataFrame(
        [(1000 + i, 1, y) for i, (_, y) in enumerate(seen)] + [(1000, 0, 1), (1001, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    got = toxicity.scored(documents(spark, rows + awkward(), clashing=True), labels).collect()
    assert len(got) == len(rows) + len(awkward())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len(toxicity.scored(documents(spark), labels.limit(0)).collect()) == len(awkward())


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    """An id that repeats in a third of the rows gives one text, and very long texts none."""
    rows = [(1, f"text {i % 7}", "en", "s", None) for i in range(3000)] + [(i, f"words of {i}", "en", "s", None) for i in range(2, 300)] + [(300, "x " * 2000, "en", "s", None), (301, None, "en", "s", None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 302)], "doc_id long, toxic int")
    texts, toxic, weights = toxicity.sampled(documents(spark, rows), labels, sample_bytes=1000)
    assert len(texts) == len(toxic) == 300 and sum(t is None for t in texts) == 1
    assert sum((t or "").startswith("text ") for t in texts) == 1 and max(len(t or "") for t in texts) < 1000
    again, *_ = toxicity.sampled(documents(spark, rows).repartition(5), labels, sample_bytes=1000)
    assert again == texts


def test_folds_of_labels_are_kept_out(spark):
    """Changing the labels of fold 0 changes no score."""
    seen = toxic_rows(100, 5, INSULTS)
    docs = documents(spark, [(i, t, "en", "s", None) for i, (t, _) in enumerate(seen)])
    schema = "doc_id long, quality int, toxic int"
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    told = [(i, 1, y) for i, (_, y) in enumerate(seen)]
    turned = [(i, 1, y if fold(i) else 1 - y) for i, _, y in told]
    scores = [{r["doc_id"]: r["score"] for r in toxicity.scored(docs, spark.createDataFrame(x, schema)).collect()} for x in (told, turned)]
    assert scores[0] == scores[1]


def all_segmentations(text, logs):
    if not text:
        return [0.0]
    return [logs[text[:k]] + rest for k in range(1, len(text) + 1) if text[:k] in logs for rest in all_segmentations(text[k:], logs)]


def test_lattice_sums_all_segmentations():
    rng = random.Random(6)
    logs = {lm_scoring.SPACE: -3.0} | {"".join(p): rng.uniform(-6, -1) for k in (1, 2, 3) for p in itertools.product("ab", repeat=k)}
    logs |= {lm_scoring.SPACE + p: rng.uniform(-6, -1) for p in ("a", "ab", "bb")}
    pieces = lm_scoring.Pieces(logs, [-8.0] * 256, -4.0, max(map(len, logs)))
    for word in ("a", "abab", "bbbaab", ""):
        expected = math.log(sum(math.exp(x) for x in all_segmentations(lm_scoring.SPACE + word, logs)))
        assert abs(lm_scoring.log_marginal(word, pieces) - expected) < 1e-9
    # A character without a piece is spelled in bytes.
    assert abs(lm_scoring.log_marginal("é", pieces) - (logs[lm_scoring.SPACE] - 16)) < 1e-9
    assert lm_scoring.log_marginal("ab" * 5000, pieces) < -1000


def check_base(rows, got, held):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    counts = collections.Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 3))
        for i, t, *_ in rows
    )
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == expected


def test_scores_of_awkward_rows(spark):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    got = lm_scoring.scored(documents(spark, clashing=True)).collect()
    check_base(awkward(), got, held)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.scored(documents(spark, [])).count() == 0


def test_words_scored_by_table_or_join_give_the_same(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 40, "abc"), "en", "s", None) for i in range(40)]
    df = documents(spark, rows).selectExpr("doc_id", "text", "doc_id % 4 = 0 AS held")
    a, b = ({r["doc_id"]: (round(r["score"], 6), round(r["base_score"], 6), r["n_known"]) for r in lm_scoring.scores(df, "held", head=h).collect()} for h in (0, 30))
    assert a == b
    check_base(rows, lm_scoring.scores(df, "held").collect(), lambda i: i % 4 == 0)
