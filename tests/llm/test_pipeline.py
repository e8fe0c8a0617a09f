"""The pipeline's stages, each held against brute force on what the one before kept, and the entry guard."""

from __future__ import annotations

import pathlib
import random
import shutil
import subprocess
import sys

import corpus_pipeline
from samples import documents, sentence
from test_dedup import ITEMS, brute_components, brute_contained, brute_exact, brute_simhash
from test_text_ops import brute_targets

LETTERS = {"aa": "abcdefgh", "bb": "hijklmno"}


def corpus():
    rng = random.Random(1)
    texts = [(sentence(rng, 150, LETTERS[lang]), lang) for lang in ("aa", "bb") for _ in range(20)]
    items = [(1, sentence(rng, 25, LETTERS["aa"])), (2, sentence(rng, 40, LETTERS["bb"]))]
    texts += texts[:5] + texts[:2]
    texts += [(t.replace(t.split()[50], "changed", 1), lang) for t, lang in texts[5:10]]
    texts += [(f"{sentence(rng, 60, LETTERS['aa'])} {items[0][1].upper()} {sentence(rng, 60, LETTERS['aa'])}", "aa"), ("123 456", None), (None, "aa"), ("", "aa")]
    return [(i, t, lang, f"s{i % 3}", None) for i, (t, lang) in enumerate(texts)], items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    seen = [{r[0]: r[1] for r in rows}]
    docs = documents(spark, rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"test-{k}")
        assert docs.columns == columns + ["copies"] * (k == 4)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    before, language, exact, near, clean, mixed = seen
    pairs = lambda kept: [(i, t) for i, t in kept.items()]
    assert set(language) == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
    assert set(exact) == {i for i, keep, *_ in brute_exact(pairs(language)) if i == keep}
    groups = brute_components([(i, brute_simhash(t)) for i, t in exact.items()])
    assert set(near) == {i for i, group in groups.items() if i == group} and len(near) < len(exact)
    held = {i for i, _ in brute_contained(pairs(near), items)}
    assert set(clean) == set(near) - held and held
    assert set(mixed) <= set(clean) and all(mixed[i] == clean[i] for i in mixed)
    size = {}
    for i, t in clean.items():
        size[f"s{i % 3}"] = size.get(f"s{i % 3}", 0) + len(t.split())
    target = brute_targets(size)
    taken = {}
    for r in docs.collect():
        assert 1 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * len(r["text"].split())
    assert all(abs(taken.get(s, 0) - target[s]) < 200 for s in target)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_awkward_rows(spark, tmp_path):
    spark.createDataFrame([], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (None, []):
        docs = documents(spark, rows).withColumnRenamed("n_chars", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test-awkward")
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= {4, 5, 6, 7, 8, 9, 10, None, 11}


def test_stages_decide_by_row(spark, tmp_path):
    """Missing and repeated ids: copies and leaks go, and only they."""
    rng = random.Random(7)
    t = [sentence(rng, 150) for _ in range(8)]
    item = sentence(rng, 25)
    spark.createDataFrame([(1, item)], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    near = t[3].replace(t[3].split()[50], "changed", 1)
    leak = f"{t[6]} {item} {t[7]}"

    def after(stage, rows):
        out = stage(spark, documents(spark, [(i, x, "aa", "s", None) for i, x in rows]), str(tmp_path)).collect()
        return sorted(((r["doc_id"], r["text"]) for r in out), key=str)

    exact = [(None, t[0]), (None, t[0]), (1, t[0]), (None, t[1]), (None, t[1]), (5, t[2]), (5, t[2]), (5, t[4]), (None, None), (None, "")]
    got = after(corpus_pipeline.exact_dedup, exact)
    assert sorted((str(i), x or "") for i, x in got) == sorted((str(i), x) for i, x in [(1, t[0]), (None, t[1]), (5, t[2]), (5, t[4]), (None, "")])
    rows = [(None, t[3]), (4, near), (4, t[4]), (9, t[5]), (9, t[5]), (None, t[2])]
    assert after(corpus_pipeline.near_dedup, rows) == sorted([(4, near), (4, t[4]), (9, t[5]), (None, t[2])], key=str)
    rows = [(None, leak), (4, leak), (4, t[4]), (None, t[2]), (None, t[2])]
    assert after(corpus_pipeline.decontaminate, rows) == sorted([(4, t[4]), (None, t[2]), (None, t[2])], key=str)
    rows = [(None, sentence(rng, rng.randint(5, 30)), "aa", f"s{k % 3}", None) for k in range(300)]
    out = corpus_pipeline.mixture(spark, documents(spark, rows), str(tmp_path)).collect()
    size, taken = {}, {}
    for _, x, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(x.split())
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * len(r["text"].split())
    assert all(abs(taken[s] - x) < 50 for s, x in brute_targets(size).items())


def test_the_rest_works_without_this_part(tmp_path):
    root = pathlib.Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "contagrid", tmp_path / "contagrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') and q[2].isdigit()])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.strip().endswith("[]"), out.stderr
