"""Small document tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns an operator might use inside itself, with other types.
CLASHING = {"h": "x", "row": "x", "words": 1, "n": "x", "key": 1.5, "block": "x", "p": "x", "chunks": 1, "score": "x", "kept": 1, "place": "x", "entities": 1, "word": 1, "held_out": "x", "fingerprint": 1}


def sentence(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward():
    rng = random.Random(1)
    long_text = sentence(rng, 20000)
    one_word = "x" * 300_000
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "  \t\n ", "en", "a"), (4, "short", "en", "b"), (5, "Équipe naïve 東京 🙂", "fr", "c"),
        (6, long_text, "en", "a"), (7, long_text, "en", "b"), (8, one_word, None, "a"), (9, "same text here and there again", "en", "a"),
        (9, "same text here and there again", "en", "a"), (10, "same text here and there again", "en", None), (None, "no id at all in this row", "en", "a"),
        (None, "no id at all in this row", "en", "a"), (11, "12345 67890 !!!", None, "b"),
    ]
    return [(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows]


def documents(spark, rows=None, clashing=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
    for name, value in CLASHING.items() if clashing else ():
        df = df.withColumn(name, F.lit(value))
    return df


def simple(spark, texts, **columns):
    """Documents 0, 1, 2 ... with these texts."""
    return documents(spark, [(i, t, columns.get("lang", "en"), columns.get("source", "s"), None) for i, t in enumerate(texts)])
