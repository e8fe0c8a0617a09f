"""Language identification of mixed texts.

Every language has a character trigram model. The words of a document are drawn
from an unknown mixture of languages; expectation-maximisation estimates its
proportions from the words' likelihoods, and the set of languages is the one with
the best likelihood after a penalty for each further language.

Trigrams are hashed into a table of fixed size, so the model a task receives has
``2 * buckets * languages`` numbers, however much text it was learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contagrid.llm.common import part_of, written

BUCKETS = 1 << 16
SAMPLE_DOCS = 2000  # labelled documents a language that the models are fitted on, about
PENALTY = 6.0  # nats for each further language, besides half the logarithm of the words
ALPHABET = 64
SEGMENT = 1 << 20
UNKNOWN = "und"


class Model(NamedTuple):
    """Logarithms of smoothed counts: a row for each bucket, a column for each language."""

    languages: list[str]
    grams: np.ndarray
    contexts: np.ndarray


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _buckets(codes: np.ndarray, letters: np.ndarray, buckets: int):
    """Of each character of a word and of each word's end: gram and context buckets; and where words start among them."""
    letter = letters[codes]
    code = np.where(letter, codes, 0).astype(np.uint64)
    last = np.concatenate(([0], code[:-1])).astype(np.uint64)
    before = np.concatenate(([0], last[:-1])).astype(np.uint64)
    before[last == 0] = 0
    inside = (code > 0) | (last > 0)
    code, last, before = code[inside], last[inside], before[inside]
    context = before * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xC2B2AE3D27D4EB4F)
    gram = context + (code + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
    mix = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % buckets
    return mix(gram), mix(context), np.flatnonzero(last == 0)


def _segments(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text with a blank behind, in pieces that end between words."""
    start = 0
    while True:
        end = start + SEGMENT
        while end < len(text) and text[end].isalpha():
            end += 1
        piece = text[start:end].lower() + " "
        yield np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        if end >= len(text):
            return
        start = end


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, buckets: int = BUCKETS, smoothing: float = 0.1) -> Model:
    """Models of the languages in ``docs`` (doc_id, text, lang); rows without text or lang are ignored.

    Fitted on about ``sample_docs`` whole documents a language, chosen by the hash
    of their id; languages with fewer use all of theirs.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    share = known.groupBy("lang").agg((F.lit(float(sample_docs)) / F.count("*")).alias("share"))
    share = written(share, "language-shares")
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(share, "lang").where(place < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, counts = letter_table(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                have = counts.setdefault(lang, np.zeros((2, buckets), np.int64))
                for codes in _segments(text.as_py()):
                    for row, found in zip(have, _buckets(codes, letters, buckets)):
                        row += np.bincount(found, minlength=buckets)
        for lang, have in counts.items():
            kind, bucket = np.nonzero(have)
            columns = [pa.array([lang] * len(kind)), pa.array(kind), pa.array(bucket), pa.array(have[kind, bucket])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "bucket", "n"])

    parts = sample.mapInArrow(count, "lang string, kind long, bucket long, n long")
    found = parts.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((2, buckets, len(languages)))
    column = found["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(np.int64)
    counts[found["kind"].to_numpy(np.int64), found["bucket"].to_numpy(np.int64), column] = found["n"].to_numpy(np.float64)
    logs = np.log(counts[0] + smoothing), np.log(counts[1] + smoothing * ALPHABET)
    return Model(languages, *(x.astype(np.float32) for x in logs))


def _word_scores(text: str, model: Model, letters: np.ndarray) -> np.ndarray:
    """A row for each word: its log-likelihood under each language."""
    out = []
    for codes in _segments(text):
        gram, context, starts = _buckets(codes, letters, len(model.grams))
        if len(starts):
            out.append(np.add.reduceat(model.grams[gram] - model.contexts[context], starts, axis=0))
    return np.concatenate(out) if out else np.zeros((0, len(model.languages)), np.float32)


def _mixture(scores: np.ndarray, starts: np.ndarray, start: np.ndarray, rounds: int = 30, close: float = 1e-3):
    """Proportions of each document by expectation-maximisation, and their log-likelihood.

    ``starts``: first word of each document; ``start``: a row of proportions each,
    zero for the languages left out. Documents leave when their proportions stay.
    """
    n = np.diff(np.append(starts, len(scores)))
    top = scores.max(axis=1, keepdims=True)
    like = np.exp(scores - top)
    shares, active = start.copy(), np.arange(len(starts))
    rows, first = like, starts
    for _ in range(rounds):
        size = n[active]
        weighed = rows * np.repeat(shares[active], size, axis=0)
        weighed /= np.maximum(weighed.sum(1, keepdims=True), 1e-300)
        new = np.add.reduceat(weighed, first, axis=0) / size[:, None]
        moved = np.abs(new - shares[active]).max(axis=1)
        shares[active] = new
        keep = moved > close
        if not keep.any():
            break
        if keep.mean() < 0.7:
            rows = rows[np.repeat(keep, size)]
            active = active[keep]
            first = np.append(0, np.cumsum(n[active])[:-1])
    total = np.log(np.maximum((like * np.repeat(shares, n, axis=0)).sum(1), 1e-300)) + top[:, 0]
    return shares, np.add.reduceat(total, starts)


def proportions(scores: np.ndarray, starts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Each document's language proportions (documents x languages), for the set of languages with the best penalised likelihood."""
    scores = scores.astype(np.float64)
    n = np.diff(np.append(starts, len(scores)))
    languages = scores.shape[1]
    single = np.add.reduceat(scores, starts, axis=0)
    best_value = single.max(axis=1)
    best = np.eye(languages)[single.argmax(axis=1)]
    cost = penalty + 0.5 * np.log(n)
    todo = np.arange(len(starts))
    allowed = np.ones((len(starts), languages))
    for size in range(languages, 1, -1):
        rows = np.repeat(np.isin(np.arange(len(starts)), todo), n)
        first = np.append(0, np.cumsum(n[todo])[:-1])
        begin = allowed[todo] / allowed[todo].sum(1, keepdims=True)
        shares, value = _mixture(scores[rows], first, begin)
        gain = value - (size - 1) * cost[todo] > best_value[todo]
        best[todo[gain]] = shares[gain]
        best_value[todo[gain]] = (value - (size - 1) * cost[todo])[gain]
        # A smaller set of these languages is no likelier, so with its own penalty it must still be able to win.
        open_ = (value - cost[todo] > best_value[todo]) & (size > 2)
        if not open_.any():
            break
        least = np.where(allowed[todo] > 0, shares, np.inf).argmin(axis=1)
        allowed[todo, least] = 0
        todo = todo[open_]
    return best


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """All columns of ``docs`` and lang_pred, lang_score, lang_shares, for each row.

    lang_pred is the language with the largest share, lang_score that share, and
    lang_shares the chosen languages with theirs (code to share). Text that is null
    or has no letter is ``und`` with score 0 and no shares; so is every text if the
    model knows no language. Columns of docs with the three names are replaced.
    """
    spark = docs.sparkSession
    added = ["lang_pred", "lang_score", "lang_shares"]
    docs = docs.drop(*added)
    shared = spark.sparkContext.broadcast(tuple(model))
    at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = Model(*shared.value), letter_table()
        for batch in batches:
            found: list[tuple] = [(UNKNOWN, 0.0, [])] * batch.num_rows
            held, who, size = [], [], 0

            def settle():
                starts = np.append(0, np.cumsum([len(x) for x in held])[:-1])
                for i, share in zip(who, proportions(np.concatenate(held), starts, penalty)):
                    kept = [(model.languages[k], float(share[k])) for k in np.argsort(-share, kind="stable") if share[k] > 0]
                    found[i] = (*kept[0], kept)

            for i, text in enumerate(batch.column(at)):
                text = text.as_py() or ""
                scores = _word_scores(text, model, letters) if model.languages else ()
                if len(scores):
                    held.append(scores)
                    who.append(i)
                    size += len(scores)
                if held and size > 200_000:
                    settle()
                    held, who, size = [], [], 0
            if held:
                settle()
            columns = [
                pa.array([x[0] for x in found], pa.string()),
                pa.array([min(1.0, x[1]) for x in found], pa.float64()),
                pa.array([x[2] for x in found], pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(of, f"{schema}, lang_pred string, lang_score double, lang_shares map<string,double>")


FOLDS = 5


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents of all folds but fold 0 of five."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = learn(docs.where(part_of("doc_id", FOLDS) != 0))
    return identify(slim, model).select(
        "doc_id", (part_of("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
