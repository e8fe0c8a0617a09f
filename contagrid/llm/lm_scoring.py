"""Language-model scores from a lattice of subwords, beside a word baseline.

The vocabulary is that of an existing public tokenizer; only the pieces'
probabilities are learned, from how it segments the training words. A text's
probability is marginal: the sum over all its segmentations into pieces. No piece
spans white space, so the lattice of a text falls apart at it, and the forward
recursion runs once for each distinct word of the corpus, however often it stands.

Words that make up at least 2**-HEAD of the corpus are at most 2**HEAD; they are
scored from a broadcast table of that bound. The others meet their counts in a
join on the word, in which no word can be hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contagrid.llm.common import part_of, written
from contagrid.llm.texts import slices, word_blocks

HEAD, LONGEST_HEAD_WORD = 20, 64
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Pieces(NamedTuple):
    """Natural logarithms: of each piece, of each byte where a character has no piece, and of a text's end."""

    logs: dict[str, float]
    bytes: list[float]
    end: float
    longest: int


def log_marginal(word: str, pieces: Pieces) -> float:
    """Natural logarithm of the summed probability of all segmentations of a word with its blank in front."""
    text, logs, longest = SPACE + word, pieces.logs, pieces.longest
    alpha = [0.0]
    for j in range(1, len(text) + 1):
        terms = []
        for i in range(max(0, j - longest), j):
            log = logs.get(text[i:j])
            if log is not None:
                terms.append(alpha[i] + log)
        if text[j - 1] not in logs:
            terms.append(alpha[j - 1] + sum(pieces.bytes[b] for b in text[j - 1].encode("utf-8", "replace")))
        if len(terms) == 1:
            alpha.append(terms[0])
        else:
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return alpha[-1]


def word_counts(docs: DataFrame, train: str) -> DataFrame:
    """word (bytes), c: how often each word of ``docs`` (text, and the boolean column ``train``) stands in training texts, 0 if in others only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            counts, others = Counter(), set()
            for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                for words in word_blocks(text.as_py()):
                    if learn:
                        counts.update(words)
                    else:
                        others.update(words)
            others -= counts.keys()
            words, n = [*counts, *others], [*counts.values(), *[0] * len(others)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "c"])

    slim = docs.select(F.col("text").cast("string").alias("text"), train)
    return slim.mapInArrow(of, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn_pieces(words: DataFrame, texts: int, model_file: str = MODEL_FILE) -> Pieces:
    """Smoothed piece probabilities from the tokenizer's segmentation of the counted words (word, c), and of ``texts`` ends."""
    import sentencepiece

    with open(model_file, "rb") as file:
        proto = file.read()
    shared = words.sparkSession.sparkContext.broadcast(proto)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        total = np.zeros(model.get_piece_size())
        for batch in batches:
            found = model.encode([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            if sizes.sum():
                ids = np.concatenate([np.array(x, np.int64) for x in found if x])
                total += np.bincount(ids, np.repeat(batch.column(1).to_numpy().astype(float), sizes), len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["piece", "n"])

    counted = words.where("c > 0").mapInArrow(of, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    size = model.get_piece_size()
    n = np.zeros(size)
    for row in counted.collect():  # at most the vocabulary
        n[row["piece"]] = row["n"]
    usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    whole = math.log(n[usable].sum() + texts + len(usable) + 1)
    log = {i: math.log(n[i] + 1) - whole for i in usable}
    of_byte = {int(model.id_to_piece(i)[1:-1], 16): log[i] for i in usable if model.is_byte(i)}
    logs = {model.id_to_piece(i): log[i] for i in usable if not model.is_byte(i)}
    return Pieces(logs, [of_byte[b] for b in range(256)], math.log(texts + 1) - whole, max(map(len, logs)))


def lexicon(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, c, log_p: with the base-10 logarithm of each word's marginal probability."""
    shared = words.sparkSession.sparkContext.broadcast(tuple(pieces))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*shared.value)
        for batch in batches:
            logs = [log_marginal(w.decode("utf-8", "replace"), pieces) / math.log(10) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "c", "log_p"])

    return words.select("word", "c").mapInArrow(of, "word binary, c long, log_p double")


def scores(docs: DataFrame, held_out: str, model_file: str = MODEL_FILE, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text, ``held_out``).

    Tokens are the lower-cased words between ASCII white space and one end for each
    text, a null text has only that. n_known counts the tokens that training texts
    have; base_score adds log10((c+1)/(N+V+1)) over the tokens, and score is the
    lattice model's log10 probability. Rows that repeat a doc_id are texts of their
    own. Without training texts all counts are 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(held_out).alias("held_out"))
    words = written(word_counts(docs.withColumn("train", ~F.col("held_out")), "train"), "lm-words")
    n_words, distinct = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    texts = docs.where(~F.col("held_out")).count()
    train_tokens = (n_words or 0) + texts
    vocabulary = distinct + (texts > 0)
    pieces = learn_pieces(words, texts, model_file)
    known = written(lexicon(words, pieces), "lm-lexicon")

    common = (F.col("c") * 2.0**head >= train_tokens) & (F.col("c") > 0) & (F.length("word") <= LONGEST_HEAD_WORD)
    heads = known.where(common).toPandas()
    table = dict(zip(heads["word"].map(bytes), zip(np.log10(heads["c"] + 1.0), heads["log_p"])))
    shared = spark.sparkContext.broadcast(table)
    end = (math.log10(texts + 1), pieces.end / math.log(10), int(texts > 0))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches, 2000):
            rest_at, rest_words, rest_n, of_doc = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                n, found, base, score, rest = 1, end[2], end[0], end[1], Counter()
                for block in word_blocks(text.as_py()):
                    n += len(block)
                    for word, times in Counter(block).items():
                        if (logs := table.get(word)) is not None:
                            found += times
                            base += times * logs[0]
                            score += times * logs[1]
                        else:
                            rest[word] += times
                of_doc.append((n, found, base, score))
                rest_at += [row] * len(rest)
                rest_words += rest.keys()
                rest_n += rest.values()
            rows, size = batch.num_rows, len(rest_at)
            # A text's own row gets a word that no text has, so that these rows spread in the join.
            own = [b" %d" % row for row in batch.column(0).to_pylist()]
            columns = [
                pa.array(batch.column(0).to_pylist() + rest_at, pa.int64()),
                pa.array(own + rest_words, pa.binary()),
                pa.array([0] * rows + rest_n, pa.int64()),
                pa.array([True] * rows + [False] * size),
                pa.array(batch.column(1).to_pylist() + [None] * size, pa.int64()),
                pa.array(batch.column(3).to_pylist() + [None] * size, pa.bool_()),
                *(pa.array([x[k] for x in of_doc] + [0] * size, t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))),
            ]
            names = ["row", "word", "times", "own", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "row long, word binary, times long, own boolean, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    rows = numbered.mapInArrow(of, schema).join(known, "word", "left")
    other = ~F.col("own")
    parts = rows.select(
        "row", "doc_id", "held_out", "n_tokens",
        F.when(other & (F.col("c") > 0), F.col("times")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(other, F.col("times") * F.log10(F.col("c") + 1.0)).otherwise(F.col("base")).alias("base"),
        F.when(other, F.col("times") * F.col("log_p")).otherwise(F.col("score")).alias("score"),
    )
    # Rows of the rest have no id and no n_tokens of their own.
    sums = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")),
    )
    whole = math.log10(train_tokens + vocabulary + 1)
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )


def scored(docs: DataFrame) -> DataFrame:
    """``scores`` of all documents, learned from all but fold 2 of seven."""
    return scores(docs.withColumn("held_out", part_of("doc_id", 7) == 2), "held_out")
