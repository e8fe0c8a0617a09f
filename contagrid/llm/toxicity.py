"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of its own and its character n-grams' vectors, so a
misspelling never seen shares most of it. Runs without a blank that are longer than words
are, as in Chinese, Japanese or Thai, are read in overlapping pieces. A document is read in segments of a few
dozen words, as a handful of toxic words would vanish in the mean of a long text; a
segment is the mean of its different words, missing ones as zeros, and the document has its most toxic segment's
score. Segments start at every word, so no passage is split by a border. Embeddings and softmax are trained together on a bounded sample of labelled
documents. As all is linear up to the softmax, a task needs one number for each
n-gram bucket: how far its vector moves the odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contagrid.llm.common import part_of, written
from contagrid.llm.licenses import as_words

BUCKETS, WIDTH, SEGMENT = 1 << 16, 4, 24
SHORTEST, LONGEST = 3, 5
LONG_WORD, PIECE = 64, 24  # bytes: a run longer than the first is read in overlapping pieces of the second
SAMPLE_DOCS = 1500  # labelled documents of each class that the model is fitted on, about
SAMPLE_BYTES = 1 << 17  # longest text that the model is fitted on: the sample has 400 MB at most
ROUNDS, LAST_ROUNDS = 60, 15
RARE = 5.0  # a bucket in fewer segments than this, its words' other n-grams counted, is not trained


class Model(NamedTuple):
    """Change of the log odds by each bucket's vector, and the log odds of no words."""

    odds: Sequence[float]
    bias: float


def word_buckets(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Of the word and its n-grams of 3 to 5 bytes, ends marked."""
    marked = b"<" + word + b">"
    n = len(marked)
    ids = [zlib.crc32(word) % buckets]
    for k in range(SHORTEST, LONGEST + 1):
        ids += [zlib.crc32(marked[i : i + k]) % buckets for i in range(n - k + 1)]
    return ids


def pieces(word: bytes) -> list[bytes]:
    """A long run, as of a script without blanks, in pieces that end between characters.

    Two neighbours share more bytes than the longest n-gram has, so that each n-gram is in a piece.
    """

    def border(i: int) -> int:
        while i < len(word) and word[i] & 0xC0 == 0x80:
            i -= 1
        return i

    out, start = [], 0
    while True:
        end = border(min(start + PIECE, len(word)))
        out.append(word[start:end])
        if end == len(word):
            return out
        start = border(start + PIECE // 2)


def bag_words(text: str | None) -> list[bytes]:
    """The text's words; each piece of a long run counts as one."""
    words = as_words(text).split()
    if max(map(len, words), default=0) <= LONG_WORD:
        return words
    return [part for word in words for part in (pieces(word) if len(word) > LONG_WORD else (word,))]


class _Bag:
    """Segments as bags of words and words as bags of n-gram buckets, with sums both ways."""

    def __init__(self, grams: list[list[int]], segments: list[list[int]], overlap: int = 1):
        """``overlap`` is in how many segments a word of a text stands."""
        lengths = np.array([len(s) for s in segments])
        self.words = np.concatenate([np.array(s) for s in segments])
        self.starts = np.append(0, np.cumsum(lengths)[:-1])
        self.counts = np.array([len(g) for g in grams])
        self.flat = np.concatenate([np.array(g) for g in grams])
        self.first = np.append(0, np.cumsum(self.counts)[:-1])
        order = np.argsort(self.flat, kind="stable")
        self.gram_word = np.repeat(np.arange(len(grams)), self.counts)[order]
        self.used, self.bucket_first = np.unique(self.flat[order], return_index=True)
        order = np.argsort(self.words, kind="stable")
        self.word_segment = np.repeat(np.arange(len(segments)), lengths)[order]
        self.seen, self.word_first = np.unique(self.words[order], return_index=True)
        # Of each bucket, about the share of segments that have it.
        times = np.zeros(len(grams))
        times[self.seen] = np.diff(np.append(self.word_first, len(self.words)))
        often = np.add.reduceat((times / self.counts)[self.gram_word], self.bucket_first)
        self.ease = (1.0 / np.sqrt(np.maximum(often, 1.0) / len(segments)) * (often >= RARE * overlap))[:, None].astype(np.float32)

    def by_word(self, vectors: np.ndarray) -> np.ndarray:
        return np.add.reduceat(vectors[self.flat], self.first, axis=0) / self.counts[:, None].astype(np.float32)

    def hidden(self, vectors: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.by_word(vectors)[self.words], self.starts, axis=0) / np.float32(SEGMENT)

    def back(self, to_hidden: np.ndarray) -> np.ndarray:
        """Gradient of the used buckets' vectors."""
        to_word = np.zeros((len(self.counts), to_hidden.shape[1]), np.float32)
        shared = (to_hidden / SEGMENT).astype(np.float32)
        to_word[self.seen] = np.add.reduceat(shared[self.word_segment], self.word_first, axis=0)
        to_word /= self.counts[:, None].astype(np.float32)
        return np.add.reduceat(to_word[self.gram_word], self.bucket_first, axis=0)


def _descend(bag: _Bag, state: list[np.ndarray], toxic: np.ndarray, weights: np.ndarray, rounds: int) -> None:
    """Joint gradient descent with momentum on vectors, softmax and bias; the step shrinks whenever the loss rises."""
    target = np.eye(2)[toxic]
    weights = (weights / weights.sum())[:, None]
    rate, best, kept = 1000.0, np.inf, [x.copy() for x in state]
    speed = [np.zeros_like(x) for x in state]
    for _ in range(rounds):
        vectors, outward, bias = state
        hidden = bag.hidden(vectors)
        logits = hidden @ outward + bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = -(weights * target * np.log(np.maximum(p, 1e-12))).sum()
        if not loss <= best * 1.0001:
            rate /= 2
            for x, k, v in zip(state, kept, speed):
                x[...] = k
                v[...] = 0
            continue
        best, kept, rate = loss, [x.copy() for x in state], rate * 1.1
        wrong = (p - target) * weights
        to_vector = np.zeros_like(vectors)
        to_vector[bag.used] = bag.back(wrong @ outward.T) * bag.ease
        for x, v, g, r in zip(state, speed, (to_vector, hidden.T @ wrong, wrong.sum(0)), (rate, 1.0, 1.0)):
            v *= 0.9
            v -= (r * g).astype(v.dtype)
            x += v
    for x, k in zip(state, kept):
        x[...] = k


def _most(words: Sequence, values: Sequence[float]) -> tuple[float, int]:
    """Largest sum of the different words of any ``SEGMENT`` words in a row, and the place of the first; fewer words are one segment."""
    last: dict = {}
    total, top, at = 0.0, -np.inf, 0
    for i, word in enumerate(words):
        gone = i - SEGMENT
        if gone >= 0 and last[words[gone]] == gone:
            total -= values[gone]
        if last.get(word, -SEGMENT) <= gone:
            total += values[i]
        last[word] = i
        if total > top and gone >= -1:
            top, at = total, gone + 1
    # Summed anew, without what rounding has left in the running sum.
    return sum(dict(zip(words[at : at + SEGMENT], values[at : at + SEGMENT])).values()), at


def fit(texts: list[str | None], toxic: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Trained on segments that overlap by half, then on each text's most toxic of all segments, which is the one that scores it.

    ``toxic`` has 0 or 1 and ``weights`` how many documents a text stands for.
    """
    vocabulary: dict[bytes, int] = {}
    segments, owner, read, step = [], [], [], SEGMENT // 2
    for i, text in enumerate(texts):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in bag_words(text)]
        if ids:
            read.append((i, ids))
        for start in range(0, max(len(ids) - step, min(len(ids), 1)), step):
            segments.append(list(dict.fromkeys(ids[start : start + SEGMENT])))
            owner.append(i)
    if not segments:
        share = float(np.average(toxic, weights=weights)) if len(toxic) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    owner, grams = np.array(owner), [word_buckets(w) for w in vocabulary]
    rng = np.random.default_rng(7)
    state = [np.zeros((BUCKETS, WIDTH), np.float32), rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 2)), np.zeros(2)]
    bag = _Bag(grams, segments, SEGMENT // step)
    _descend(bag, state, toxic[owner].astype(int), weights[owner], rounds)
    values = (bag.by_word(state[0]) @ (state[1][:, 1] - state[1][:, 0])).tolist()
    top = []
    for _, ids in read:
        at = _most(ids, [values[w] for w in ids])[1]
        top.append(list(dict.fromkeys(ids[at : at + SEGMENT])))
    there = sorted({w for segment in top for w in segment})
    place = {w: k for k, w in enumerate(there)}
    final, who = _Bag([grams[w] for w in there], [[place[w] for w in segment] for segment in top]), np.array([i for i, _ in read])
    _descend(final, state, toxic[who].astype(int), weights[who], LAST_ROUNDS)
    turn = state[1][:, 1] - state[1][:, 0]
    return Model((state[0] @ turn).astype(np.float32), float(state[2][1] - state[2][0]))


def log_odds(text: str | None, model: Model, known: dict[bytes, float]) -> float:
    """Of the most toxic segment; ``known`` keeps words' values between texts."""
    odds, words = model.odds, bag_words(text)
    for word in words:
        if word not in known:
            ids = word_buckets(word, len(odds))
            known[word] = sum([odds[i] for i in ids]) / len(ids)
    return _most(words, [known[w] for w in words])[0] / SEGMENT + model.bias


def sampled(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES
) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Texts, labels and weights of about ``sample_docs`` labelled documents of each class, chosen by the hash of their id.

    Of rows that repeat an id one is taken, by the hash of its text; texts of more than ``sample_bytes`` are not fitted on.

    A weight is how many labelled documents one of the sample stands for. A
    document with several labels is toxic if one says so; missing labels don't count.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, sample_docs / max(1, n.get(1, 0))).otherwise(sample_docs / max(1, n.get(0, 0)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    chosen = written(known.where(place < share), "toxicity-sample")
    short = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= sample_bytes)
    one = F.min(F.struct(F.xxhash64("text").alias("place"), "text")).alias("one")
    rows = short.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(one).select("doc_id", "one.text", "toxic").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    toxic = (rows["toxic"] == 1).to_numpy(int)
    stands = {c: n.get(c, 0) / max(1, (toxic == c).sum()) for c in (0, 1)}
    return rows["text"].tolist(), toxic, np.array([stands[c] for c in toxic])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted: one row for each row of ``docs`` (doc_id, text).

    The score is the probability of the toxic class, predicted 1 from 0.5 on. Null
    texts and texts without words have the score of no words. Rows that repeat a
    doc_id are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, bias = shared.value
        model, known = Model(odds.tolist(), bias), {}
        for batch in batches:
            odds = []
            for text in batch.column(1):
                if len(known) > 500_000:
                    known.clear()
                odds.append(log_odds(text.as_py(), model, known))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(odds), -60, 60)))
            columns = [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(of, "doc_id long, score double, predicted int")


FOLDS = 5


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned from all folds but fold 0 of five."""
    model = fit(*sampled(docs, labels.where(part_of("doc_id", FOLDS) != 0)))
    return toxicity(docs, model).select("doc_id", (part_of("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
