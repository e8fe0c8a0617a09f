"""License scan: ordered signature rules behind a keyword filter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contagrid.llm.license_rules import Rule, rules

#: Bytes of words stay, A-Z become a-z, all others become blanks.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
DETECTION = "array<struct<label:string,form:string,first:bigint,last:bigint,confidence:double,base:boolean,kept:boolean>>"
_ARROW = pa.list_(
    pa.struct([("label", pa.string()), ("form", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
               ("confidence", pa.float64()), ("base", pa.bool_()), ("kept", pa.bool_())])
)


def as_words(text: str | None) -> bytes:
    """The text's words with a blank before, between and behind them; no list of words is made."""
    data = b" " + (text or "").encode("utf-8", "replace").translate(WORD_BYTES) + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


class Scanner:
    def __init__(self, signatures: list[Rule] | None = None):
        self.by_keyword: dict[bytes, list] = {}
        for place, rule in enumerate(signatures if signatures is not None else rules()):
            pattern = re.compile(rb"(?<= )(?:" + rule.pattern.encode() + rb")(?= )")
            self.by_keyword.setdefault(rule.keyword.encode(), []).append((place, rule, pattern))

    def scan(self, data: bytes) -> list[dict]:
        """Detections in order of their words; ``kept`` is false for those inside a kept one of a stronger or equal form."""
        found = []
        for keyword, signatures in self.by_keyword.items():
            if keyword in data:
                for place, rule, pattern in signatures:
                    found += [(m.start(), m.end(), place, rule) for m in pattern.finditer(data)]
        if not found:
            return []
        found.sort(key=lambda d: (d[0], d[1], d[2]))
        at, word, spots = 0, -1, []
        for start, end, place, rule in found:
            word, at = word + data.count(b" ", at, start), start
            spots.append((word, word + data.count(b" ", start, end), place, rule))
        kept = self._kept(spots)
        return [
            {"label": r.label, "form": r.form, "first": a, "last": b, "confidence": r.confidence, "base": r.form == "base", "kept": k}
            for (a, b, _, r), k in zip(spots, kept)
        ]

    @staticmethod
    def _kept(spots: list[tuple]) -> list[bool]:
        """Stronger forms first, then longer ones: each is kept unless it lies within a kept one.

        Of two kept intervals neither lies within the other, so sorted by start they are sorted by end, and only the
        last one that starts no later can contain another.
        """
        from bisect import bisect_right

        order = sorted(range(len(spots)), key=lambda i: (spots[i][3].priority // 1000, spots[i][0] - spots[i][1], spots[i][2], spots[i][0]))
        kept, starts, ends = [False] * len(spots), [], []
        for i in order:
            a, b = spots[i][:2]
            at = bisect_right(starts, a)
            if at and ends[at - 1] >= b:
                continue
            kept[i] = True
            # One that this one contains was kept for its stronger form; it stays kept but needs no place here.
            while at and starts[at - 1] == a:
                at -= 1
            upto = at
            while upto < len(ends) and ends[upto] <= b:
                upto += 1
            starts[at:upto], ends[at:upto] = [a], [b]
        return kept


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, detections: one row for each row of ``docs`` (doc_id, text).

    Words are runs of letters and digits in lower case; ``first`` and ``last`` count
    words from 0. A null or empty text has no words and no detections. Rows that
    repeat a doc_id are scanned each; other columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            n, found = [], []
            for text in batch.column(1):
                data = as_words(text.as_py())
                n.append(data.count(b" ") - 1)
                found.append(scanner.scan(data))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(found, _ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "detections"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(of, f"doc_id long, n_words long, detections {DETECTION}")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases count at every place, also within a stronger detection, and keep
    their labels; the score is 1 less the product of the kept detections' doubts,
    each label's strongest counting once.
    """
    base = F.filter("detections", lambda d: d["base"])
    told = F.filter("detections", lambda d: d["base"] | d["kept"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["first"])
    labels = F.array_distinct(F.transform(told, lambda d: d["label"]))
    best = lambda label: F.array_max(F.transform(F.filter(told, lambda d: d["label"] == label), lambda d: d["confidence"]))
    doubt = F.aggregate(F.transform(labels, best), F.lit(1.0), lambda rest, c: rest * (1.0 - c))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(told).alias("labels"),
        F.round(1.0 - doubt, 6).alias("score"),
    )
