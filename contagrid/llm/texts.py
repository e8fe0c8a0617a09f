"""Texts as bytes inside tasks: words in blocks, so that a very long text needs no more memory than a block."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SPACE = b" \t\n\r\x0b\x0c"
BLOCK = 1 << 20


def blocks(data: bytes, space: bytes = SPACE, size: int = BLOCK) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end between words; a longer word stays whole."""
    start = 0
    while len(data) - start > size:
        end = start + size
        while end < len(data) and data[end] not in space:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def word_blocks(text: str | None, size: int = BLOCK) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words between ASCII white space, a block at a time; no block for a text without words."""
    for block in blocks((text or "").encode("utf-8", "surrogatepass").lower(), SPACE, size):
        if words := block.split():
            yield words


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, for work that makes many Python objects of each."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
