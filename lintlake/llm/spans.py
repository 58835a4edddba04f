"""Words of Arrow text columns as byte spans, and table-driven hashes of spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 22  # bytes of words hashed at once


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows in them; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends.astype(np.int64) - int(ends[0])


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``SLICE`` bytes in a text column; a longer row is alone."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def word_spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends`` of the runs of bytes that ``inside`` marks, and each row's first word.

    ``inside`` has a boolean for each byte value.  No run crosses rows; the last array has one
    more entry than there are rows.
    """
    mask = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & ~(before & ~edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & ~(after & ~edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blocks(lengths: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of spans with about ``most`` bytes each; a longer span is alone."""
    total = np.cumsum(lengths)
    first, done = 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(total, done + most, side="right")))
        yield first, last
        first, done = last, int(total[last - 1])


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one span after the other."""
    skipped = np.cumsum(lengths) - lengths
    return np.repeat(starts - skipped, lengths) + np.arange(int(lengths.sum()))
