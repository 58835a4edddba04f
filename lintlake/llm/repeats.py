"""Removal of passages that stand in an earlier document, by level-wise doubling.

Windows that repeat at one length are the only ones that can repeat at twice that length, so
lengths double until the wanted one, and a window that occurs in one text only is dropped at
the first length where that shows.  At the shortest length not all windows are compared: of the
short windows inside each wanted window the one with the least hash is (equal ones: the
first).  Equal passages choose equal windows, so this loses no repeat and leaves one window in
about thirteen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.spans import blocks, flat, slices, utf8, word_spans
from lintlake.sources.storage import shared_folder, stored

WINDOW = 50
SHORTEST = 16  # lengths are halved from the wanted one while they stay above this
REACH = 64
PIECE = 1 << 18  # windows in a batch of rows

INSIDE = np.ones(256, dtype=bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Two tables of random numbers by distance from a word's end and byte, and odd multipliers.
TABLES = _mixed(np.arange(1, 2 * REACH * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TABLES = TABLES.reshape(2, REACH, 256)
MULTIPLIERS = [0xD1342543DE82EF95, 0xAF251AF3B0F025B5]


def lengths(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """The window lengths to compare, from the shortest on."""
    out = [window]
    while out[0] > 1 and (len(out) == 1 or (out[0] + 1) // 2 >= shortest):
        out.insert(0, (out[0] + 1) // 2)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64 bits of each word; words over ``REACH`` bytes are hashed one by one."""
    out = np.zeros(len(starts), dtype=np.uint64)
    size = ends - starts
    table = TABLES[which]
    for a, b in blocks(size):
        n = np.minimum(size[a:b], REACH)
        at = flat(ends[a:b] - n, n)
        far = np.repeat(ends[a:b], n) - 1 - at
        out[a:b] = np.bitwise_xor.reduceat(table[far, data[at]], np.cumsum(n) - n)
    for i in np.flatnonzero(size > REACH):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), which)
    return _mixed(out)


def window_hashes(words: np.ndarray, size: int, which: int) -> np.ndarray:
    """The hash of each ``size`` consecutive words, whatever rows they belong to."""
    many = len(words) - size + 1
    if many <= 0:
        return np.empty(0, dtype=np.uint64)
    odd = np.uint64(MULTIPLIERS[which])
    back = np.uint64(pow(MULTIPLIERS[which], -1, 1 << 64))
    powers = np.full(len(words), odd)
    powers[0] = 1
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * np.cumprod(powers), out=sums[1:])
    powers = np.full(many, back)
    powers[0] = 1
    return _mixed((sums[size:] - sums[:many]) * np.cumprod(powers))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each ``width`` consecutive ones is; of equal ones the first."""
    many = len(values) - width + 1
    place = np.arange(len(values), dtype=np.uint64)
    keys = (values & ~np.uint64(0xFFFFFFFF)) | place
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:many], ahead[width - 1 : width - 1 + many])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc_id, text`` and two hashes that stand for the text."""
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), value.alias("text"))
    return rows.withColumns(
        {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}
    ).select("doc_id", "t1", "t2", "text")


def chosen_windows(texts: DataFrame, window: int, size: int) -> DataFrame:
    """``h, doc_id, t1, t2, lo, many``: the chosen windows of ``size`` words and, for each, the
    range of windows of ``window`` words that chose it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            data, offsets = utf8(batch.column(3))
            starts, ends, first = word_spans(data, offsets, INSIDE)
            if len(starts) < window:
                continue
            short = window_hashes(word_hashes(data, starts, ends, 0), size, 0)
            low = least(short, window - size + 1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            at = np.flatnonzero(row[: len(low)] == row[window - 1 :])
            if not len(at):
                continue
            new = np.ones(len(at), dtype=bool)
            new[1:] = (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (np.diff(row[at]) > 0)
            begin = np.flatnonzero(new)
            rows, lo = row[at[begin]], at[begin]
            many = np.diff(begin, append=len(at))
            which = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(short[low[lo]].view(np.int64)),
                    *(batch.column(i).take(which) for i in range(3)),
                    pa.array((lo - first[rows]).astype(np.int32)),
                    pa.array(many.astype(np.int32)),
                ],
                ["h", "doc_id", "t1", "t2", "lo", "many"],
            )

    return texts.mapInArrow(run, "h bigint, doc_id bigint, t1 bigint, t2 bigint, lo int, many int")


def windows_at(texts: DataFrame, size: int) -> DataFrame:
    """``h1, h2, doc_id, t1, t2, pos``: the windows of ``size`` words at ``ranges[lo, many]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            data, offsets = utf8(batch.column(3))
            starts, ends, first = word_spans(data, offsets, INSIDE)
            hashes = [window_hashes(word_hashes(data, starts, ends, i), size, i) for i in (0, 1)]
            each = batch.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ranges = batch.column(4).flatten()
            many = ranges.field("many").to_numpy().astype(np.int64)
            lo = ranges.field("lo").to_numpy().astype(np.int64)
            row = np.repeat(np.repeat(np.arange(batch.num_rows), each), many)
            pos = flat(lo, many)
            for a in range(0, len(pos), PIECE):
                own, at = row[a : a + PIECE], pos[a : a + PIECE]
                which = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(h[first[own] + at].view(np.int64)) for h in hashes),
                        *(batch.column(i).take(which) for i in range(3)),
                        pa.array(at.astype(np.int32)),
                    ],
                    ["h1", "h2", "doc_id", "t1", "t2", "pos"],
                )

    rows = texts.select("doc_id", "t1", "t2", "text", "ranges")
    return rows.mapInArrow(
        run, "h1 bigint, h2 bigint, doc_id bigint, t1 bigint, t2 bigint, pos int"
    )


def _repeated(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The windows that occur in two texts or more, with the smallest document they occur in."""
    found = windows.groupBy(*keys).agg(
        F.min("doc_id").alias("first"), F.min("t1").alias("a"), F.max("t1").alias("b")
    )
    return windows.join(found.where("a <> b").select(*keys, "first"), keys)


def _per_text(ranges: DataFrame) -> DataFrame:
    """One row per text with the smallest document that has it and all its ranges."""
    return ranges.groupBy("t1", "t2").agg(
        F.min("doc_id").alias("doc_id"), F.collect_set(F.struct("lo", "many")).alias("ranges")
    )


def repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``t1, t2, first, starts``: by text, its smallest document and the starts of its windows
    that also stand in a smaller document."""
    texts = _texts(docs, id_col, text).where("doc_id is not null")
    folder = shared_folder(docs.sparkSession)
    sizes = lengths(window)
    chosen = stored(chosen_windows(texts, window, sizes[0]), f"{folder}/chosen")
    ranges = stored(_per_text(_repeated(chosen, ["h"])), f"{folder}/ranges-{sizes[0]}")
    for size in sizes[1:] or sizes:
        once = texts.join(ranges, ["doc_id", "t1", "t2"])
        found = stored(windows_at(once, size), f"{folder}/windows-{size}")
        again = _repeated(found, ["h1", "h2"])
        if size < window:
            starts = again.select("doc_id", "t1", "t2", F.col("pos").alias("lo"), F.lit(1).alias("many"))
            ranges = stored(_per_text(starts), f"{folder}/ranges-{size}")
    covered = again.where("doc_id > first").groupBy("t1", "t2")
    return covered.agg(
        F.min("doc_id").alias("first"), F.array_sort(F.collect_set("pos")).alias("starts")
    )


def without_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` of every row of ``docs``.

    A word goes if a window of ``window`` words covers it whose words also start, in the same
    order, in a document with a smaller id.  Words are kept as they are, one blank apart.  Equal
    texts are compared as one: each but the smallest document's is a repeat as a whole.  Lengths
    double up to ``window`` only, since longer repeats are unions of such windows.  Windows
    are told apart by 128 bits, short ones by 64, where equal hashes only make a candidate.

    A null text has no words; a row without an id is neither smaller nor larger than others, so
    it keeps its words and removes none; repeated rows have equal ids and so leave each other
    whole; texts under ``window`` words stay; an empty table gives no rows.  Other columns are
    not read.
    """
    texts = _texts(docs, id_col, text)
    found = repeats(docs, window, id_col, text)
    copies = texts.groupBy("t1", "t2").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    marks = (
        copies.where("least < most")
        .join(found, ["t1", "t2"], "full")
        .select("t1", "t2", F.coalesce("first", "least").alias("first"), "starts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            total, removed, kept, digests = [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2)]
            starts = batch.column(3)
            for i, (doc, value, first) in enumerate(zip(*columns, strict=True)):
                words = value.encode().split()
                rest = words
                if doc is not None and first is not None:
                    if doc > first:
                        rest = words if len(words) < window else []
                    elif starts[i].is_valid:
                        edges = np.zeros(len(words) + 1, dtype=np.int64)
                        at = starts[i].values.to_numpy()
                        edges[at] += 1
                        edges[at + window] -= 1
                        stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                        rest = [words[j] for j in stay]
                joined = b" ".join(rest)
                total.append(len(words))
                removed.append(len(words) - len(rest))
                kept.append(joined.decode())
                digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    rows = texts.join(marks, ["t1", "t2"], "left").select("doc_id", "text", "first", "starts")
    return rows.mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string",
    )
