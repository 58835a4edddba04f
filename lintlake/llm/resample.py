"""Importance resampling of documents towards a target distribution of hashed features.

Features are runs of consecutive words.  A feature's bucket is its CRC-32 modulo the number of
buckets.  CRC-32 is linear but for a constant that only the length decides, so a span's CRC is
the exclusive-or of one precomputed contribution for each byte and its distance from the
span's end, and the constant of its length.  ``bitwise_xor.reduceat`` folds the contributions
of all spans of a batch at once.  Spans over ``REACH`` bytes are cut from their end into blocks
of ``REACH`` bytes; the state of the blocks before is moved over the next block with the same table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.spans import blocks, flat, slices, utf8, word_spans
from lintlake.sources.storage import shared_folder, stored

MAX_RUN = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
REACH = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True  # of lower-cased bytes


def _contributions() -> np.ndarray:
    """By distance from the end and byte: the CRC's change by that byte."""
    return np.array(
        [
            [zlib.crc32(bytes([b]) + bytes(d)) ^ zlib.crc32(bytes(d + 1)) for b in range(256)]
            for d in range(REACH)
        ],
        dtype=np.uint32,
    )


TABLE = _contributions()
CONSTANTS = np.array([zlib.crc32(bytes(n)) for n in range(4 * REACH)], dtype=np.uint32)


def _constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of as many zero bytes."""
    out = CONSTANTS[np.minimum(lengths, len(CONSTANTS) - 1)]
    over = np.flatnonzero(lengths >= len(CONSTANTS))
    if len(over):
        sizes, which = np.unique(lengths[over], return_inverse=True)
        out[over] = np.array([zlib.crc32(bytes(int(n))) for n in sizes], np.uint32)[which]
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span ``data[start:end]``; spans are not empty and may overlap."""
    out = np.empty(len(starts), dtype=np.uint32)
    for a, b in blocks(ends - starts):
        out[a:b] = _block_crcs(data, starts[a:b], ends[a:b])
    return out


def _block_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    parts = (lengths + REACH - 1) // REACH
    first = np.cumsum(parts) - parts
    left = np.repeat(parts, parts) - 1 - (np.arange(int(parts.sum())) - np.repeat(first, parts))
    stop = np.repeat(ends, parts) - left * REACH
    size = np.minimum(stop - np.repeat(starts, parts), REACH)
    at = flat(stop - size, size)
    far = np.repeat(stop, size) - 1 - at
    folded = np.bitwise_xor.reduceat(TABLE[far, data[at]], np.cumsum(size) - size)
    state = folded[first]
    more = np.flatnonzero(parts > 1)
    turn = 1
    while len(more):
        old = state[more]
        moved = folded[first[more] + turn]
        for k in range(4):
            moved ^= TABLE[REACH - 1 - k, (old >> np.uint32(8 * k)) & np.uint32(255)]
        state[more] = moved
        turn += 1
        more = more[parts[more] > turn]
    return state ^ _constants(lengths)


class _Features:
    """The feature buckets of a batch of texts."""

    def __init__(self, column: pa.Array, max_run: int, buckets: int):
        data, offsets = utf8(column)
        data = LOWER[data]
        starts, ends, self.first = word_spans(data, offsets, WORD)
        self.max_run, self.buckets = max_run, buckets
        lengths = ends - starts
        # The words of a row one blank apart, so that a run of words is one span.
        self.at = np.cumsum(lengths + 1) - lengths - 1
        self.end = self.at + lengths
        self.data = np.full(int((lengths + 1).sum()), 32, dtype=np.uint8)
        for a, b in blocks(lengths):
            self.data[flat(self.at[a:b], lengths[a:b])] = data[flat(starts[a:b], lengths[a:b])]

    def words(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run length: the buckets, and where each row's begin (one entry more)."""
        row = np.repeat(np.arange(len(self.first) - 1), self.words())
        for n in range(1, self.max_run + 1):
            last = np.arange(n - 1, len(self.at))
            whole = last[row[last] == row[last - n + 1]] if len(last) else last
            crcs = span_crcs(self.data, self.at[whole - n + 1], self.end[whole])
            many = np.maximum(self.words() - n + 1, 0)
            yield crcs % np.uint32(self.buckets), np.concatenate([[0], np.cumsum(many)])


def bucket_counts(
    texts: DataFrame, text: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS
) -> DataFrame:
    """``bucket, n`` of the features of all texts, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, 0):
            for found, _ in _Features(batch.column(0), max_run, buckets).runs():
                total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"]
        )

    parts = texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(
    raw: DataFrame, target: DataFrame, text: str = "text", max_run: int = MAX_RUN,
    buckets: int = BUCKETS,
) -> np.ndarray:
    """By bucket: floor(1000 ln) of the smoothed share in ``target`` over that in ``raw``.

    ``buckets`` counts of either side come to the driver, whatever the size of the tables.
    """
    counts = []
    for table in (raw, target):
        count = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(table, text, max_run, buckets).collect():
            count[r.bucket] = r.n
        counts.append(count)
    s, t = counts
    s_all, t_all = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array(
        [
            math.floor(1000 * math.log(float(b + 1) * s_all / (float(a + 1) * t_all)))
            for a, b in zip(s.tolist(), t.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def weigh(
    docs: DataFrame, gain: np.ndarray, max_run: int = MAX_RUN, id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of each row's features."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            features = _Features(batch.column(1), max_run, buckets)
            number = np.zeros(batch.num_rows, dtype=np.int64)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for found, first in features.runs():
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                total += sums[first[1:]] - sums[first[:-1]]
                number += np.diff(first)
            weight = np.where(number > 0, total // np.maximum(number, 1), 0)
            out = [batch.column(0), *map(pa.array, (features.words(), number, weight))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string"))
    return rows.mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_run: int = MAX_RUN,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    The score is the weight plus Gumbel noise from SHA-256 of seed and id.  Of the rows with
    ``min_words`` words or more, ``percent`` of a hundred with the highest scores are drawn and
    ranked, equal scores by the smaller id.  Scores are whole numbers in a range that the
    buckets and the noise bound (below 100,000 values for any table), so the driver sees
    one count for each score; ranks are these counts' running sum plus the place within a
    score, whose rows are a small share of the drawn ones (ids make the noise).

    A null text has no words; a null id hashes as an empty one and comes last among equals;
    repeated rows are scored and ranked one by one; without words the weight is 0; an empty
    table gives no rows, an empty target smoothed gains.  Other columns are not read.
    """
    spark = docs.sparkSession
    gain = gains(docs, target, text, max_run, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    rows = weigh(docs, gain, max_run, id_col, text).withColumn("score", F.col("weight") + noise)
    rows = stored(rows, f"{shared_folder(spark)}/scores")
    able = F.col("n_words") >= min_words
    count = rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()
    quota = percent * sum(r.n for r in count) // 100
    before, offsets = 0, []
    for r in sorted(count, key=lambda r: -r.score):
        if before >= quota:
            break
        offsets.append((r.score, before))
        before += r.n
    columns = ["doc_id", "n_features", "weight", "score"]
    if not offsets:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    high = able & (F.col("score") >= offsets[-1][0])
    within = Window.partitionBy("score").orderBy(
        F.col("doc_id").asc_nulls_last(), "n_features", "weight"
    )
    place = spark.createDataFrame(offsets, "score bigint, before bigint")
    ranked = (
        rows.where(high)
        .join(F.broadcast(place), "score")
        .withColumn("place", F.col("before") + F.row_number().over(within))
        .select(*columns, F.when(F.col("place") <= quota, F.col("place")).alias("rank"))
    )
    return ranked.union(rows.where(~high).select(*columns, F.lit(None).cast("bigint")))
