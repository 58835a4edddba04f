"""Packing: all documents' tokens as one stream, cut into windows of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.sources.storage import shared_folder, stored

WINDOW = 2048
END_ID = 1
TOKENIZED = "doc_id bigint, part int, part_start bigint, n bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint, ids binary"
)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """text -> ids as the tokenizers library gives for ``<path>.json`` without special tokens.

    The rank file beside it holds the same merges and encodes several times as fast.  The one
    special string of the vocabulary is matched in texts, as the library does by default.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    coder = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
    return lambda text: coder.encode_to_numpy(text, allowed_special="all").astype("<u4")


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pass one: each document's ids, and where they begin among the ids of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            encode = encode or encoder(vocabulary(tokenizer))
            ids = [
                np.append(encode(x or ""), np.uint32(END_ID)).astype("<u4")
                for x in batch.column(1).to_pylist()
            ]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(np.full(len(n), part, dtype=np.int32)),
                    pa.array(starts),
                    pa.array(n),
                    pa.array([x.tobytes() for x in ids], type=pa.binary()),
                ],
                names=["doc_id", "part", "part_start", "n", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, TOKENIZED)


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    window: int = WINDOW,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each piece of a document that lies in one window of the token stream.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``: ``start`` is
    the piece's place in its document, ``offset`` its place in sequence ``sequence_id``.  A
    document is its text's ids and the end id.  The first pass stores the ids with their place
    in their partition; prefix sums over the partitions' totals, one row for each partition,
    turn that into places in the whole stream, and the second pass cuts at multiples of
    ``window``.  A document that crosses a border gives a record on either side.  Every
    sequence but the last is full, so there is no padding but there.

    A null text is an empty one (only the end id); a null id stays null; repeated rows are
    packed each; an empty table gives no rows; columns other than the two named are not read.
    """
    work = shared_folder(docs.sparkSession)
    tokens = stored(tokenize(docs, tokenizer, id_col, text), f"{work}/tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each partition of the input, as many as there are tasks.
    starts = dict(totals.orderBy("part").collect())
    first, at = {}, 0
    for part, total in starts.items():
        first[part] = at
        at += total

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, part, inside, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                begin, done = first[part] + inside, 0
                while done < n:
                    sequence, offset = divmod(begin + done, window)
                    length = min(window - offset, n - done)
                    piece = ids[4 * done : 4 * (done + length)]
                    row = (doc, done, length, zlib.crc32(piece), n, sequence, offset, piece)
                    for column, value in zip(out, row):
                        column.append(value)
                    done += length
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(out, kinds)], names=names
            )

    return tokens.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids``: the windows as arrays, padded to ``window``.

    Only the last sequence can be short; it is left as it is if its length is a power of two.
    A sequence has ``window`` pieces at most, so its group is bounded.
    """

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), dtype="<u4")
        if len(ids) & (len(ids) - 1):
            ids = np.pad(ids, (0, window - len(ids)), constant_values=pad_id)
        return pa.table(
            {
                "sequence_id": group.column("sequence_id").slice(0, 1),
                "ids": pa.array([ids.astype(np.int64)], type=pa.list_(pa.int64())),
            }
        )

    needed = pieces.select("sequence_id", "offset", "ids")
    return needed.groupBy("sequence_id").applyInArrow(join, "sequence_id bigint, ids array<bigint>")
