"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.graph import components
from lintlake.llm.spans import slices
from lintlake.sources.storage import discard, shared_folder, stored

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BLOCKS = 8
PIVOTS = 16
CHUNK = 1 << 16
COMPARED = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
ORDERS = np.array(
    [xxhash.xxh64_intdigest(b"order %d" % k, SEED) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64
)
SLICE = 512  # shingles put in all orders at once


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' XXH64; 0 without words.

    Fewer words than ``size`` make one shingle.
    """
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n).view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, fp`` of every whole text, A-Z lower-cased; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            prints = [
                fingerprint((t or "").encode().lower().split(), size)
                for t in batch.column(1).to_pylist()
            ]
            fp = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> list[int]:
    """The reference fingerprints: hashes of their own numbers."""
    return [xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(PIVOTS)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp, near, far``: distances to the references, a byte each, eight to a long."""

    def packed(pivots: list[int]) -> Column:
        bytes_ = [
            F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("bigint"), 8 * i)
            for i, p in enumerate(pivots)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), bytes_)

    pivots = references()
    return fps.select("fp", packed(pivots[:8]).alias("near"), packed(pivots[8:]).alias("far"))


def _near(max_bits: int) -> Column:
    """That rows ``x`` and ``y`` are near in all pivot coordinates and then in their bits."""

    def close(name: str) -> Column:
        parts = []
        for i in range(8):
            a, b = (F.shiftright(F.col(f"{s}.{name}"), 8 * i).bitwiseAND(255) for s in "xy")
            parts.append(F.abs(a - b) <= max_bits)
        return reduce(lambda p, q: p & q, parts)

    bits = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    return close("near") & close("far") & (bits <= max_bits)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` of every two distinct fingerprints that differ in 1 to ``max_bits`` bits.

    Comparing all pairs is not an option, so the pivot table is joined with itself within
    groups that lose no link: two fingerprints that differ in ``max_bits`` bits agree in all
    but ``max_bits`` of eight bytes, so each choice of the other bytes is a table with those
    as the key.  At two bits a group shares six bytes and can hold 65,536 fingerprints at the
    very most, whatever the input.  Within a group a pair is discarded if any of its pivot
    coordinates differ by more than ``max_bits`` (the triangle inequality), and the survivors
    are verified; both are join conditions, so only links leave the join.  The join sorts
    both sides: Spark sizes the exploded table as if it weren't, and would broadcast it.
    """
    pivots = pivot_table(fps.select("fp").where("fp is not null").distinct())
    byte = (1 << 64) - 1
    keys = []
    for number, out in enumerate(combinations(range(BLOCKS), max_bits)):
        mask = byte & ~sum(0xFF << (8 * b) for b in out)
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(_signed(mask)))))
    table = pivots.select(F.explode(F.array(*keys)).alias("key"), "fp", "near", "far")
    x, y = table.alias("x"), table.alias("y")

    found = x.join(
        y.hint("merge"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _near(max_bits),
    )
    return found.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def word_hashes(words: list[bytes], size: int = COMPARED) -> np.ndarray:
    """The distinct shingles of ``size`` words as 64-bit hashes; fewer words make one shingle."""
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        one = np.concatenate((one, np.full(size - len(words), len(words), dtype=np.uint64)))
    h = np.zeros(len(one) - size + 1, dtype=np.uint64)
    for i in range(size):
        h = _mixed(h ^ one[i : len(one) - size + 1 + i])
    return np.unique(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def pivot_distances(shingles: np.ndarray) -> np.ndarray:
    """Distances of a set of shingles to PIVOTS sets, each up to a constant of the pivot.

    Pivot p is the set of all hashes with bit p, and the distance of two sets is the number of
    hashes that only one of them has.
    """
    count = np.zeros(PIVOTS, dtype=np.int64)
    bits = np.arange(PIVOTS, dtype=np.uint64)
    for i in range(0, len(shingles), CHUNK):
        part = shingles[i : i + CHUNK, None] >> bits & np.uint64(1)
        count += part.sum(axis=0, dtype=np.int64)
    return len(shingles) - 2 * count


def _possible(min_similarity: float) -> Column:
    """That rows ``x`` and ``y`` may have that similarity by their sizes and pivot distances.

    Sets of that similarity differ in (1 - s) / (1 + s) of the sum of their sizes at most, and
    by the triangle inequality no pivot distance of theirs differs in more, so no link is lost.
    """
    a, b = F.col("x.n_shingles"), F.col("y.n_shingles")
    most = (a + b) * ((1 - min_similarity) / (1 + min_similarity)) + 0.5  # whole numbers below
    fits = F.least(a, b) >= min_similarity * F.greatest(a, b)
    for i in range(PIVOTS):
        fits = fits & (F.abs(F.col("x.pivots")[i] - F.col("y.pivots")[i]) <= most)
    return fits


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each of BANDS bands of ROWS minima of the shingles under other orders.

    Texts of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8,
    0.99997 at 0.85.
    """
    lows = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), SLICE):
        under = shingles[i : i + SLICE, None] * ORDERS
        lows = np.minimum(lows, under.min(axis=0))
    bands = lows.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(bands[b].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, node, n_shingles, pivots, bands`` of every whole text.

    ``node`` is a hash of the lower-cased words, so copies share it.  Texts without words have
    a null node and no pivots or bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            node, count, pivots, bands = [], [], [], []
            for t in batch.column(1).to_pylist():
                words = (t or "").encode().lower().split()
                shingles = word_hashes(words) if words else []
                node.append(_node(words))
                count.append(len(shingles))
                pivots.append(pivot_distances(shingles) if words else [])
                bands.append(band_keys(shingles) if words else [])
            columns = [
                batch.column(0),
                pa.array(node, type=pa.int64()),
                pa.array(count, type=pa.int32()),
                pa.array(pivots, type=pa.list_(pa.int32())),
                pa.array(bands, type=pa.list_(pa.int64())),
            ]
            names = ["doc_id", "node", "n_shingles", "pivots", "bands"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id bigint, node bigint, n_shingles int, pivots array<int>, bands array<bigint>",
    )


def _node(words: list[bytes]) -> int | None:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)) if words else None


def texts_of(
    docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``node, text``: the text, in lower case, of each ``node, first_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            low = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
            node = pa.array([_node(t.split()) for t in low], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), node, pa.array(low, pa.binary())], ["doc_id", "node", "text"]
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(run, "doc_id bigint, node bigint, text binary")
    same = (rows.node == nodes.node) & rows.doc_id.eqNullSafe(nodes.first_id)
    wanted = rows.join(nodes, same, "left_semi")
    return wanted.groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, min_similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose texts have that Jaccard similarity of COMPARED-word shingles.

    ``texts`` has one ``node, text`` for each node; only texts in pairs are moved.  They are not
    broadcast: their size in a file is no bound of that in memory.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    moved = texts.join(ends, "node", "left_semi").hint("merge")
    both = pairs.join(moved.withColumnsRenamed({"node": "a", "text": "x"}), "a").join(
        moved.withColumnsRenamed({"node": "b", "text": "y"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, y = word_hashes(x.as_py().split()), y.as_py()
                if y != last:  # pairs of one b often follow each other
                    last, t = y, word_hashes(y.split())
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(shared >= min_similarity * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def similar_texts(
    docs: DataFrame,
    min_similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """``doc_id, component_id`` of each row: groups of texts by similarity of their shingles.

    Two texts are linked if their COMPARED-word shingles have that Jaccard similarity;
    ``component_id`` is the smallest id reachable over links.  The pivot table is joined within
    groups of equal band keys (see ``band_keys``); sizes and pivot distances discard only pairs
    that can't have the similarity (see ``_possible``) and the shingles verify all others.

    Each group is first compared with one of its texts, which joins most of a large group;
    then only texts of a group that are still in different components are compared, so links
    within a component are not listed but none between components is left out.  Copies are one
    node.  Texts without words and rows without an id are groups of their own (a null
    ``component_id`` only where no text of the group has an id); repeated rows are returned
    each; an empty table gives no rows.  Tables between the steps go below ``folder``, by
    default a new one; those that the result does not read are gone when it is returned.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    numbered = sketches(docs, id_col, text).withColumn("row", F.monotonically_increasing_id())
    drawn = stored(numbered, f"{folder}/sketches")
    firsts = drawn.where("node is not null").groupBy("node")
    firsts = stored(
        firsts.agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row")), f"{folder}/firsts"
    )
    one = drawn.join(firsts.select("row"), "row", "left_semi")
    pivots = one.select("node", "n_shingles", "pivots")
    keyed = one.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"))
    shared = shared.where("n > 1").drop("n")
    keyed = stored(keyed.join(shared, "key").join(pivots, "node"), f"{folder}/keyed")
    asked = firsts.select("node", "first_id").join(keyed.select("node"), "node", "left_semi")
    texts = texts_of(docs, asked, id_col, text)
    texts = stored(texts, f"{folder}/texts")

    def compared(x: DataFrame, y: DataFrame, rest: Column, name: str) -> DataFrame:
        a, b = F.col("x.node"), F.col("y.node")
        mates = (F.col("x.key") == F.col("y.key")) & rest & _possible(min_similarity)
        # sorted: a file holds a node's pivots in far fewer bytes than memory, once for each key
        pairs = x.alias("x").join(y.alias("y").hint("merge"), mates)
        pairs = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
        pairs = stored(pairs, f"{folder}/pairs-{name}")
        links = stored(verified(pairs, texts, min_similarity), f"{folder}/links-{name}")
        discard(spark, f"{folder}/pairs-{name}")
        return links

    heads = keyed.where("node = low")
    near = compared(keyed, heads, F.col("x.node") != F.col("y.node"), "heads")
    roots = components(near, f"{folder}/near").withColumnRenamed("root", "group")
    grouped = keyed.join(roots, "node", "left").withColumn("group", F.coalesce("group", "node"))
    mixed = grouped.groupBy("key").agg(F.min("group").alias("g"), F.max("group").alias("h"))
    grouped = grouped.join(mixed.where("g <> h").select("key"), "key", "left_semi")
    grouped = stored(grouped, f"{folder}/grouped")
    apart = (F.col("x.group") != F.col("y.group")) & (F.col("x.node") < F.col("y.node"))
    rest = compared(grouped, grouped, apart, "rest")

    for done in ("texts", "keyed", "grouped", "near"):
        discard(spark, f"{folder}/{done}")
    ends = components(near.union(rest), f"{folder}/ends")
    named = firsts.join(ends, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = named.join(lowest, "root").select("node", "component_id")
    return drawn.join(by_node, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` of each row of ``docs``.

    Texts with equal fingerprints are one node, so copies cost one row however many there are.
    ``component_id`` is the smallest id reachable over links.  Texts without words all have
    fingerprint zero and belong together.  Null ids are never a component's id unless it has no
    other; repeated rows are returned each; an empty table gives no rows.
    """
    prints = stored(
        fingerprints(docs, size, id_col, text), f"{shared_folder(docs.sparkSession)}/prints"
    )
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = links(prints, max_bits)
    roots = components(found).withColumnRenamed("node", "fp")
    classes = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = classes.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
