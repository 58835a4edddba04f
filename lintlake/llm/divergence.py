"""Source divergence audit: how the term shares of a source differ from its language's.

Terms that a source uses most above its language are found by a dominance skyband.  A term's
value grows with its count in the group and falls with its count in the language, and equal
values go by the earlier term.  So a term that k others dominate in all three (count in the
group not lower, count in the language not higher, earlier UTF-8) can't be among the first k,
whatever the group's totals.  Each partition of terms retains, by group, the terms that fewer
than k others dominate; these skybands are merged twice, first in ``MERGE_WAYS`` shares and
then whole, and only the last one is ranked by exact values.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.sources.storage import shared_folder, stored

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
PENDING = 4_096  # rows of a group that wait until they are compared
HELD = 300_000  # rows a task holds before it passes on what it has
MERGE_WAYS = 64
CELLS = 1 << 18  # of a block of terms by sources

_KEEP = bytearray(32 if b < 128 else b for b in range(256))
for _b in range(26):
    _KEEP[65 + _b] = _KEEP[97 + _b] = 97 + _b
LETTERS = bytes(_KEEP)  # lower-cases A-Z, keeps bytes of other characters, blanks the rest


def _text(df: DataFrame, name: str):
    return F.coalesce(df[name].cast("string"), F.lit(""))


def term_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for (a, b), count in counts.items():
                terms, within = list(count), held[a, b]
                columns = [
                    pa.array([a] * len(terms), pa.string()),
                    pa.array([b] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(list(count.values()), pa.int64()),
                    pa.array([within[t] for t in terms], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            counts.clear()
            held.clear()

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, value in zip(keys, batch.column(2), strict=True):
                words = value.as_py().encode().translate(LETTERS).split()
                counts[key].update(words)
                held[key].update(set(words))
            if sum(map(len, counts.values())) > HELD:
                yield from rows()
        yield from rows()

    given = docs.select(*(_text(docs, c).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    parts = given.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, n, sources[source, n]`` of terms in ``min_docs`` documents of their language."""
    return (
        counts.groupBy("lang", "term")
        .agg(
            F.sum("n").alias("n"),
            F.sum("docs").alias("docs"),
            F.collect_list(F.struct("source", "n")).alias("sources"),
        )
        .where(F.col("docs") >= min_docs)
        .select("lang", "term", "n", "sources")
    )


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count+2) / total) by long division in steps of 1000, exact up to 9*10^15."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def skyband(
    n: np.ndarray, lang_n: np.ndarray, terms: np.ndarray, k: int = TOP
) -> np.ndarray:
    """Positions of the terms that fewer than ``k`` others dominate.

    Rows come in an order in which no row follows one that it dominates; a row is compared
    with those retained before it, which is enough: if k rows dominate it, so do k retained.
    """
    place = np.empty(len(n), dtype=np.int64)
    place[np.argsort(terms, kind="stable")] = np.arange(len(n))
    order = np.lexsort((place, lang_n, -n))
    low, early = lang_n[order], place[order]
    kept = np.empty(0, dtype=np.int64)
    for a in range(0, len(order), 256):
        own = np.arange(a, min(a + 256, len(order)))
        over = ((low[kept] <= low[own, None]) & (early[kept] < early[own, None])).sum(axis=1)
        own = own[over < k]
        over = over[over < k]
        inside = (low[own] <= low[own, None]) & (early[own] < early[own, None])
        # In the order, only earlier rows have counts that are not lower.
        over = over + np.tril(inside, -1).sum(axis=1)
        kept = np.concatenate([kept, own[over < k]])
    return order[kept]


BAND = "lang string, source string, part int, term string, n bigint, lang_n bigint"


def _rows(lang: str, source: str, part: int, band: list[np.ndarray]) -> pa.RecordBatch:
    terms, n, lang_n = band
    columns = [
        pa.array([lang] * len(n), pa.string()),
        pa.array([source] * len(n), pa.string()),
        pa.array(np.full(len(n), part, dtype=np.int32)),
        pa.array(terms.tolist(), pa.binary()).cast(pa.string()),
        pa.array(n),
        pa.array(lang_n),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "term", "n", "lang_n"])


def _pruned(parts: Iterable[tuple], k: int) -> list[np.ndarray]:
    terms, n, lang_n = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = skyband(n, lang_n, terms, k)
    return [terms[keep], n[keep], lang_n[keep]]


def _coded(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct values and each row's place among them."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _bytes(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), dtype=object)
    out[:] = column.cast(pa.binary()).to_pylist()
    return out


def partition_skybands(kept: DataFrame, k: int = TOP) -> DataFrame:
    """The skyband of each group within each partition of terms, and a share to merge it in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], list] = {}
        part, held = -1, 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if part < 0 and batch.num_rows else part
            lists = batch.column(4)
            each = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), each)
            entries = lists.flatten()
            names, code = _coded(entries.field("source"))
            tongues, tongue = _coded(batch.column(1))
            terms = _bytes(batch.column(2))[row]
            lang_n = batch.column(3).to_numpy()[row]
            n = entries.field("n").to_numpy()
            tongue = tongue[row]
            both = tongue * len(names) + code
            order = np.argsort(both, kind="stable")
            cuts = np.flatnonzero(np.diff(both[order], prepend=-1))
            for some in np.split(order, cuts[1:]) if len(order) else ():
                key = (tongues[tongue[some[0]]], names[code[some[0]]])
                group = groups.setdefault(key, [0, []])
                group[0] += len(some)
                group[1].append((terms[some], n[some], lang_n[some]))
                held += len(some)
                if group[0] > PENDING:
                    held -= sum(len(x[1]) for x in group[1])
                    band = _pruned(group[1], k)
                    held += len(band[1])
                    group[:] = [0, [tuple(band)]]
            if held > HELD:
                for key, group in groups.items():
                    yield _rows(*key, part, _pruned(group[1], k))
                groups, held = {}, 0
        for key, group in groups.items():
            yield _rows(*key, part, _pruned(group[1], k))

    share_ = (F.spark_partition_id() % MERGE_WAYS).alias("part")
    return kept.select(share_, "lang", "term", "n", "sources").mapInArrow(run, BAND)


def top_terms(kept: DataFrame, sizes: dict, k: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank`` of the first ``k`` terms above their language's share.

    ``sizes``: by language its total, its number of terms and the totals of its sources.
    """

    def merged(table: pa.Table) -> pa.Table:
        lang, source, part = (table.column(c)[0].as_py() for c in ("lang", "source", "part"))
        rows = _bytes(table.column("term").combine_chunks()), table.column("n").to_numpy(), table.column("lang_n").to_numpy()
        return pa.Table.from_batches([_rows(lang, source, part, _pruned([rows], k))])

    def ranked(table: pa.Table) -> pa.Table:
        lang, source = (table.column(c)[0].as_py() for c in ("lang", "source"))
        rows = _bytes(table.column("term").combine_chunks()), table.column("n").to_numpy(), table.column("lang_n").to_numpy()
        terms, n, lang_n = _pruned([rows], k)
        total, size, sources = sizes[lang]
        p = share(n, sources[source] + 2 * size)
        q = share(lang_n, total + 2 * size)
        above = np.flatnonzero(p > q)
        value = distance(p[above], q[above])
        early = np.argsort(np.argsort(terms[above], kind="stable"))
        first = np.lexsort((early, -value))[:k]
        columns = [
            pa.array([lang] * len(first), pa.string()),
            pa.array([source] * len(first), pa.string()),
            pa.array(terms[above][first].tolist(), pa.binary()).cast(pa.string()),
            pa.array(value[first]),
            pa.array(np.arange(1, len(first) + 1, dtype=np.int32)),
        ]
        return pa.Table.from_arrays(columns, ["lang", "source", "item", "value", "rank"])

    bands = partition_skybands(kept, k)
    shares = bands.groupBy("lang", "source", "part").applyInArrow(merged, BAND)
    return shares.groupBy("lang", "source").applyInArrow(
        ranked, "lang string, source string, item string, value bigint, rank int"
    )


def pair_sums(kept: DataFrame, sizes: dict) -> DataFrame:
    """``lang, source, item, value``: each task's sum over its terms for every two sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        order = {x: {s: i for i, s in enumerate(sizes[x][2])} for x in sizes}
        totals = {
            x: np.array([t + 2 * sizes[x][1] for t in sizes[x][2].values()], dtype=np.int64)
            for x in sizes
        }

        def add(lang: str, table: np.ndarray) -> None:
            p = share(table, totals[lang])
            out = sums.setdefault(lang, np.zeros((p.shape[1],) * 2, dtype=np.int64))
            for i in range(p.shape[1]):
                out[i, i + 1 :] += distance(p[:, i + 1 :], p[:, i : i + 1]).sum(axis=0)

        for batch in batches:
            langs, lang = _coded(batch.column(0))
            lists = batch.column(1)
            each = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(each) - each
            entries = lists.flatten()
            source = entries.field("source").to_pylist()
            n = entries.field("n").to_numpy()
            for number, x in enumerate(langs):
                mine, width = np.flatnonzero(lang == number), len(order[x])
                step = max(1, CELLS // width)
                for a in range(0, len(mine), step):
                    some = mine[a : a + step]
                    at = np.repeat(first[some], each[some]) + _within(each[some])
                    table = np.zeros((len(some), width), dtype=np.int64)
                    column = [order[x][source[j]] for j in at]
                    table[np.repeat(np.arange(len(some)), each[some]), column] = n[at]
                    add(x, table)
        for x, out in sums.items():
            names = np.array(list(order[x]), dtype=object)
            i, j = np.triu_indices(len(names), 1)
            for a, b in ((i, j), (j, i)):
                columns = [
                    pa.array([x] * len(i), pa.string()),
                    pa.array(names[a], pa.string()),
                    pa.array(names[b], pa.string()),
                    pa.array(out[i, j]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])

    return kept.select("lang", "sources").mapInArrow(
        run, "lang string, source string, item string, value bigint"
    )


def _within(each: np.ndarray) -> np.ndarray:
    return np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``docs``.

    Part ``pair`` ranks a language's other sources by their distance summed over all kept
    terms; part ``term`` the ``top`` terms with a share above the language's.  Counts are
    summed in the tasks, by (language, source, term) and then by (language, term), so a
    frequent term is one row for each source at most.  Every two sources of a language are a
    row of the result; the list of sources, its square root in size, goes to the driver and
    the tasks, and so does nothing that grows with texts or terms.

    Null text, lang and source are empty strings and an empty source is a source; repeated
    rows are documents of their own; a language without kept terms has pairs of value 0 and no
    terms; an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    kept = stored(kept_terms(term_counts(docs, text, lang, source), min_docs), f"{folder}/terms")
    groups = docs.select(_text(docs, lang).alias("lang"), _text(docs, source).alias("source"))
    groups = groups.distinct()
    entries = kept.select("lang", F.explode("sources").alias("s"))
    totals = entries.groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
    groups = stored(
        groups.join(totals, ["lang", "source"], "left").na.fill(0, ["n"]), f"{folder}/groups"
    )
    sizes: dict[str, tuple] = {}
    terms = {r.lang: r.size for r in kept.groupBy("lang").agg(F.count("*").alias("size")).collect()}
    for r in groups.orderBy("lang", "source").collect():
        sizes.setdefault(r.lang, (0, terms.get(r.lang, 0), {}))[2][r.source] = r.n
    sizes = {x: (sum(each.values()), size, each) for x, (_, size, each) in sizes.items()}

    other = groups.select("lang", F.col("source").alias("item"))
    nothing = groups.join(other, "lang").where("source <> item")
    zero = nothing.select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    pairs = zero.union(pair_sums(kept, sizes)).groupBy("lang", "source", "item")
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(rank))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).select(*columns)
    found = top_terms(kept, sizes, top).withColumn("part", F.lit("term"))
    return pairs.union(found.select(*columns))
