"""Embedding near-dedup: tiles in PCA order, residual products bounded by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.graph import components
from lintlake.sources.storage import shared_folder, stored

MIN_COSINE = 0.9
LEADING = 3  # axes of the grid of cells
TILE = 2048  # rows of either side that are compared at once
TILE_BYTES = 16 << 20  # most of either side in a task's group, as doubles
SPREAD = 8  # tiles that all rows make at least, for the sake of many tasks
STEP = 16  # axes added before each test
MARGIN = 1e-6  # room for rounding in bounds; links are decided by the exact cosine
SINGLE_MARGIN = 1e-4  # the same in single precision


def _as_double(cell) -> np.ndarray:
    return np.array([np.nan if x is None else x for x in cell], dtype=np.float64)


def unit_rows(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """``vec_id, vec``: the components as bytes; null for what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(1).to_pylist():
                v = None if cell is None else _as_double(cell)
                good = v is not None and len(v) and np.isfinite(v).all() and v.any()
                out.append(v.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(out, type=pa.binary())], ["vec_id", "vec"]
            )

    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(column))
    return rows.mapInArrow(run, "vec_id bigint, vec binary")


def _normal(block: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so very large or small components don't overflow."""
    block = block / np.abs(block).max(axis=1, keepdims=True)
    return block / np.linalg.norm(block, axis=1, keepdims=True)


def principal_axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the axes of the unit vectors' second moments, leading first.

    Partial sums of d x d moments are added up by Spark; the driver gets one matrix per length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            cells = batch.column(1).to_pylist()
            for d in np.unique(lengths).tolist():
                x = _normal(np.stack([np.frombuffer(cells[i]) for i in np.flatnonzero(lengths == d)]))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            for i, line in enumerate(m):
                yield pa.RecordBatch.from_pydict({"dim": [d], "i": [i], "line": [line.tolist()]})

    parts = distinct.select("dim", "vec").mapInArrow(run, "dim bigint, i bigint, line array<double>")
    cells = parts.select("dim", "i", F.posexplode("line").alias("j", "x"))
    axes: dict[int, np.ndarray] = {}
    for d, i, j, x in cells.groupBy("dim", "i", "j").agg(F.sum("x")).collect():
        axes.setdefault(d, np.zeros((d, d)))[i, j] = x
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in axes.items()}


def _packed(v: np.ndarray) -> bytes:
    """The components in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return single.tobytes() if (single == v).all() else v.tobytes()


def _unpacked(cells: list[bytes], dim: int) -> np.ndarray:
    kinds = {4 * dim: np.float32, 8 * dim: np.float64}
    return np.stack([np.frombuffer(x, kinds[len(x)]).astype(np.float64) for x in cells])


def _cells(distinct: DataFrame, axes: dict[int, np.ndarray], reach: float) -> DataFrame:
    """``dim, cls, n, vec, cells``: packed rows with the cells they stand in and visit.

    Unit vectors with a cosine of c are ``reach = sqrt(2 - 2c)`` apart, so in every leading
    axis at most that.  Cells are ``reach`` wide: partners stand in the same or a touching
    cell.  A row is at home in its own cell, the first one, and a guest in half of the touching
    ones, so each pair of cells meets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, cells = [], []
            for dim, vec in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                v = np.frombuffer(vec)
                rot = _normal(v[None, :])[0] @ axes[dim][:, :LEADING]
                at = np.floor(rot / reach).astype(int).tolist()
                shifts = [x for x in product((-1, 0, 1), repeat=len(at)) if x >= (0,) * len(at)]
                cells.append([f"{dim}:" + ",".join(str(c + d) for c, d in zip(at, x)) for x in shifts])
                vecs.append(_packed(v))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(vecs, type=pa.binary()),
                    pa.array(cells, type=pa.list_(pa.string())),
                ],
                names=["dim", "cls", "n", "vec", "cells"],
            )

    return distinct.select("dim", "cls", "n", "vec").mapInArrow(
        run, "dim bigint, cls bigint, n bigint, vec binary, cells array<string>"
    )


def close_pairs(
    a: np.ndarray, b: np.ndarray, least: float, step: int = STEP
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two PCA-ordered tiles that may reach the cosine ``least``.

    Leading axes are accumulated first.  What the remaining axes can add is at most the product
    of the rows' suffix norms (Cauchy-Schwarz); a pair is given up once that cannot reach
    ``least``, and the tile is given up once no pair is left.  The first test is one product in
    single precision, with the suffix norms as one more axis.
    """
    tail_a = np.sqrt(np.maximum(0, 1 - np.cumsum(a * a, axis=1)))
    tail_b = np.sqrt(np.maximum(0, 1 - np.cumsum(b * b, axis=1)))
    at = min(step, a.shape[1])
    x, y = (
        np.column_stack((m[:, :at], tail[:, at - 1])).astype(np.float32)
        for m, tail in ((a, tail_a), (b, tail_b))
    )
    i, j = np.divmod(np.flatnonzero(x @ y.T >= np.float32(least - SINGLE_MARGIN)), len(b))
    total = np.empty(len(i))
    for s in range(0, len(i), 200_000):
        part = slice(s, s + 200_000)
        total[part] = np.einsum("ij,ij->i", a[i[part], :at], b[j[part], :at])
    while at < a.shape[1] and len(i):
        end = min(at + step, a.shape[1])
        for s in range(0, len(i), 200_000):
            part = slice(s, s + 200_000)
            total[part] += np.einsum("ij,ij->i", a[i[part], at:end], b[j[part], at:end])
        at = end
        keep = total + tail_a[i, at - 1] * tail_b[j, at - 1] >= least - MARGIN
        i, j, total = i[keep], j[keep], total[keep]
    return i, j


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of links that join what the links before have not: a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for at, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            kept.append(at)
    return kept


def _links(unit: np.ndarray, vec: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs of rows have the cosine ``least``."""
    keep = [np.zeros(0, bool)]
    for s in range(0, len(i), 200_000):
        p, q = i[s : s + 200_000], j[s : s + 200_000]
        cosine = np.einsum("ij,ij->i", unit[p], unit[q])
        for k in np.flatnonzero(np.abs(cosine - least) < MARGIN):
            cosine[k] = exact_cosine(vec[p[k]], vec[q[k]])
        keep.append(cosine >= least)
    return np.concatenate(keep)


def _compare(least: float, axes: dict[int, np.ndarray]):
    """Counts and a spanning forest of the links between a group's two sides, TILE rows at a time."""

    def run(group: pa.Table) -> pa.Table:
        guest = group.column("guest").to_numpy()
        cls = group.column("cls").to_numpy()
        size = group.column("n").to_numpy()
        side = group.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        total = np.zeros(len(cls))
        ends = [np.zeros((2, 0), np.int64)]
        if len(left) and len(right):
            dim = group.column("dim")[0].as_py()
            vec = _unpacked(group.column("vec").to_pylist(), dim)
            unit = _normal(vec)
            rot = unit @ axes[dim]
            for s, t in product(range(0, len(left), TILE), range(0, len(right), TILE)):
                a, b = left[s : s + TILE], right[t : t + TILE]
                i, j = close_pairs(rot[a], rot[b], least)
                i, j = a[i], b[j]
                # Two rows at home in one cell meet in both orders or with themselves: keep one.
                once = guest[j] | (cls[i] < cls[j])
                i, j = i[once], j[once]
                keep = _links(unit, vec, i, j, least)
                i, j = i[keep], j[keep]
                total += np.bincount(i, size[j], len(cls)) + np.bincount(j, size[i], len(cls))
                tree = _forest(cls[i], cls[j])
                ends.append(np.stack((cls[i[tree]], cls[j[tree]])))
        linked = np.flatnonzero(total)
        a, b = np.concatenate(ends, axis=1)
        tree = _forest(a, b)
        return pa.table(
            {
                "cls": pa.array([*cls[linked].tolist(), *[None] * len(tree)], type=pa.int64()),
                "more": pa.array(
                    [*total[linked].astype(np.int64).tolist(), *[None] * len(tree)], type=pa.int64()
                ),
                "a": pa.array([*[None] * len(linked), *a[tree].tolist()], type=pa.int64()),
                "b": pa.array([*[None] * len(linked), *b[tree].tolist()], type=pa.int64()),
            }
        )

    return run


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine in double precision, as the plain formula has it."""
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def tile_rows(rows: int, dim: int) -> int:
    """Rows of a tile: each row is sent to a group for each tile of the other side."""
    return max(TILE, min(TILE_BYTES // (8 * dim), rows // SPREAD))


def near_duplicates(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    id_col: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors``.

    Equal vectors are one class with a count, so copies are never compared one by one.  Classes
    are dealt to cells of the leading principal axes and only touching cells are compared, in
    tiles of ``tile_rows`` a side; a crowded cell is split into many tiles.  Vectors are moved
    in single precision where that is exact and rotated where they are compared.  A tile gives
    back a count for each class and a spanning forest of its links, not the links themselves.

    Null, empty or zero vectors, and those with null or non-finite components, have no links
    and are their own component; vectors of different lengths never link.  A null id takes part
    but names no component with another member.  Repeated rows link with each other; an empty
    table gives no rows; columns other than the two named are not read.
    """
    work = shared_folder(vectors.sparkSession)
    rows = stored(unit_rows(vectors, id_col, column), f"{work}/rows")
    reach = float(np.sqrt(2 - 2 * min_cosine)) + MARGIN
    keyed = rows.where("vec is not null").withColumn("dim", (F.length("vec") / 8).cast("bigint"))
    classes = keyed.groupBy("dim", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), f"{work}/classes")
    axes = principal_axes(classes)
    dealt = stored(_cells(classes, axes, reach), f"{work}/dealt")
    tile = tile_rows(classes.count(), max(axes, default=1))
    names = dealt.select(F.posexplode("cells").alias("visit", "cell"))
    crowd = names.groupBy("cell").agg(
        F.ceil(F.sum((F.col("visit") == 0).cast("int")) / tile).alias("homes"),
        F.ceil(F.count("*") / tile).alias("all"),
    )
    row = ["dim", "cls", "n", "vec"]
    placed = dealt.select(*row, F.posexplode("cells").alias("visit", "cell"))
    placed = placed.withColumn("guest", F.col("visit") > 0).join(crowd.where("homes > 0"), "cell")
    own = F.pmod(F.xxhash64("cls"), F.col("homes"))
    other = F.pmod(F.xxhash64(F.lit("guest"), "cls"), F.col("all"))
    row += ["cell", "guest"]
    left = placed.where("not guest").select(
        *row,
        own.alias("p"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all") - 1)).alias("q"),
        F.lit(0).alias("side"),
    )
    right = placed.select(
        *row,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("homes") - 1)).alias("p"),
        other.alias("q"),
        F.lit(1).alias("side"),
    )
    tiles = left.unionByName(right).groupBy("cell", "p", "q")
    found = tiles.applyInArrow(
        _compare(min_cosine, axes), "cls bigint, more bigint, a bigint, b bigint"
    )
    found = stored(found, f"{work}/found")
    more = found.where("cls is not null").groupBy("cls").agg(F.sum("more").alias("more"))
    roots = components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "cls")
    joined = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = (
        joined.join(lowest, "root")
        .join(more, "cls", "left")
        .select(
            "vec",
            (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"),
            F.col("component_id").alias("lowest"),
        )
    )
    return rows.join(by_class, "vec", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("lowest", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("lowest", "vec_id"), F.lit(False)).alias("kept"),
    )
