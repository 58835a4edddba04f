"""Tables that change batch by batch: readers see what a small file, written last, names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.sources.storage import COMPRESSION, discard, stored

BUCKETS = 64


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the commits of a folder, in order."""
    path, fs = _hadoop(spark, f"{folder}/_commits")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit())


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Make a batch visible: its file appears whole or not at all."""
    path, fs = _hadoop(spark, f"{folder}/_commits/{number}")
    draft, _ = _hadoop(spark, f"{folder}/_commits/.{number}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.rename(draft, path)


def content(spark: SparkSession, folder: str, number: int) -> dict:
    path, fs = _hadoop(spark, f"{folder}/_commits/{number}")
    stream = fs.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def write_batch(df: DataFrame, table: str, number: int) -> None:
    """Rows of one batch in a folder named by it, so a repeated batch replaces itself."""
    df.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{table}/batch_id={number}")


def read_batches(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table's rows of the batches that ``folder`` has committed.

    Batches follow one another, so those up to the last commit are whole; partitions of a
    later one, which may be half written, are not read.
    """
    done = commits(spark, folder)
    fields = schemas.struct_of(schema)
    if not done:
        return spark.createDataFrame([], fields)
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{folder}/{name}")
    return rows.where(F.col("batch_id") <= done[-1]).drop("batch_id")


@dataclass(frozen=True)
class KeyedTable:
    """A table kept in buckets by the hash of ``by``; a merge rewrites the buckets it touches.

    ``data/v=N/bucket=K`` has bucket K as merge N left it; the commit file of a merge names the
    merge that last wrote each bucket.  Readers of the state before a merge keep their files:
    a bucket's older folder goes with the merge after the one that replaced it.  Choose
    ``buckets`` for the size the table will have, about a Parquet file each.
    """

    spark: SparkSession
    folder: str
    schema: str
    by: tuple[str, ...]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _state(self, back: int = 1) -> dict[int, int]:
        """The merge that wrote each bucket, as of the last commit or of one before it."""
        done = commits(self.spark, self.folder)
        if len(done) < back:
            return {}
        found = content(self.spark, self.folder, done[-back])
        return {int(k): v for k, v in found.items()}

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        state = self._state()
        wanted = state if only is None else [k for k in only if k in state]
        paths = [f"{self.folder}/data/v={state[k]}/bucket={k}" for k in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], schemas.struct_of(self.schema))
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows belong to; their number is bounded by ``buckets``."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def merge(
        self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], number: int
    ) -> None:
        """Commit ``combine(old rows, new rows)`` of the touched buckets as merge ``number``.

        Merges are numbered upwards; one that is committed already changes nothing.  A merge
        that was cut off is repeated whole, since only its commit makes it visible.
        """
        done = commits(self.spark, self.folder)
        if done and number <= done[-1]:
            return
        work = f"{self.folder}/_work/{number}"
        rows = stored(rows.select(*schemas.struct_of(self.schema).names), work)
        touched = self.touched(rows)
        state, before = self._state(), self._state(2)
        if touched:
            new = combine(self.read(touched), rows).withColumn("bucket", self.bucket())
            new = new.repartition(min(len(touched), self.buckets), "bucket")
            target = f"{self.folder}/data/v={number}"
            new.write.mode("overwrite").partitionBy("bucket").parquet(target)
        commit(self.spark, self.folder, number, {**state, **dict.fromkeys(touched, number)})
        for k, v in before.items():
            if state.get(k) != v:
                discard(self.spark, f"{self.folder}/data/v={v}/bucket={k}")
        discard(self.spark, work)


def replacing(keys: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """New rows replace the old ones of equal keys."""

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)

    return combine


def newest(keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For each key the row that comes last, old or new."""

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new)
        rest = [c for c in old.columns if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
        return rows.groupBy(*keys).agg(last).select(*keys, "last.*").select(*old.columns)

    return combine
