"""A findings table laid out for its page: the worst, newest rows of an organization lie together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import scalars as S
from lintlake.operators.dashboard import top_findings, with_severity
from lintlake.sources.versioned import commit, commits, content

ROWS_PER_FILE = 1_000_000


@dataclass(frozen=True)
class PageTable:
    """Findings with their context in files by (org_id, severity order, newest id first).

    A batch is one range layout, so an organization with most of the rows is many files.
    ``index`` has one row for each file, organization and severity with the first and last id
    there.  A page reads the files that can hold its rows, at most one for each of them and one
    for each batch and severity, however many files the organization has.  ``compact`` makes one
    batch of all.  A batch is seen once its commit file, which names the live batches, is
    written; a committed number changes nothing when repeated.  Batches are numbered upwards.
    """

    spark: SparkSession
    folder: str
    schema: str  # of the rows, with org_id, severity and id
    rows_per_file: int = ROWS_PER_FILE

    def _live(self) -> list[int]:
        done = commits(self.spark, self.folder)
        return content(self.spark, self.folder, done[-1])["batches"] if done else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        live = [f"{self.folder}/{kind}/batch={n}" for n in self._live()]
        if not live:
            return self.spark.createDataFrame([], schemas.struct_of(schema))
        return self.spark.read.schema(schema).parquet(*live)

    def read(self) -> DataFrame:
        return self._read("data", self.schema)

    def index(self) -> DataFrame:
        """``file, org_id, severity, ord, newest, oldest, n``; ``oldest`` is null if an id is."""
        types = {f.name: f.dataType.simpleString() for f in schemas.struct_of(self.schema)}
        columns = f"org_id {types['org_id']}, severity {types['severity']}"
        ids = f"newest {types['id']}, oldest {types['id']}"
        return self._read("index", f"file string, {columns}, ord smallint, {ids}, n bigint")

    def _write(self, rows: DataFrame, number: int) -> None:
        data = f"{self.folder}/data/batch={number}"
        rows = rows.select(*schemas.struct_of(self.schema).names)
        order = [F.col("org_id"), S.severity_order(F.col("severity")), F.desc("id")]
        files = max(1, -(-rows.count() // self.rows_per_file))
        laid = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
        laid.write.mode("overwrite").parquet(data)
        back = self.spark.read.schema(self.schema).parquet(data)
        back = back.select(F.col("_metadata.file_path").alias("file"), "org_id", "severity", "id")
        known = F.count("id") == F.count(F.lit(1))
        entries = back.groupBy("file", "org_id", "severity").agg(
            F.max("id").alias("newest"),
            F.when(known, F.min("id")).alias("oldest"),
            F.count(F.lit(1)).alias("n"),
        )
        entries = entries.withColumn("ord", S.severity_order(F.col("severity")))
        entries = entries.select("file", "org_id", "severity", "ord", "newest", "oldest", "n")
        index = entries.repartitionByRange(max(1, files // 10_000), "org_id", "ord")
        index.sortWithinPartitions("org_id", "ord").write.mode("overwrite").parquet(
            f"{self.folder}/index/batch={number}"
        )

    def append(self, rows: DataFrame, number: int) -> None:
        """Add a batch of rows."""
        done = commits(self.spark, self.folder)
        if done and number <= done[-1]:
            return
        self._write(rows, number)
        commit(self.spark, self.folder, number, {"batches": [*self._live(), number]})

    def compact(self, number: int) -> None:
        """Lay out all rows anew as batch ``number``; the old batches' files stay for readers."""
        done = commits(self.spark, self.folder)
        if done and number <= done[-1]:
            return
        self._write(self.read(), number)
        commit(self.spark, self.folder, number, {"batches": [number]})

    def files(self, org_id: int | str, severity: str | None, limit: int) -> list[str]:
        """The files that hold the first ``limit`` rows of the page.

        Entries come by their last row: the first of them with ``limit`` rows in all, so at most
        ``limit`` entries, prove that no row behind the last one's last row is on the page.
        """
        own = self.index().where(F.col("org_id") == F.lit(org_id))
        own = with_severity(own, severity)
        bound = None
        total = 0
        for e in own.orderBy("ord", F.desc_nulls_last("oldest")).limit(limit).collect():
            total, bound = total + e["n"], e
            if total >= limit:
                break
        if bound is None:
            return []
        if total >= limit:
            own = own.where(_reaches(bound["ord"], bound["oldest"]))
        return sorted(r[0] for r in own.select("file").distinct().collect())

    def page(
        self,
        org_id: int | str,
        severity: str | None = None,
        limit: int = schemas.FINDINGS_PAGE_LIMIT,
    ) -> DataFrame:
        """The page of an organization, as ``dashboard.findings_page`` gives it."""
        files = self.files(org_id, severity, limit) if limit > 0 else []
        if not files:
            rows = self.spark.createDataFrame([], schemas.struct_of(self.schema))
        else:
            rows = self.spark.read.schema(self.schema).parquet(*files)
        rows = rows.where(F.col("org_id") == F.lit(org_id))
        return top_findings(with_severity(rows, severity).drop("org_id"), limit)


def _reaches(order: int, oldest: int | str | None) -> Column:
    """That an entry's first row does not come after the bound."""
    first = F.col("ord") == order
    if oldest is not None:
        first = first & (F.col("newest") >= F.lit(oldest))
    return (F.col("ord") < order) | first
