"""The findings table laid out for its page: rows as by a full sort, few files read."""

import random

from pyspark.sql import functions as F

from lintlake.functions import scalars as S
from lintlake.sources.pages import PageTable
from lintlake.sources.storage import shared_folder

SCHEMA = (
    "org_id bigint, id bigint, severity string, rule_id string, file_path string, "
    "line_number int, message string, repo string, scan_at timestamp"
)


def made(spark, n, orgs, first=0):
    """Findings of which organization 1 has most."""
    ids = spark.range(first, first + n)
    severity = F.element_at(F.array(*map(F.lit, ("error", "warning", "note", "odd", "other"))), (F.pmod(F.hash("id"), F.lit(5)) + 1).cast("int"))
    return ids.select(
        F.when(F.col("id") % 3 == 0, F.col("id") % orgs).otherwise(1).alias("org_id"),
        "id",
        severity.alias("severity"),
        F.lit("r").alias("rule_id"),
        F.lit("f").alias("file_path"),
        F.lit(1).alias("line_number"),
        F.lit("m").alias("message"),
        F.lit("x").alias("repo"),
        F.lit(None).cast("timestamp").alias("scan_at"),
    )


def wanted(rows, org_id, severity, limit):
    order = {"error": 0, "warning": 1, "note": 2}
    own = [r for r in rows if r.org_id == org_id and severity in (None, r.severity)]
    low = -(10**9)
    own.sort(key=lambda r: (order.get(r.severity, 3), -(low if r.id is None else r.id), r.severity or ""))
    return [(r.id, r.severity) for r in own[:limit]]


def got(table, *args):
    return [(r.id, r.severity) for r in table.page(*args).collect()]


def test_page_equals_a_full_sort(spark):
    table = PageTable(spark, shared_folder(spark), SCHEMA, rows_per_file=100)
    assert table.page(1).count() == 0 and table.read().count() == 0
    table.append(made(spark, 1500, 7), 0)
    table.append(made(spark, 400, 7, 5000), 1)
    table.append(made(spark, 400, 7, 5000), 1)  # repeated after its commit
    nulls = made(spark, 40, 3, 9000).withColumn("id", F.lit(None).cast("bigint"))
    nulls = nulls.unionByName(nulls.withColumn("severity", F.lit(None).cast("string")))
    nulls = nulls.withColumn("org_id", F.lit(5).cast("bigint"))
    table.append(nulls, 2)
    table.append(nulls.limit(0), 3)
    rows = table.read().collect()
    assert len(rows) == 1500 + 400 + 80
    random.seed(3)
    asks = [(1, None, 50), (1, "warning", 7), (5, None, 500), (6, "odd", 3), (99, None, 5), (1, "", 5), (1, None, 0)]
    asks += [(random.randrange(7), None, random.randrange(1, 300)) for _ in range(4)]
    for ask in asks:
        assert got(table, *ask) == wanted(rows, *ask), ask
    table.compact(4)
    assert table.read().count() == len(rows)
    for ask in asks[:5]:
        assert got(table, *ask) == wanted(rows, *ask), ask


def test_files_read_do_not_grow_with_the_findings(spark):
    read = []
    for n in (4_000, 40_000):
        table = PageTable(spark, shared_folder(spark), SCHEMA, rows_per_file=400)
        table.append(made(spark, n, 7), 0)
        held = table.index().where("org_id = 1").select("file").distinct().count()
        read.append((held, len(table.files(1, None, 100)), len(table.files(1, "note", 100))))
    assert read[1][0] >= 8 * read[0][0]
    assert max(read[1][1:]) <= 3
    files = table.files(1, None, 100)
    lowest = table.index().where(F.col("file").isin(files)).select(F.min("ord")).first()[0]
    assert lowest == 0 == made(spark, 10, 7).select(F.min(S.severity_order(F.col("severity")))).first()[0]


def test_a_batch_cut_off_is_not_seen(spark):
    table = PageTable(spark, shared_folder(spark), SCHEMA, rows_per_file=50)
    table.append(made(spark, 200, 7), 0)
    before = got(table, 1, None, 20)
    table._write(made(spark, 200, 7, 1000), 1)  # its commit is missing
    assert got(table, 1, None, 20) == before
    table.append(made(spark, 100, 7, 1000), 1)
    assert table.read().count() == 300
