"""Tables in buckets and streams on them: repeats, late rows, cut-off batches."""

import pytest
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.plans import views as V
from lintlake.plans.catalog import bundled_rules
from lintlake.sources.storage import shared_folder
from lintlake.sources.versioned import KeyedTable, commits, newest, read_batches, replacing, write_batch
from lintlake.streaming import stream as st


def folders(spark, table):
    """Bucket folders on disk, as (merge, bucket)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.folder}/data/v=*/bucket=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = [s.getPath().toString().split("/") for s in found]
    return {(int(x[-2][2:]), int(x[-1][7:])) for x in names}


def test_merge_rewrites_only_touched_buckets(spark):
    table = KeyedTable(spark, shared_folder(spark), "k bigint, t int, v string", ("k",), buckets=16)
    assert table.read().count() == 0 and table.read([3]).count() == 0

    def rows(keys, t):
        return spark.createDataFrame([(k, t, f"{k}-{t}") for k in keys], table.schema)

    put = replacing(["k"])
    table.merge(rows(range(200), 0), put, 0)
    assert {k for _, k in folders(spark, table)} == set(range(16))
    touched = table.touched(rows([5, 6], 1))
    table.merge(rows([5, 6], 1), put, 1)
    assert {k for v, k in folders(spark, table) if v == 1} == set(touched)
    got = {r.k: r.t for r in table.read().collect()}
    assert got == {k: int(k in (5, 6)) for k in range(200)}
    table.merge(rows([5, 900], 7), put, 1)  # repeated after its commit
    assert {r.k: r.t for r in table.read().collect()} == got
    table.merge(rows([5], 2), put, 2)
    table.merge(rows([], 3), put, 3)
    kept = folders(spark, table)
    assert all((0, k) not in kept for k in table.touched(rows([5], 0)))  # replaced by merges 1 and 2
    assert {r.t for r in table.read(table.touched(rows([5], 0))).where("k = 5").collect()} == {2}
    assert table.read().count() == 200


def test_newest_keeps_the_last_row_of_a_key(spark):
    table = KeyedTable(spark, shared_folder(spark), "k bigint, t int", ("k",), buckets=4)
    keep = newest(["k"], ["t"])
    for n, rows in enumerate([[(1, 5), (2, 1)], [(1, 3), (None, 1), (2, 9)], [(None, 4)]]):
        table.merge(spark.createDataFrame(rows, table.schema), keep, n)
    assert {tuple(r) for r in table.read().collect()} == {(1, 5), (2, 9), (None, 4)}


def test_a_batch_without_commit_is_not_read(spark):
    folder = shared_folder(spark)
    assert read_batches(spark, folder, "t", "x int").count() == 0
    write_batch(spark.createDataFrame([(1,)], "x int"), f"{folder}/t", 0)
    assert read_batches(spark, folder, "t", "x int").count() == 0


def arriving(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def test_late_and_repeated_files_are_scanned_once(spark):
    folder, rules = shared_folder(spark), bundled_rules().only("js-no-eval")
    schema = f"{schemas.CORPUS}, repo string"
    runs = [
        [("a.js", "javascript", "eval(1)", "1", "r"), ("a.js", "javascript", "eval(1)", "1", "s")],
        [("a.js", "javascript", "eval(1)", "1", "r"), ("b.js", "javascript", "x\neval(2)", "2", "r")],
        [("a.js", "javascript", "eval(1);eval(2)", "3", "r"), ("b.js", "javascript", "x\neval(2)", "2", "r")],
    ]
    total = []
    for n, rows in enumerate(runs):
        files = arriving(spark, folder, n, rows, schema)
        st.scan_new_stream(files, rules, folder, keep=("repo",))
        issues = st.new_issues(spark, folder, f"repo string, {schemas.ISSUES}")
        total.append(issues.count())
    assert total == [2, 3, 5]
    assert {(r.repo, r.file_path) for r in issues.collect()} == {("r", "a.js"), ("s", "a.js"), ("r", "b.js")}


def test_ingest_stream_commits_all_tables_of_a_batch(spark, sf):
    folder = shared_folder(spark)
    subs = V.submissions(spark, sf).limit(60)
    subs.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(subs.schema).parquet(f"{folder}/in")
    args = (V.api_keys(spark, sf), V.orgs(spark, sf), V.repos(spark, sf).where("id % 3 = 0"), folder)
    st.ingest_stream(stream, *args)
    assert commits(spark, folder) == [0]
    counts = {name: st.ingested(spark, folder, name).count() for name in st.INGESTED}
    assert counts["scans"] == counts["outbox"] == counts["responses"] > 0 and counts["findings"] > 0
    raw = st.ingested(spark, folder, "scans").where("sarif_json is null or sarif_json not like '%runs%'")
    assert raw.count() == 0
    # later documents of the same repositories add none
    again = spark.read.parquet(f"{folder}/in").withColumn("submission_id", F.concat("submission_id", F.lit("x")))
    again.write.mode("append").parquet(f"{folder}/in")
    st.ingest_stream(spark.readStream.schema(subs.schema).parquet(f"{folder}/in"), *args)
    later = {name: st.ingested(spark, folder, name).count() for name in st.INGESTED}
    assert later["scans"] == 2 * counts["scans"] and later["repositories"] == counts["repositories"]
    assert len(commits(spark, folder)) == 2


@pytest.mark.parametrize("rows", [[], [(1, 2, 3, True, 4)]])
def test_state_of_an_empty_stream(spark, rows):
    folder = shared_folder(spark)
    schema = "repo_id bigint, created_at int, id bigint, passed boolean, findings_count bigint"
    table = st.repo_state_stream(arriving(spark, folder, 0, rows, schema), f"{folder}/state", buckets=4)
    assert [tuple(r) for r in table.read().collect()] == rows


def test_scan_into_reads_the_corpus_twice(spark):
    """Once for the files to scan and once for those that are there now."""
    from lintlake.operators import incremental as inc
    from lintlake.plans.catalog import bundled_rules

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(f"{n}.js", "javascript", f"eval({n})", str(n)) for n in range(20)]
    corpus = spark.createDataFrame(rows, schemas.CORPUS)
    corpus = corpus.mapInArrow(counted, corpus.schema)
    table = KeyedTable(spark, shared_folder(spark), inc.CACHE, ("path",))
    assert inc.scan_into(corpus, bundled_rules(), table, 0, by=("path",)).count() >= 20
    assert read.value <= 40
