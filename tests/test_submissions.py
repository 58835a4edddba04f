"""Submitted documents and what ingest makes of them: how often rows and documents move."""

from pyspark.sql import functions as F

from lintlake.operators import dashboard as D
from lintlake.operators import ingest as ing
from lintlake.plans import queries as q
from lintlake.plans import views as V
from lintlake.sources import sarif
from lintlake.sources.storage import COMPRESSION, stored


def test_a_finding_moves_once(spark, sf):
    plan = V.submissions(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1


def test_rows_told_to_submitters_do_not_meet_repositories(spark, sf):
    """A repository that is listed twice is no second answer to a submission."""
    repos = V.repos(spark, sf)
    got = ing.ingest_scans(
        V.submissions(spark, sf), V.api_keys(spark, sf), V.orgs(spark, sf), repos.unionByName(repos)
    )
    assert got.responses.groupBy("scan_id").count().where("count > 1").isEmpty()
    assert got.outbox.count() == got.responses.count()


def test_stored_tables_are_compressed_well(spark, tmp_path):
    files = stored(spark.range(10), str(tmp_path / "t"), COMPRESSION).inputFiles()
    assert all(f.endswith(".zstd.parquet") for f in files)


def test_few_rows_arrive_in_several_batches(spark, tmp_path):
    stream = q._as_stream(spark, spark.range(100).coalesce(1), str(tmp_path / "in"))
    seen = []
    query = (
        stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count()))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert len(seen) > 1 and sum(seen) == 100


def test_reasons_of_runs_with_missing_parts(spark):
    """The first part that is missing is named, in whichever run and result it is."""
    rule = '{"id":"r","name":"n","shortDescription":{"text":"t"},"defaultConfiguration":{"level":"note"}}'
    place = '{"physicalLocation":{"artifactLocation":{"uri":"f"},"region":{"startLine":1,"startColumn":1}}}'
    result = f'{{"ruleId":"r","message":{{"text":"m"}},"locations":[{place}]}}'

    def run(rules: str = rule, results: str | None = result) -> str:
        driver = f'{{"name":"a","version":"1","informationUri":"u","rules":[{rules}]}}'
        listed = "" if results is None else f',"results":[{results}]'
        return f'{{"tool":{{"driver":{driver}}}{listed}}}'

    cases = {
        run(): None,
        run(results=""): None,
        run() + ",null": "runs",
        run() + ',{"results":[]}': "driver",
        run() + "," + run(rules=rule.replace('"id":"r",', "")): "rule",
        run(rules="null"): "rule",
        run() + "," + run(results=None): "results",
        run(results="null"): "result",
        run(results=result.replace('"message":{"text":"m"}', '"message":{}')): "result",
        run() + "," + run(results=result + "," + result.replace('"uri":"f"', "")): "location",
        run(results=result.replace("[" + place + "]", "[null]")): "location",
        run(results=result.replace('"startColumn":1', '"startColumn":1,"snippet":{}')): "snippet",
    }
    rows = [(f'{{"version":"2.1.0","$schema":"s","runs":[{runs}]}}', want) for runs, want in cases.items()]
    docs = spark.createDataFrame(rows, "sarif string, want string")
    wrong = sarif.parse_sarif(docs).where(~F.col("reason").eqNullSafe(F.col("want")))
    assert wrong.select("sarif", "want", "reason").collect() == []


def test_a_page_reads_the_scans_of_its_organization_only(spark):
    """Scans that name their organization are narrowed before they meet anything."""
    ids = spark.range(10)
    org = (F.col("id") % 9).alias("org_id")
    scans = ids.select("id", F.col("id").alias("repo_id"), org, F.lit(0).alias("created_at"))
    repos = spark.createDataFrame([(n, n % 9, str(n)) for n in range(10)], "id long, org_id long, github_repo string")
    text = ("severity", "rule_id", "file_path", "message")
    findings = ids.select(
        "id", F.col("id").alias("scan_id"), F.lit(1).alias("line_number"), *[F.lit("x").alias(c) for c in text]
    )
    page = D.findings_page(findings, scans, repos, org_id=7)
    assert [r.id for r in page.collect()] == [7]
    assert "% 9) = 7)" in page._jdf.queryExecution().optimizedPlan().toString()
