"""Scalars, sources, reports, ingest, increments and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import scalars as S
from lintlake.operators import dashboard as D
from lintlake.operators import incremental as inc
from lintlake.operators import ingest as ing
from lintlake.operators import policy, report
from lintlake.operators import scan as sc
from lintlake.plans import queries as q
from lintlake.plans import views as V
from lintlake.plans.catalog import bundled_rules
from lintlake.sources import files as fs
from lintlake.sources import sarif
from lintlake.sources.storage import shared_folder, stored


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_extension_and_language(spark):
    paths = ["test.js", "test.HTML", "test", ".hidden", "x/.hidden", "a.b/c", "a/b.TSX", "x.txt", "a."]
    got = values(
        spark,
        [(p,) for p in paths],
        "p string",
        S.file_extension(F.col("p")),
        S.language_of(F.col("p")),
        S.is_supported_file(F.col("p")),
    )
    assert got == [
        ("js", "javascript", True),
        ("html", "html", True),
        (None, None, False),
        (None, None, False),
        (None, None, False),
        (None, None, False),
        ("tsx", "typescript", True),
        ("txt", None, False),
        ("", None, False),
    ]


def test_snippets(spark):
    text = "line1\nline2\r\nline3\nline4\n"
    rows = [(text, 1, 2), (text, 2, 3), (text, 1, 10), (text, 5, 10), (text, 0, 1), (text, 3, 2), ("", 1, 1)]
    got = values(
        spark, rows, "t string, a int, b int", S.extract_snippet(F.col("t"), F.col("a"), F.col("b"))
    )
    all_lines = "line1\nline2\nline3\nline4"
    expected = ["line1\nline2", "line2\nline3", all_lines, "", "line1", "", ""]
    assert [g[0] for g in got] == expected


@pytest.mark.parametrize(
    ("text", "size", "expected"),
    [
        ("hello", 10, "hello"),
        ("hello world", 8, "hello..."),
        ("a", 3, "a"),
        ("abcd", 2, "..."),
        ("éééé", 7, "éééé..."),
    ],
)
def test_truncate(spark, text, size, expected):
    assert values(spark, [(text,)], "t string", S.truncate(F.col("t"), size)) == [(expected,)]


def test_policies(spark):
    for text, fails, block in q._POLICY_TEXTS:
        parsed = S.parse_policy(F.col("t"))
        got = values(spark, [(text,)], "t string", parsed["fail_on_severity"], parsed["block_merge"])
        assert got == [(fails, block)], text


def test_folders_and_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "k=v").mkdir()
    (tmp_path / "k=v" / "d.ts").write_text("let a: any")
    (tmp_path / "a.js").write_text("eval(1)")
    (tmp_path / "sub" / "b.py").write_text("eval(1)")
    (tmp_path / "c.txt").write_text("eval(1)")
    (tmp_path / "bad.js").write_bytes(b"eval(1) \xff")

    def names(df):
        return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())

    assert names(fs.scan_dir(spark, str(tmp_path))) == ["a.js"]
    assert names(fs.scan_dir(spark, str(tmp_path), recursive=True)) == ["a.js", "b.py", "d.ts"]
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in fs.rejects(spark, str(tmp_path)).collect()}
    assert reasons == {"c.txt": "unsupported extension", "bad.js": "not UTF-8"}
    assert names(fs.scan_path(spark, str(tmp_path / "a.js"))) == ["a.js"]
    assert names(fs.scan_path(spark, str(tmp_path), True)) == ["a.js", "b.py", "d.ts"]
    for bad in ("c.txt", "bad.js"):
        with pytest.raises(Exception, match="unsupported|UTF-8"):
            fs.scan_path(spark, str(tmp_path / bad)).collect()
    with pytest.raises(FileNotFoundError):
        fs.scan_path(spark, str(tmp_path / "none"))


def _issues(spark, text="eval(1);\nconsole.log(2);\neval(3)"):
    rows = [("a.js", "javascript", text, "")]
    return sc.scan_all(spark.createDataFrame(rows, schemas.CORPUS), bundled_rules())


def test_sarif_document(spark):
    doc = json.loads(report.to_sarif(_issues(spark)).collect()[0].sarif)
    assert doc["version"] == "2.1.0" and len(doc["runs"]) == 1
    run = doc["runs"][0]
    # rule order of the catalog, results in issue order, no level on results
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == [
        "js-no-console-log",
        "js-no-console-any",
        "js-no-eval",
        "team-no-console-log",
    ]
    assert [r["ruleId"] for r in run["results"]] == (
        ["js-no-console-log"] * 2 + ["js-no-console-any"] + ["js-no-eval"] * 2
        + ["team-no-console-log"] * 2
    )
    assert set(run["results"][0]) == {"ruleId", "message", "locations"}
    region = run["results"][4]["locations"][0]["physicalLocation"]["region"]
    assert region == {
        "startLine": 3, "startColumn": 1, "endLine": 3, "endColumn": 5, "snippet": {"text": "eval"},
    }


def _joined(lines):
    return "".join(r.text for r in lines.collect())


def test_empty_reports_and_exit_status(spark):
    none = _issues(spark, "ok()")
    assert json.loads(_joined(report.sarif_lines(none)))["runs"][0]["results"] == []
    assert json.loads(_joined(report.json_lines(none))) == {"version": "1.0.0", "issues": []}
    assert report.exit_status(none).collect()[0].exit_status == 0
    assert report.exit_status(_issues(spark)).collect()[0].exit_status == 1


def test_lines_and_value_are_the_same_document(spark):
    issues = _issues(spark)
    assert json.loads(_joined(report.sarif_lines(issues))) == json.loads(
        report.to_sarif(issues).collect()[0].sarif
    )
    assert json.loads(_joined(report.json_lines(issues))) == json.loads(
        report.to_json_report(issues).collect()[0].report
    )


def test_large_report_is_one_document_in_order(spark, tmp_path):
    n = 100_000
    issues = spark.range(n).selectExpr(
        "'r' as rule_id", "'r' as rule_name", "'note' as severity", "'m' as message",
        "if(id % 3 = 0, null, concat('f', id % 50)) as file_path", "cast(id as int) as start_line",
        "1 as start_column", "cast(id as int) as end_line", "2 as end_column", "'x' as code_snippet",
        "0 as rule_no", "cast(id as int) as fact_no", "0 as cap_no",
    )
    # a repeated row stays
    issues = stored(issues.unionByName(issues.limit(1)), f"{tmp_path}/issues")
    report.write_lines(report.sarif_lines(issues), f"{tmp_path}/report")
    files = sorted(p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-"))
    doc = json.loads("".join(p.read_text() for p in files))
    results = doc["runs"][0]["results"]
    places = [x["locations"][0]["physicalLocation"] for x in results]
    order = [(p["artifactLocation"].get("uri", ""), p["region"]["startLine"]) for p in places]
    assert len(results) == n + 1 and order == sorted(order)
    assert len(doc["runs"][0]["tool"]["driver"]["rules"]) == 1


def test_lines_of_groups(spark):
    issues = _issues(spark).withColumn("repo", F.when(F.col("rule_id").startswith("js-"), "a"))
    texts = {}
    for r in report.json_lines(issues, by=["repo"]).collect():
        texts[r.repo] = texts.get(r.repo, "") + r.text
    sizes = {k: len(json.loads(v)["issues"]) for k, v in texts.items()}
    assert sizes == {"a": 5, None: 2}


def _doc(results, rules, **extra):
    driver = {"name": "t", "version": "1", "informationUri": "u", "rules": rules}
    doc = {"version": "2.1.0", "$schema": "s", "runs": [{"tool": {"driver": driver}, "results": results}]}
    return {**doc, **extra}


def _rule(rule_id, level):
    return {
        "id": rule_id, "name": "n", "shortDescription": {"text": "t"},
        "defaultConfiguration": {"level": level},
    }


def _result(rule_id, line=1, **region):
    where = {"artifactLocation": {"uri": "f"}, "region": {"startLine": line, "startColumn": 1, **region}}
    return {"ruleId": rule_id, "message": {"text": "m"}, "locations": [{"physicalLocation": where}]}


def _read(spark, *docs):
    rows = [(str(n), d if isinstance(d, str) else json.dumps(d)) for n, d in enumerate(docs)]
    return sarif.parse_sarif(spark.createDataFrame(rows, "id string, sarif string"))


def test_levels_and_locations(spark):
    rules = [_rule("a", "none"), _rule("b", "warning"), _rule("a", "error")]
    bare = {"ruleId": "b", "message": {"text": "m"}, "locations": []}
    doc = _doc([_result("a"), _result("x", 7), bare], rules)
    rows = sarif.findings_of(sarif.accepted(_read(spark, doc))).orderBy("result_no").collect()
    assert [(r.severity, r.file_path, r.line_number) for r in rows] == [
        ("error", "f", 1), ("note", "f", 7), ("warning", "", None),
    ]


def test_strict_documents(spark):
    good = _doc([_result("a")], [_rule("a", "error")])
    no_region = json.loads(json.dumps(good))
    del no_region["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]
    no_rules = json.loads(json.dumps(good))
    del no_rules["runs"][0]["tool"]["driver"]["rules"]
    no_level = _doc([], [{**_rule("a", "x"), "defaultConfiguration": {}}])
    no_version = {k: v for k, v in good.items() if k != "version"}
    snippet = _doc([_result("a", snippet={})], [])
    docs = [good, _doc([], []), no_region, no_rules, no_level, no_version, "{", "[]", snippet]
    reasons = [r.reason for r in _read(spark, *docs).orderBy("id").collect()]
    assert reasons[:2] == [None, None]
    assert reasons[2:6] == ["location", "driver", "rule", "version"]
    assert all(reasons[6:])


def test_ingest_keeps_resubmissions_and_quarantines_wide_lines(spark):
    key = "k"
    orgs = spark.createDataFrame([(1, '{"fail_on_severity":["ERROR"]}')], "id bigint, policy_json string")
    keys = spark.createDataFrame([(key, 1)], "k string, org_id bigint").select(
        F.sha2("k", 256).alias("key_hash"), "org_id"
    )
    repos = spark.createDataFrame([(9, 1, "o/old")], "id bigint, org_id bigint, github_repo string")
    bad = json.dumps(_doc([_result("a")], [_rule("a", "error")]))
    wide = json.dumps(_doc([_result("a", 2**31)], []))
    now = datetime(2024, 1, 1)
    rows = [
        ("s1", key, bad, "o/new", "c", None, now),
        ("s2", key, bad, "o/new", "c", None, now),
        ("s3", key, json.dumps(_doc([], [])), "o/old", "c", "b", now),
        ("s4", key, wide, "o/old", "c", "b", now),
        ("s5", "unknown", bad, "o/x", "c", "b", now),
    ]
    subs = spark.createDataFrame(rows, schemas.SUBMISSIONS)
    out = ing.ingest_scans(subs, keys, orgs, repos)
    scans = out.scans.collect()
    assert sorted((s.repo, s.passed, s.findings_count) for s in scans) == [
        ("o/new", False, 1), ("o/new", False, 1), ("o/old", True, 0),
    ]
    assert [s.repo_id for s in scans if s.repo == "o/old"] == ["9"]
    assert [r.github_repo for r in out.repos.collect()] == ["o/new"]
    assert out.findings.count() == 2
    assert [(r.submission_id, r.reason) for r in out.quarantine.collect()] == [("s4", "line number")]
    assert {r.description for r in out.outbox.collect()} == {
        "Scan failed — 1 finding(s)", "Scan passed — 0 finding(s)",
    }
    again = ing.repo_upsert(
        repos.select("org_id", "github_repo").unionByName(out.repos.select("org_id", "github_repo")),
        out.scans.select("org_id", F.col("repo").alias("github_repo")),
    )
    assert again.count() == 0


def test_gate_ignores_case_and_keeps_scans_without_findings(spark):
    findings = spark.createDataFrame([(1, "Error"), (2, "note")], "scan_id int, severity string")
    policies = spark.createDataFrame(
        [(1, ["eRROR"]), (2, ["error"]), (3, ["error"])], "scan_id int, fail_on_severity array<string>"
    )
    got = policy.evaluate(findings, policies).orderBy("scan_id").collect()
    assert [(r.passed, r.findings_count) for r in got] == [(False, 1), (True, 1), (True, 0)]


def test_incremental_scan_equals_full_scan_and_reuses(spark, sf):
    rules = bundled_rules().for_language("javascript")
    code = V.code_corpus(spark, sf, "javascript")
    folder = shared_folder(spark)
    empty = spark.createDataFrame([], inc.CACHE)
    first, entries = inc.incremental_scan(code, rules, empty, lambda d: stored(d, f"{folder}/a"))
    full = sc.scan_all(code, rules)
    assert sorted(map(repr, first.collect())) == sorted(map(repr, full.collect()))
    again, new = inc.incremental_scan(code, rules, entries)
    assert new.count() == 0 and again.count() == first.count()
    other = bundled_rules().only("js-no-eval")
    _, rescanned = inc.incremental_scan(code, other, entries)
    assert rescanned.count() == code.count()


def test_incremental_scan_keeps_files_of_one_path_apart(spark):
    rules = bundled_rules().only("js-no-eval")
    rows = [("a.js", "javascript", t, str(k)) for k, t in ((1, "eval(1)"), (2, "f();eval(2);eval(3)"), (1, "eval(1)"))]
    code = spark.createDataFrame(rows, schemas.CORPUS)
    full = sorted(map(repr, sc.scan_all(code, rules).collect()))
    folder = shared_folder(spark)
    empty = spark.createDataFrame([], inc.CACHE)
    first, entries = inc.incremental_scan(code, rules, empty, lambda d: stored(d, f"{folder}/a"))
    assert sorted(map(repr, first.collect())) == full and entries.count() == 2
    table = stored(inc.put(empty, entries, by=("path",)), f"{folder}/table")
    late = code.unionByName(spark.createDataFrame([("b.js", "javascript", "eval(4)", "4")], schemas.CORPUS))
    again, new = inc.incremental_scan(late, rules, table)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, sc.scan_all(late, rules).collect()))
    assert new.count() == 1


def test_overview_reads_only_what_it_counts(spark, tmp_path):
    repos = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id int, org_id int, github_repo string")
    t = datetime(2024, 1, 1)
    scans = spark.createDataFrame(
        [(1, 1, t, True), (2, 2, t, False)], "id int, repo_id int, created_at timestamp, passed boolean"
    )
    findings = spark.createDataFrame(
        [("x", 1, 1, "note", "r", "f", 1, "m"), ("y", 2, 2, "note", "r", "f", 1, "m")],
        "id string, scan_id int, org_id int, severity string, rule_id string, file_path string, line_number int, message string",
    )
    ing.append(findings, f"{tmp_path}/f", "org_id")
    kept = spark.read.schema(findings.schema).parquet(f"{tmp_path}/f")
    for rows in (D.repo_overview(repos, scans, kept, 1), D.findings_page(kept, scans, repos, 1)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(org_id" in plan
        assert [r.repo for r in rows.collect()] == ["a"]


def test_overview_ties_and_repositories_without_scans(spark):
    repos = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "id int, org_id int, github_repo string")
    t = datetime(2024, 1, 1)
    scans = spark.createDataFrame(
        [(1, 1, t, True), (2, 1, t, False)], "id int, repo_id int, created_at timestamp, passed boolean"
    )
    findings = spark.createDataFrame([(2,), (2,), (1,)], "scan_id int")
    for org in (1, None):
        rows = D.ordered_repos(D.repo_overview(repos, scans, findings, org)).collect()
        got = [(r.repo, r.passed, r.findings_count) for r in rows]
        assert got[:2] == [("a", False, 2), ("b", None, 0)]
        assert len(got) == (2 if org else 3)


SAMPLE = (
    "st_ingest st_gate st_scan st_inc st_repo_state scan_all findings_page repo_overview "
    "ingest_findings sink_sarif s_policy_parse findings_page_ingested sink_sarif_whole "
    "inc_scan rule_problems j_file_regex sink_json st_ingest_repos st_ingest_scans st_ingest_outbox "
    "st_ingest_quarantine src_scan_flat src_rejects src_rules_yaml sink_scans o_issues facts_python_ast"
).split()


@pytest.mark.parametrize("name", SAMPLE)
def test_registered_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "pages", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = q.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({q.ORACLE[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", ["findings_page_clustered", "findings_page_compacted"])
def test_page_tables_equal_their_sql(spark, sf, name):
    test_registered_query_equals_its_sql(spark, sf, name)


def test_every_query_has_expected_rows():
    assert set(q.QUERIES) == set(q.ORACLE)
