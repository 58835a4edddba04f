"""Submissions to warehouse tables: accounts, gate, repositories, scans, findings, outbox."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import scalars as S
from lintlake.operators import policy
from lintlake.sources import sarif


def with_org(submissions: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Submissions of known keys with their organization; keys meet as SHA-256 hashes."""
    hashed = submissions.withColumn("key_hash", S.sha256_hex(F.col("key")))
    return hashed.join(api_keys.select("key_hash", "org_id"), "key_hash").drop("key_hash", "key")


def unknown_keys(submissions: DataFrame, api_keys: DataFrame) -> DataFrame:
    hashed = submissions.withColumn("key_hash", S.sha256_hex(F.col("key")))
    return hashed.join(api_keys.select("key_hash"), "key_hash", "left_anti").drop("key_hash")


def repo_key(org_id: Column, repo: Column) -> Column:
    """Id of a repository, the same for the same organization and name."""
    return F.sha2(F.concat_ws("/", org_id.cast("string"), repo), 256)


# Microseconds from year 1 to 1970, so that the number is never negative.
_YEAR_ONE = 62_135_596_800_000_000


def scan_key(submitted_at: Column, submission_id: Column) -> Column:
    """Id of a scan: ids sort by time of submission, and a retry gives the same id."""
    micros = F.unix_micros(submitted_at.cast("timestamp")) + F.lit(_YEAR_ONE)
    at = F.lpad(F.coalesce(micros, F.lit(0)).cast("string"), 18, "0")
    return F.concat_ws("-", at, F.sha2(submission_id, 256))


def repo_upsert(repos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Repositories that are not there yet, one row per (org_id, github_repo)."""
    keys = ["org_id", "github_repo"]
    new = wanted.select(*keys).distinct().join(repos.select(*keys), keys, "left_anti")
    return new.select(repo_key(F.col("org_id"), F.col("github_repo")).alias("id"), *keys)


def outbox(scans: DataFrame) -> DataFrame:
    """Commit status rows for scans that have repo, commit_sha, passed, findings_count."""
    return scans.select(
        "repo",
        "commit_sha",
        F.when(F.col("passed"), "success").otherwise("failure").alias("state"),
        S.status_text(F.col("passed"), F.col("findings_count")).alias("description"),
        F.lit(schemas.STATUS_CONTEXT).alias("context"),
    )


@dataclass(frozen=True)
class Ingested:
    """What a batch of submissions adds; write findings first, then scans."""

    repos: DataFrame
    scans: DataFrame
    findings: DataFrame
    outbox: DataFrame
    responses: DataFrame
    quarantine: DataFrame


def ingest_scans(
    submissions: DataFrame,
    api_keys: DataFrame,
    orgs: DataFrame,
    repos: DataFrame,
    store: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Ingested:
    """Judge a batch of submissions and make the rows it adds.

    The scan id is made from the submission's time and id, so a retried task or batch gives the same
    rows, and the same commit submitted twice is two scans.  A line number beyond 32 bits
    sends its document to quarantine.  All outputs come from the parsed batch: ``store``
    may persist or write it, so that documents are parsed once.
    """
    parsed = sarif.parse_sarif(with_org(submissions, api_keys))
    wide = F.exists("results", lambda x: F.abs(x["line"]) > 2147483647)
    reason = F.coalesce("reason", F.when(wide, F.lit("line number")))
    parsed = store(parsed.withColumn("reason", reason))
    good = sarif.accepted(parsed).withColumn(
        "scan_id", scan_key(F.col("submitted_at"), F.col("submission_id"))
    )
    policies = orgs.select(
        F.col("id").alias("org_id"),
        S.parse_policy(F.col("policy_json"))["fail_on_severity"].alias("fail_on_severity"),
    )
    # a repository that is already there keeps its id
    there = repos.select("org_id", F.col("github_repo").alias("repo"), F.col("id").alias("old_id"))
    levels = F.array_distinct("results.severity")
    judged = (
        good.select(
            "scan_id",
            "org_id",
            "repo",
            "commit_sha",
            "branch",
            "sarif",
            "submitted_at",
            levels.alias("levels"),
            F.size("results").cast("bigint").alias("findings_count"),
        )
        .join(policies, "org_id")
        .withColumn("passed", policy.passes(F.col("levels"), F.col("fail_on_severity")))
    )
    scans = judged.join(there, ["org_id", "repo"], "left").select(
        F.col("scan_id").alias("id"),
        F.coalesce(
            F.col("old_id").cast("string"), repo_key(F.col("org_id"), F.col("repo"))
        ).alias("repo_id"),
        "org_id",
        "repo",
        "commit_sha",
        "branch",
        F.col("sarif").alias("sarif_json"),
        "passed",
        "findings_count",
        F.col("submitted_at").alias("created_at"),
    )
    findings = sarif.findings_of(good, "scan_id", "org_id").select(
        F.concat_ws(
            "-",
            "scan_id",
            F.lpad(F.col("run_no").cast("string"), 6, "0"),
            F.lpad(F.col("result_no").cast("string"), 9, "0"),
        ).alias("id"),
        "scan_id",
        "org_id",
        "rule_id",
        "severity",
        "file_path",
        "line_number",
        "message",
    )
    return Ingested(
        repos=repo_upsert(repos, good.select("org_id", F.col("repo").alias("github_repo"))),
        scans=scans,
        findings=findings,
        # what a submitter is told does not need the repository's id, so no row is moved for it
        outbox=outbox(judged),
        responses=policy.responses(judged),
        quarantine=sarif.quarantined(parsed),
    )


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """Add rows to a table folder; no row is looked up or replaced."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def resolve_rules(orgs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rules text and status per organization.

    ``fetched`` has org_id, outcome (``fresh``, ``not_modified``, ``failed``), yaml and
    etag.  A fresh copy wins; else the cached copy; else the reason there is none.
    """
    j = orgs.join(fetched, orgs["id"] == fetched["org_id"], "left")
    outcome = F.coalesce("outcome", F.lit("failed"))
    fresh = outcome == "fresh"
    yaml = F.when(fresh, F.col("yaml")).otherwise(F.col("rules_cache_yaml"))
    status = (
        F.when(F.col("rules_repo") == "", "404 no rules repository")
        .when(fresh, "200 fresh")
        .when(F.col("rules_cache_yaml").isNotNull(), "200 cached")
        .when(outcome == "not_modified", "500 nothing cached")
        .otherwise("502 fetch failed")
    )
    return j.select(
        orgs["id"].alias("org_id"),
        status.alias("status"),
        F.when(status.startswith("200"), yaml).alias("rules_yaml"),
        F.when(status == "200 fresh", F.col("etag")).alias("etag"),
    )
