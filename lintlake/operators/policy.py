"""Pass or fail of a scan under its organization's policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import scalars as S


def breaks_policy(severity: Column, fail_on: Column) -> Column:
    """The severity is one that fails a scan, in any ASCII case."""
    return F.exists(fail_on, lambda x: S.same_ignoring_case(x, severity))


def passes(levels: Column, fail_on: Column) -> Column:
    """No level of a document fails it."""
    return ~F.exists(levels, lambda x: breaks_policy(x, fail_on))


def evaluate(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """(scan_id, passed, findings_count) for every scan in ``policies``.

    ``policies`` has one row per scan: scan_id and fail_on_severity.  Findings shrink to
    one row per scan and severity before they meet the policies.
    """
    levels = findings.groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    joined = policies.join(levels, "scan_id", "left")
    broken = F.bool_or(breaks_policy(F.col("severity"), F.col("fail_on_severity")))
    return joined.groupBy("scan_id").agg(
        F.coalesce(~broken, F.lit(True)).alias("passed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings_count"),
    )


def scan_policies(scans: DataFrame, repos: DataFrame, orgs: DataFrame) -> DataFrame:
    """The policy of each scan's organization."""
    policy = S.parse_policy(F.col("policy_json"))["fail_on_severity"]
    by_org = orgs.select(F.col("id").alias("org_id"), policy.alias("fail_on_severity"))
    by_repo = repos.select(F.col("id").alias("repo_id"), "org_id").join(by_org, "org_id")
    return scans.select(F.col("id").alias("scan_id"), "repo_id").join(by_repo, "repo_id").select(
        "scan_id", "fail_on_severity"
    )


def responses(verdicts: DataFrame) -> DataFrame:
    """What a submitter is told about each scan."""
    return verdicts.select(
        "scan_id",
        "passed",
        "findings_count",
        F.when(F.col("passed"), "passed").otherwise("failed").alias("status"),
    )
