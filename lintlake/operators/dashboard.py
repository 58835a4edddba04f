"""Dashboard queries over repositories, scans and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import scalars as S


def of_tenant(repos: DataFrame, org_id: int | str) -> DataFrame:
    return repos.where(F.col("org_id") == F.lit(org_id))


def _own(rows: DataFrame, org_id: int | str) -> DataFrame:
    """Where findings or scans name their organization, only its rows are read."""
    return of_tenant(rows, org_id) if "org_id" in rows.columns else rows


def latest_scans(scans: DataFrame) -> DataFrame:
    """Newest scan per repository; equal times are decided by the id.

    An aggregate instead of a ranking window: each task keeps one row per repository
    before the shuffle, so a repository with most of the scans is no hot partition.
    """
    newest = F.max_by(F.struct("id", "created_at", "passed"), F.struct("created_at", "id"))
    return (
        scans.groupBy("repo_id")
        .agg(newest.alias("s"))
        .select(
            "repo_id",
            F.col("s.id").alias("scan_id"),
            F.col("s.created_at").alias("last_scan_at"),
            F.col("s.passed").alias("passed"),
        )
    )


def findings_per_scan(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings_count"))


def latest_scan_counts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Latest scan per repository with the number of its findings (0 when none).

    Findings of other scans are left out first.  The rest is counted per scan before the
    join: each task sends one row per scan it holds, so a scan with most of the findings is
    no hot partition.
    """
    latest = latest_scans(scans)
    counts = findings_per_scan(findings.join(latest.select("scan_id"), "scan_id", "left_semi"))
    return latest.join(counts, "scan_id", "left").withColumn(
        "findings_count", F.coalesce("findings_count", F.lit(0))
    )


def repo_overview(
    repos: DataFrame, scans: DataFrame, findings: DataFrame, org_id: int | str | None = None
) -> DataFrame:
    """Repositories with last scan time, verdict and finding count of the latest scan."""
    if org_id is not None:
        repos = of_tenant(repos, org_id)
        own = repos.select(F.col("id").alias("repo_id"))
        scans = _own(scans, org_id).join(own, "repo_id", "left_semi")
        findings = _own(findings, org_id)
    latest = latest_scan_counts(scans, findings)
    return repos.join(latest, repos["id"] == latest["repo_id"], "left").select(
        F.col("github_repo").alias("repo"),
        "last_scan_at",
        "passed",
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
    )


def ordered_repos(overview: DataFrame) -> DataFrame:
    """Newest first, repositories without a scan last."""
    return overview.orderBy(F.desc_nulls_last("last_scan_at"), "repo")


def findings_with_context(
    findings: DataFrame, scans: DataFrame, repos: DataFrame
) -> DataFrame:
    """Findings with the repository and time of their scan."""
    context = scans.select(
        F.col("id").alias("scan_id"), "repo_id", F.col("created_at").alias("scan_at")
    ).join(
        repos.select(F.col("id").alias("repo_id"), "org_id", F.col("github_repo").alias("repo")),
        "repo_id",
    )
    return findings.drop("org_id").join(context, "scan_id")


def with_severity(findings: DataFrame, severity: str | None) -> DataFrame:
    """Exact match; None is no filter, the empty text is one and fits nothing."""
    return findings if severity is None else findings.where(F.col("severity") == severity)


_PAGE = ("id", "severity", "rule_id", "file_path", "line_number", "message", "repo", "scan_at")


def top_findings(rows: DataFrame, limit: int = schemas.FINDINGS_PAGE_LIMIT) -> DataFrame:
    """Worst severity first, newest first; one top-k pass, no full sort."""
    rest = [F.col(c) for c in _PAGE if c != "id"]
    return rows.orderBy(S.severity_order(F.col("severity")), F.desc("id"), *rest).limit(limit)


def findings_page(
    findings: DataFrame,
    scans: DataFrame,
    repos: DataFrame,
    org_id: int | str | None = None,
    severity: str | None = None,
    limit: int = schemas.FINDINGS_PAGE_LIMIT,
) -> DataFrame:
    if org_id is not None:
        repos = of_tenant(repos, org_id)
        scans, findings = _own(scans, org_id), _own(findings, org_id)
    rows = findings_with_context(with_severity(findings, severity), scans, repos)
    return top_findings(rows.select(*_PAGE), limit)
