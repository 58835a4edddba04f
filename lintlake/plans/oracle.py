"""DuckDB SQL that states the expected rows, built from templates and table columns only."""

from __future__ import annotations

from lintlake.plans.catalog import bundled_rules
from lintlake.plans.templates import NOT_MAGIC, TEMPLATES
from lintlake.plans.views import EXTENSION, FILE_IDS, POLICIES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_id(text: str) -> str:
    """Text with ``{id}`` as SQL."""
    parts = text.split("{id}")
    out = lit(parts[0])
    for p in parts[1:]:
        out += " || CAST(event_id AS VARCHAR)" + (f" || {lit(p)}" if p else "")
    return f"({out})"


def bytes_of(text: str) -> str:
    n = text.count("{id}")
    return f"({len(text.replace('{id}', '').encode())} + {n} * strlen(CAST(event_id AS VARCHAR)))"


def lines(lang: str) -> str:
    """CTE body: path, event_id, tpl and the number of lines before the event's own."""
    templates = TEMPLATES[lang]
    count = " ".join(f"WHEN {n} THEN {len(t.lines)}" for n, t in enumerate(templates))
    return (
        f"SELECT 'user_' || user_id || '/' || (event_id // {FILE_IDS}) || '.{EXTENSION[lang]}' AS path, "
        f"event_id, event_id % {len(templates)} AS tpl, "
        f"coalesce(sum(CASE event_id % {len(templates)} {count} END) OVER (PARTITION BY user_id, "
        f"event_id // {FILE_IDS} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line0 "
        "FROM events"
    )


def issues(only: str | None = None) -> str:
    """SELECT with the expected issues of one rule or of all rules."""
    ctes, parts = [], []
    rules = {r.id: r for r in bundled_rules()}
    for lang, templates in TEMPLATES.items():
        selects = []
        for n, t in enumerate(templates):
            for k, (rule, line, before, text) in enumerate(t.hits):
                if only and rule != only:
                    continue
                r = rules[rule]
                tail = text.split("\n")[-1]
                broken = text.count("\n")
                start = f"CAST({bytes_of(before)} + 1 AS INTEGER)"
                end = f"{bytes_of(tail)} + 1" + ("" if broken else f" + {bytes_of(before)}")
                magic = f" AND event_id NOT IN {NOT_MAGIC}" if rule == "js-no-magic-number" else ""
                selects.append(
                    f"SELECT {lit(rule)} AS rule_id, {lit(r.name)} AS rule_name, {lit(r.severity)} AS severity, "
                    f"{lit(r.message)} AS message, path AS file_path, "
                    f"CAST(line0 + {line + 1} AS INTEGER) AS start_line, {start} AS start_column, "
                    f"CAST(line0 + {line + 1 + broken} AS INTEGER) AS end_line, "
                    f"CAST({end} AS INTEGER) AS end_column, {with_id(text)} AS code_snippet, "
                    f"{r.rule_no} AS rule_no, event_id * 100 + {k} AS seq "
                    f"FROM {lang} WHERE tpl = {n}{magic}"
                )
        if selects:
            ctes.append(f"{lang} AS ({lines(lang)})")
            parts += selects
    return f"WITH {', '.join(ctes)}, issues AS ({' UNION ALL '.join(parts)})"


ISSUE_COLUMNS = (
    "rule_id, rule_name, severity, message, file_path, start_line, start_column, end_line, "
    "end_column, code_snippet"
)

_policies = " ".join(f"WHEN {n} THEN {lit(p)}" for n, p in enumerate(POLICIES))
_fails = "CASE n_nationkey % 4 WHEN 1 THEN ['error'] WHEN 2 THEN ['error', 'warning'] ELSE [] END"

STAR = f"""WITH orgs AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS github_org_login,
    CASE n_nationkey % 4 {_policies} END AS policy_json, {_fails} AS fails
  FROM nation),
repos AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS org_id, c_name AS github_repo FROM customer),
raw_scans AS (
  SELECT o_orderkey AS id, o_custkey AS repo_id, sha1(CAST(o_orderkey AS VARCHAR)) AS commit_sha,
    o_orderpriority AS branch, o_orderdate AS created_at FROM orders),
findings AS (
  SELECT strftime(l_shipdate, '%Y%m%d') || '-' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' ||
      lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' ||
      lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS id,
    l_orderkey AS scan_id, 'rule-' || (l_partkey % 37) || '-' || lower(l_returnflag) AS rule_id,
    CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'note' END AS severity,
    'src/' || l_suppkey || '.py' AS file_path, l_linenumber AS line_number, 'part ' || l_partkey AS message
  FROM lineitem),
verdicts AS (
  SELECT s.id AS scan_id, coalesce(NOT bool_or(list_contains(o.fails, f.severity)), true) AS passed,
    count(f.scan_id) AS findings_count
  FROM raw_scans s JOIN repos r ON r.id = s.repo_id JOIN orgs o ON o.id = r.org_id
  LEFT JOIN findings f ON f.scan_id = s.id GROUP BY s.id),
scans AS (SELECT s.*, v.passed FROM raw_scans s JOIN verdicts v ON v.scan_id = s.id),
latest AS (
  SELECT repo_id, max(created_at) AS last_scan_at, arg_max(id, row(created_at, id)) AS scan_id,
    arg_max(passed, row(created_at, id)) AS passed FROM scans GROUP BY repo_id),
counts AS (SELECT scan_id, count(*) AS findings_count FROM findings GROUP BY scan_id),
overview AS (
  SELECT r.org_id, r.github_repo AS repo, l.last_scan_at, l.passed,
    coalesce(c.findings_count, 0) AS findings_count
  FROM repos r LEFT JOIN latest l ON l.repo_id = r.id LEFT JOIN counts c ON c.scan_id = l.scan_id),
page AS (
  SELECT f.id, f.severity, f.rule_id, f.file_path, f.line_number, f.message, r.github_repo AS repo,
    s.created_at AS scan_at, r.org_id,
    CASE f.severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'note' THEN 2 ELSE 3 END AS severity_order
  FROM findings f JOIN raw_scans s ON s.id = f.scan_id JOIN repos r ON r.id = s.repo_id),
submitted AS (
  SELECT s.id, s.id || '-0' AS submission_id, s.commit_sha, s.branch, s.created_at, r.github_repo AS repo,
    r.org_id, s.id % 11 AS kind, o.fails, o.id % 7 <> 6 AS known
  FROM raw_scans s JOIN repos r ON r.id = s.repo_id JOIN orgs o ON o.id = r.org_id),
accepted AS (SELECT *, lpad(CAST(epoch_us(CAST(created_at AS TIMESTAMP)) + 62135596800000000 AS VARCHAR), 18, '0')
    || '-' || sha256(submission_id) AS scan_id FROM submitted WHERE kind <> 3 AND known),
results AS (
  SELECT a.scan_id, a.submission_id, a.org_id, f.rule_id, CASE WHEN a.kind = 5 THEN 'note' ELSE f.severity END AS severity,
    CASE WHEN a.kind = 9 THEN '' ELSE f.file_path END AS file_path,
    CASE WHEN a.kind = 9 THEN NULL ELSE f.line_number END AS line_number, f.message
  FROM accepted a JOIN findings f ON f.scan_id = a.id),
judged AS (
  SELECT a.scan_id, a.submission_id, coalesce(NOT bool_or(list_contains(a.fails, x.severity)), true) AS passed,
    count(x.scan_id) AS findings_count
  FROM accepted a LEFT JOIN results x ON x.scan_id = a.scan_id GROUP BY a.scan_id, a.submission_id)
"""

PAGE_COLUMNS = "id, severity, rule_id, file_path, line_number, message, repo, scan_at"
PAGE_ORDER = "severity_order, id DESC, severity, rule_id, file_path, line_number, message, repo, scan_at"

RULES = """WITH rules AS (
  SELECT CAST(p_partkey AS INTEGER) AS rule_no, 'rule-' || p_partkey AS id, p_name AS name,
    CASE p_size % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS severity,
    CASE p_partkey % 4 WHEN 0 THEN 'javascript' WHEN 1 THEN 'Python' WHEN 2 THEN 'TYPESCRIPT' ELSE 'html' END AS language,
    CASE p_partkey % 5 WHEN 0 THEN 'eval' WHEN 1 THEN 'exec' WHEN 2 THEN 'print' WHEN 3 THEN 'fetch' ELSE 'alert' END AS word,
    p_type AS message
  FROM part)
"""

PAGE_PATH = "'pages/' || page_id || '.html'"
DOC_PATH = (
    "source || '/' || doc_id || '.' || "
    "CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'js' WHEN 'de' THEN 'ts' ELSE 'txt' END"
)
DOC_LANGUAGE = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'typescript' END"
