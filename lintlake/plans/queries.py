"""One registered query per operator, with the SQL that states its expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import scalars as S
from lintlake.operators import dashboard as D
from lintlake.operators import incremental as inc
from lintlake.operators import ingest as ing
from lintlake.operators import policy, report
from lintlake.operators import scan as sc
from lintlake.operators import tokens as tk
from lintlake.plans import oracle as O
from lintlake.plans import views as V
from lintlake.plans.catalog import bundled_rules, documented_settimeout
from lintlake.sources import files as fs
from lintlake.sources import rules as R
from lintlake.sources import sarif
from lintlake.sources.pages import PageTable
from lintlake.sources.storage import COMPRESSION, shared_folder, stored
from lintlake.sources.versioned import KeyedTable
from lintlake.streaming import stream as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


_ISSUE = list(schemas.ISSUE_COLUMNS)
_BASE = {r.id: r for r in bundled_rules()}


# --- scanning ------------------------------------------------------------------------


def _rule_query(rule_id: str) -> None:
    rule = _BASE[rule_id]

    @query(rule_id, f"{O.issues(rule_id)} SELECT {O.ISSUE_COLUMNS} FROM issues")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return sc.scan_rule(V.code_corpus(spark, sf, rule.language), rule).select(*_ISSUE)


for _id in _BASE:
    _rule_query(_id)

_ALL = O.issues()


@query("scan_all", f"{_ALL} SELECT {O.ISSUE_COLUMNS} FROM issues")
def scan_all(spark, sf):
    return sc.scan_all(V.all_code(spark, sf), bundled_rules()).select(*_ISSUE)


@query("scan_rule", f"{O.issues('js-no-eval')} SELECT {O.ISSUE_COLUMNS} FROM issues")
def scan_rule(spark, sf):
    return sc.scan_rule(V.code_corpus(spark, sf, "javascript"), _BASE["js-no-eval"]).select(*_ISSUE)


@query(
    "o_issues",
    f"{_ALL} SELECT file_path, start_line, start_column, rule_id, CAST(row_number() OVER (PARTITION BY file_path "
    "ORDER BY rule_no, start_line, start_column) AS INTEGER) AS position FROM issues",
)
def o_issues(spark, sf):
    """Position in the report of each file: a file's issues are as many as its text allows."""
    issues = report.ordered_issues(sc.scan_all(V.all_code(spark, sf), bundled_rules()))
    order = Window.partitionBy("file_path").orderBy(*schemas.ISSUE_ORDER)
    return issues.select(
        "file_path", "start_line", "start_column", "rule_id", F.row_number().over(order).alias("position")
    )


@query(
    "u_issues",
    f"{_ALL} SELECT severity, rule_id, count(*) AS issues, count(DISTINCT file_path) AS files FROM issues GROUP BY ALL",
)
def u_issues(spark, sf):
    """Bag union over files and rules: overlapping rules both report."""
    issues = sc.scan_all(V.all_code(spark, sf), bundled_rules())
    return issues.groupBy("severity", "rule_id").agg(
        F.count(F.lit(1)).alias("issues"), F.countDistinct("file_path").alias("files")
    )


@query(
    "scan_custom",
    "WITH s AS (SELECT page_id, CASE WHEN position('<div class=\"ad\">' IN html) > 0 THEN 1 ELSE 0 END AS ads, "
    "len(regexp_extract_all(html, '<a href=\"/[^\"]*\"')) AS links FROM pages) "
    "SELECT 'page-ad' AS rule_id, CAST(sum(ads * 2) AS BIGINT) AS issues FROM s UNION ALL "
    "SELECT 'page-local-link', CAST(sum(links) AS BIGINT) FROM s",
)
def scan_custom(spark, sf):
    rules = R.parse_rules(_PAGE_RULES)
    issues = sc.scan_all(V.page_corpus(spark, sf), rules)
    return issues.groupBy("rule_id").agg(F.count(F.lit(1)).alias("issues"))


_PAGE_RULES = """
rules:
  - id: page-ad
    name: Advertisement
    severity: note
    language: HTML
    message: A block marked as an advertisement
    query: {shape: html_attr_quoted, where: [{capture: attr, op: eq, value: class}, {capture: val, op: eq, value: ad}]}
  - id: page-local-link
    name: Local link
    severity: note
    language: html
    message: A link inside the site
    query:
      shape: html_attr_quoted
      where: [{capture: attr, op: eq, value: href}, {capture: val, op: match, value: "^/"}]
      report: [val]
"""


_CALL_TEMPLATES = {
    "javascript": ((3, "eval"), (9, "alert"), (11, "fetch")),
    "typescript": (),
    "python": ((0, "print"), (1, "eval"), (3, "exec")),
}


def _calls() -> str:
    """CTEs: the calls that the templates hold."""
    found = [
        f"SELECT '{lang}' AS language, path, '{word}' AS word FROM {lang} WHERE tpl = {n}"
        for lang, calls in _CALL_TEMPLATES.items()
        for n, word in calls
    ]
    lines = [f"{lang} AS ({O.lines(lang)})" for lang, calls in _CALL_TEMPLATES.items() if calls]
    return f"{', '.join(lines)}, calls AS ({' UNION ALL '.join(found)})"


@query(
    "j_file_rule",
    O.RULES
    + f", {_calls()} SELECT r.id AS rule_id, r.severity, count(*) AS issues, count(DISTINCT path) AS files "
    "FROM calls c JOIN rules r ON lower(r.language) = c.language AND r.word = c.word GROUP BY ALL",
)
def j_file_rule(spark, sf):
    """A rule table of any size: matches meet searches, counts meet the rules."""
    counts = sc.rule_issue_counts(V.all_code(spark, sf), V.rule_table(spark, sf))
    return counts.select("rule_id", "severity", "issues", "files")


@query(
    "j_file_regex",
    O.RULES
    + f", {_calls()} SELECT r.id AS rule_id, r.severity, count(*) AS issues, count(DISTINCT path) AS files "
    "FROM calls c JOIN rules r ON lower(r.language) = c.language AND r.word = c.word WHERE r.rule_no % 100 = 0 GROUP BY ALL",
)
def j_file_regex(spark, sf):
    """A table of regex rules, no two alike: a regex is tried where a match has its literal."""
    counts = sc.rule_issue_counts(V.all_code(spark, sf), V.regex_rule_table(spark, sf))
    return counts.select("rule_id", "severity", "issues", "files")


@query(
    "rule_problems",
    O.RULES
    + "SELECT id AS rule_id, CASE rule_no % 7 WHEN 1 THEN 'unknown test like' WHEN 2 THEN 'bad pattern (' "
    "WHEN 3 THEN 'unknown shape no_shape' WHEN 4 THEN 'unknown capture fnn' WHEN 5 THEN 'shape jsx_attr does not exist in ' || language END AS problem "
    "FROM rules WHERE language <> 'html' AND rule_no % 7 BETWEEN 1 AND 5 AND NOT (language = 'javascript' AND rule_no % 7 = 5)",
)
def rule_problems(spark, sf):
    """Why rules of a table cannot run; the others run."""
    bad = sc.with_problems(V.odd_rule_table(spark, sf)).where("problem is not null")
    return bad.where("lower(language) <> 'html'").select(F.col("id").alias("rule_id"), "problem")


def _fact_columns(found: DataFrame, *names: str) -> DataFrame:
    def text(name):
        return F.get(F.filter("caps", lambda c: c["name"] == name), F.lit(0))["text"]

    first = F.get("caps", F.lit(0))
    return found.select(
        "path",
        first["start_line"].alias("start_line"),
        first["start_column"].alias("start_column"),
        *[text(n).alias(n) for n in names],
    )


_JS = f"WITH l AS ({O.lines('javascript')}) "


@query(
    "q_run",
    _JS + "SELECT path, CAST(line0 + 1 AS INTEGER) AS start_line, CAST(CASE s.k WHEN 1 THEN 1 ELSE 19 + strlen(CAST(event_id AS VARCHAR)) END AS INTEGER) AS start_column, "
    "'document' AS obj, CASE s.k WHEN 1 THEN 'write' ELSE 'writeln' END AS prop, '(' || event_id || ')' AS args "
    "FROM l, (VALUES (1), (2)) s(k) WHERE tpl = 4",
)
def q_run(spark, sf):
    spec = sc.pattern("member_call", ("obj", "eq", "document"))
    return _fact_columns(
        sc.run_pattern(V.code_corpus(spark, sf, "javascript"), spec), "obj", "prop", "args"
    )


@query(
    "q_once",
    _JS + "SELECT path, CAST(min(line0) + 1 AS INTEGER) AS start_line, 1 AS start_column, 'document' AS obj, 'write' AS prop "
    "FROM l WHERE tpl = 4 GROUP BY path",
)
def q_once(spark, sf):
    spec = sc.pattern("member_call", ("obj", "eq", "document"))
    return _fact_columns(
        sc.run_pattern_once(V.code_corpus(spark, sf, "javascript"), spec), "obj", "prop"
    )


@query(
    "q_captures",
    _JS + "SELECT path, CAST(line0 + 1 AS INTEGER) AS start_line, "
    "CAST(CASE s.k WHEN 1 THEN 10 ELSE 28 + strlen(CAST(event_id AS VARCHAR)) END AS INTEGER) AS start_column, "
    "CASE s.k WHEN 1 THEN 'write' ELSE 'writeln' END AS text FROM l, (VALUES (1), (2)) s(k) WHERE tpl = 4",
)
def q_captures(spark, sf):
    spec = sc.pattern("member_call", ("obj", "eq", "document"))
    found = sc.captures(V.code_corpus(spark, sf, "javascript"), spec, "prop")
    return found.select("path", "start_line", "start_column", "text")


@query(
    "facts_token_rows",
    f"SELECT path, CAST(bytes AS BIGINT) AS bytes, breaks + 1 AS lines, true AS gapless FROM ("
    f"SELECT {O.DOC_PATH} AS path, {O.DOC_LANGUAGE} AS language, strlen(text) AS bytes, "
    "strlen(text) - strlen(replace(text, chr(10), '')) AS breaks FROM documents) "
    "WHERE language IS NOT NULL AND bytes > 0",
)
def facts_token_rows(spark, sf):
    """Tokens as rows; texts over 2,000 bytes are cut into pieces, which many tasks read."""
    rows = tk.token_rows(V.doc_corpus(spark, sf), long_bytes=2000, piece_tokens=64)
    own = F.octet_length("text")
    files = rows.groupBy("path").agg(
        F.sum(own).alias("bytes"),
        F.max(F.col("at") + own).alias("end"),
        F.count(F.lit(1)).alias("n"),
        F.max("token_no").alias("last"),
        F.max(F.col("line") + tk.newlines(F.col("text"))).alias("lines"),  # numbers only: rows are not sorted
    )
    return files.select(
        "path",
        "bytes",
        F.col("lines").cast("bigint").alias("lines"),
        ((F.col("n") == F.col("last") + 1) & (F.col("end") == F.col("bytes"))).alias("gapless"),
    )


@query(
    "facts_tokens",
    f"SELECT path, language, CAST(bytes AS BIGINT) AS bytes, true AS whole FROM ("
    f"SELECT {O.DOC_PATH} AS path, {O.DOC_LANGUAGE} AS language, strlen(text) AS bytes FROM documents) "
    "WHERE language IS NOT NULL",
)
def facts_tokens(spark, sf):
    """Tokens cover a text whole: their concatenation is the text."""
    out = None
    corpus = V.doc_corpus(spark, sf)
    for lang in ("javascript", "typescript", "python"):
        texts = corpus.where(F.col("language") == lang)
        cut = texts.select("path", "language", "src", tk.code_tokens(F.col("src"), lang).alias("tok"))
        joined = F.array_join("tok", "")
        part = cut.select(
            "path",
            "language",
            F.octet_length(joined).cast("bigint").alias("bytes"),
            (joined == F.col("src")).alias("whole"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "facts_shapes",
    _JS + ", n AS (SELECT * FROM (VALUES (3, 'call', 1), (15, 'catch_empty', 1), (6, 'stmt_keyword', 1), "
    "(14, 'call_template_arg', 2), (12, 'import_source', 2), (10, 'jsx_attr', 1)) v(tpl, shape, k)) "
    "SELECT n.shape, CAST(sum(n.k) AS BIGINT) AS facts FROM l JOIN n ON n.tpl = l.tpl GROUP BY n.shape",
)
def facts_shapes(spark, sf):
    wanted = {
        ("javascript", "call"): [sc.pattern("call", ("fn", "eq", "eval"))[1]],
        **{
            ("javascript", s): [()]
            for s in ("catch_empty", "stmt_keyword", "call_template_arg", "import_source", "jsx_attr")
        },
    }
    found = sc.facts_of(V.code_corpus(spark, sf, "javascript"), wanted)
    return found.groupBy("shape").agg(F.count(F.lit(1)).alias("facts"))


@query(
    "facts_html",
    "WITH body AS (SELECT regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'gs') AS b, html FROM pages), "
    "n AS (SELECT unnest(regexp_extract_all(b, '([a-z]+)=\"', 1)) AS name FROM body) "
    "SELECT 'html_attr' AS shape, name, count(*) AS facts FROM n GROUP BY name UNION ALL "
    "SELECT 'html_comment', '', CAST(sum(len(regexp_extract_all(html, '<!--'))) AS BIGINT) FROM pages UNION ALL "
    "SELECT 'html_tag', t, count(*) FROM (SELECT unnest(regexp_extract_all(b, '<([a-z0-9]+)', 1)) AS t FROM body "
    "UNION ALL SELECT unnest(regexp_extract_all(html, '<(script|style)>', 1)) FROM pages) GROUP BY t",
)
def facts_html(spark, sf):
    wanted = {("html", s): [()] for s in ("html_attr", "html_comment", "html_tag")}
    found = sc.facts_of(V.page_corpus(spark, sf), wanted)
    name = F.when(F.col("shape") == "html_comment", "").otherwise(F.get("caps", F.lit(0))["text"])
    return found.groupBy("shape", name.alias("name")).agg(F.count(F.lit(1)).alias("facts"))


_PY_STATEMENTS = "rule_id IN ('py-no-bare-except', 'py-no-assert-in-production', 'py-no-global-statement')"


@query(
    "facts_python_ast",
    f"{_ALL} SELECT file_path AS path, CASE rule_id WHEN 'py-no-bare-except' THEN 'except_bare' ELSE 'stmt_keyword' END AS shape, "
    f"start_line, start_column, end_line, end_column, code_snippet AS text FROM issues WHERE {_PY_STATEMENTS}",
)
def facts_python_ast(spark, sf):
    """Python statements with their whole spans, from the token shapes."""
    wanted = {("python", "except_bare"): [()], ("python", "stmt_keyword"): [()]}
    found = sc.facts_of(V.code_corpus(spark, sf, "python"), wanted)
    c = F.get("caps", F.lit(0))
    fields = ("start_line", "start_column", "end_line", "end_column", "text")
    return found.select("path", "shape", *[c[f].alias(f) for f in fields])


_LINES = (
    "CASE WHEN len(parts) > 0 AND parts[-1] = '' THEN parts[:len(parts) - 1] ELSE parts END"
)


@query(
    "facts_lines",
    f"WITH d AS (SELECT {O.DOC_PATH} AS path, string_split_regex(text, '\\r?\\n') AS parts FROM documents), "
    f"l AS (SELECT path, {_LINES} AS lines FROM d), n AS (SELECT path, lines, unnest(range(1, len(lines) + 1)) AS k FROM l) "
    "SELECT path, CAST(k AS INTEGER) AS line_no, CAST(strlen(lines[k]) AS INTEGER) AS bytes, lines[k] AS text FROM n",
)
def facts_lines(spark, sf):
    return fs.line_facts(V.doc_corpus(spark, sf))


@query(
    "pr_eq",
    _JS + "SELECT path, CAST(line0 + 1 AS INTEGER) AS start_line FROM l WHERE tpl = 3",
)
def pr_eq(spark, sf):
    spec = sc.pattern("call", ("fn", "eq", "eval"))
    return _fact_columns(sc.run_pattern(V.code_corpus(spark, sf, "javascript"), spec)).drop("start_column")


@query(
    "pr_match",
    _JS + ", x AS (SELECT path, line0, event_id FROM l WHERE tpl IN (0, 1)) "
    "SELECT path, CAST(line0 + 1 AS INTEGER) AS start_line, CAST(event_id AS VARCHAR) AS num FROM x "
    "WHERE regexp_matches(CAST(event_id AS VARCHAR), '7[0-4]')",
)
def pr_match(spark, sf):
    spec = sc.pattern("declarator_number", ("num", "match", "7[0-4]"))
    found = sc.run_pattern(V.code_corpus(spark, sf, "javascript"), spec)
    return _fact_columns(found, "num").drop("start_column")


@query(
    "pr_not_match",
    _JS + ", x AS (SELECT path, line0, event_id FROM l WHERE tpl IN (0, 1)) "
    "SELECT path, CAST(line0 + 1 AS INTEGER) AS start_line, CAST(event_id AS VARCHAR) AS num FROM x WHERE event_id NOT IN (0, 1)",
)
def pr_not_match(spark, sf):
    spec = sc.pattern("declarator_number", ("num", "not_match", "^(0|1|-1)$"))
    found = sc.run_pattern(V.code_corpus(spark, sf, "javascript"), spec)
    return _fact_columns(found, "num").drop("start_column")


_PY = f"WITH l AS ({O.lines('python')}) "


@query("pr_no_field", _PY + "SELECT path, CAST(line0 + 3 AS INTEGER) AS start_line FROM l WHERE tpl = 6")
def pr_no_field(spark, sf):
    """A clause without the type field."""
    found = sc.run_pattern(V.code_corpus(spark, sf, "python"), sc.pattern("except_bare"))
    return _fact_columns(found).drop("start_column")


@query(
    "pr_anchor",
    _JS + "SELECT path, CAST(line0 + 1 AS INTEGER) AS start_line, s.fn FROM l, (VALUES ('setTimeout'), ('setInterval')) s(fn) WHERE tpl = 8 "
    "UNION ALL SELECT path, CAST(line0 + 1 AS INTEGER), 'eval' FROM l WHERE tpl = 3 UNION ALL "
    "SELECT path, CAST(line0 + 1 AS INTEGER), 'confirm' FROM l WHERE tpl = 9 UNION ALL "
    "SELECT path, CAST(line0 + 1 AS INTEGER), 'fetch' FROM l WHERE tpl = 11",
)
def pr_anchor(spark, sf):
    """The string is the last argument."""
    found = sc.run_pattern(V.code_corpus(spark, sf, "javascript"), sc.pattern("call_last_arg_string"))
    return _fact_columns(found, "fn").drop("start_column")


@query(
    "pr_nested",
    _JS + "SELECT path, CAST(line0 + 1 AS INTEGER) AS start_line, 'process' AS obj, 'env' AS prop FROM l WHERE tpl = 13",
)
def pr_nested(spark, sf):
    """A member of a member."""
    spec = sc.pattern("member_chain", ("obj", "eq", "process"))
    found = sc.run_pattern(V.code_corpus(spark, sf, "javascript"), spec)
    return _fact_columns(found, "obj", "prop").drop("start_column")


@query(
    "pr_optional",
    _JS + "SELECT path, 'console' AS obj, CASE tpl WHEN 16 THEN '\"é\"' END AS arg FROM l WHERE tpl IN (2, 16)",
)
def pr_optional(spark, sf):
    """A capture that is there only when the first argument is a string."""
    spec = sc.pattern("member_call", ("obj", "eq", "console"))
    found = sc.run_pattern(V.code_corpus(spark, sf, "javascript"), spec)
    return _fact_columns(found, "obj", "arg").drop("start_line", "start_column")


@query(
    "p_capture_to_issue",
    f"{O.issues('js-no-console-log')} SELECT file_path, start_line, start_column, end_line, end_column, code_snippet FROM issues",
)
def p_capture_to_issue(spark, sf):
    rule = _BASE["js-no-console-log"]
    issues = sc.scan_rule(V.code_corpus(spark, sf, "javascript"), rule)
    return issues.select(*[c for c in _ISSUE if not c.startswith(("rule", "sev", "mess"))])


@query(
    "call_first_arg_string",
    _JS + "SELECT path, CAST(line0 + 1 AS INTEGER) AS start_line, count(*) AS n FROM l, (VALUES (1), (2)) s(k) WHERE tpl = 8 GROUP BY ALL",
)
def call_first_arg_string(spark, sf):
    """The documented reading of the timer rule."""
    issues = sc.scan_rule(V.code_corpus(spark, sf, "javascript"), documented_settimeout())
    return issues.groupBy(F.col("file_path").alias("path"), "start_line").agg(F.count(F.lit(1)).alias("n"))


# --- sources -------------------------------------------------------------------------


_PAGE_ATTRS = (
    "WITH n AS (SELECT unnest(regexp_extract_all(regexp_replace(html, "
    "'<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'gs'), '([a-z]+)=\"', 1)) AS name FROM pages) "
    "SELECT name, count(*) AS facts FROM n GROUP BY name"
)


def _attr_counts(corpus: DataFrame) -> DataFrame:
    found = sc.facts_of(corpus, {("html", "html_attr"): [()]})
    name = F.get("caps", F.lit(0))["text"].alias("name")
    return found.groupBy(name).agg(F.count(F.lit(1)).alias("facts"))


@query("src_scan_dir", _PAGE_ATTRS)
def src_scan_dir(spark, sf):
    """Pages written as files of several pages each, then listed, read and scanned."""
    return _attr_counts(fs.scan_dir(spark, _page_files(spark, sf), recursive=True))


@query("src_scan_flat", _PAGE_ATTRS.replace("FROM pages", "FROM pages WHERE page_id % 4 = 1"))
def src_scan_flat(spark, sf):
    """One folder without those in it."""
    folder = _page_files(spark, sf)
    pages = V.table(spark, sf, "pages").select("html")
    pages.write.options(extension="htm", quoteAll="false", escapeQuotes="false", quote="\x00", sep="\x01").csv(
        f"{folder}/shelf=1/deeper"
    )
    return _attr_counts(fs.scan_dir(spark, f"{folder}/shelf=1"))


@query("src_scan_path", _PAGE_ATTRS)
def src_scan_path(spark, sf):
    return _attr_counts(fs.scan_path(spark, _page_files(spark, sf), recursive=True))


@query("src_scan_file", _PAGE_ATTRS)
def src_scan_file(spark, sf):
    """The strict reader over all of the files."""
    return _attr_counts(fs.scan_file(spark, f"{_page_files(spark, sf)}/*/*.htm"))


def _page_files(spark: SparkSession, sf: str) -> str:
    folder = shared_folder(spark)
    pages = V.table(spark, sf, "pages").select("html", (F.col("page_id") % 4).alias("shelf"))
    options = {"maxRecordsPerFile": 100, "extension": "htm", "quoteAll": "false", "escapeQuotes": "false", "quote": "\x00", "sep": "\x01"}
    pages.write.partitionBy("shelf").options(**options).csv(folder)
    return folder


@query(
    "src_rejects",
    "SELECT 'unsupported extension' AS reason, CAST(count(*) AS BIGINT) AS files FROM region UNION ALL "
    "SELECT 'not UTF-8', count(*) FROM nation",
)
def src_rejects(spark, sf):
    """A folder with a file of another kind for each region, one that is not UTF-8 for each nation,
    and the pages, which can be scanned."""
    folder = _page_files(spark, sf)
    one = {"maxRecordsPerFile": 1}
    V.table(spark, sf, "region").select("r_name").write.options(**one).text(f"{folder}/other")
    latin = {**one, "extension": "htm", "encoding": "ISO-8859-1", "quote": "\x00"}
    names = V.table(spark, sf, "nation").select(F.concat("n_name", F.lit("\u00e9 ")))
    names.write.options(**latin).csv(f"{folder}/latin")
    return fs.rejects(spark, folder, recursive=True).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query(
    "text_rejects",
    f"SELECT {O.DOC_PATH} AS path, 'unsupported extension' AS reason FROM documents WHERE {O.DOC_LANGUAGE} IS NULL",
)
def text_rejects(spark, sf):
    return fs.text_rejects(V.doc_corpus(spark, sf))


@query(
    "src_table_corpus",
    f"SELECT {O.DOC_PATH} AS path, {O.DOC_LANGUAGE} AS language, text AS src, sha256(text) AS content_sha FROM documents "
    f"UNION ALL SELECT {O.PAGE_PATH}, 'html', html, sha256(html) FROM pages",
)
def src_table_corpus(spark, sf):
    return V.doc_corpus(spark, sf).unionByName(V.page_corpus(spark, sf))


@query(
    "src_sarif_read",
    O.STAR + "SELECT x.submission_id, x.rule_id, x.severity, x.file_path, x.line_number, x.message FROM ("
    "SELECT s.submission_id, f.rule_id, CASE WHEN s.kind = 5 THEN 'note' ELSE f.severity END AS severity, "
    "CASE WHEN s.kind = 9 THEN '' ELSE f.file_path END AS file_path, "
    "CASE WHEN s.kind = 9 THEN NULL ELSE f.line_number END AS line_number, f.message "
    "FROM submitted s JOIN findings f ON f.scan_id = s.id WHERE s.kind <> 3) x",
)
def src_sarif_read(spark, sf):
    parsed = sarif.accepted(sarif.parse_sarif(V.submissions(spark, sf)))
    return sarif.findings_of(parsed, "submission_id").select(
        "submission_id", "rule_id", "severity", "file_path", "line_number", "message"
    )


@query(
    "sarif_quarantine",
    O.STAR + "SELECT submission_id, 'version' AS reason FROM submitted WHERE kind = 3",
)
def sarif_quarantine(spark, sf):
    parsed = sarif.parse_sarif(V.submissions(spark, sf))
    return sarif.quarantined(parsed).select("submission_id", "reason")


# --- rule tables ---------------------------------------------------------------------

_RULE_OUT = "SELECT rule_no, id, name, severity, language FROM rules"


def _rule_columns(df: DataFrame) -> DataFrame:
    return df.select("rule_no", "id", "name", "severity", "language")


@query("f_rules_language", O.RULES + _RULE_OUT + " WHERE lower(language) = 'python'")
def f_rules_language(spark, sf):
    return _rule_columns(R.rules_for_language(V.rule_table(spark, sf), "PYTHON"))


@query("f_rules_ids", O.RULES + _RULE_OUT + " WHERE id IN ('rule-1', 'rule-17', 'rule-42')")
def f_rules_ids(spark, sf):
    return _rule_columns(R.rules_with_ids(V.rule_table(spark, sf), "rule-1, rule-17 ,rule-42,no-such,RULE-3"))


@query("rules_list", O.RULES + "SELECT rule_no, '  ' || id || ' - ' || name || ' (' || severity || ')' AS line FROM rules")
def rules_list(spark, sf):
    return R.rule_lines(V.rule_table(spark, sf))


@query("a_rule_count_by_lang", O.RULES + "SELECT lower(language) AS language, count(*) AS rules FROM rules GROUP BY 1")
def a_rule_count_by_lang(spark, sf):
    return R.rule_counts(V.rule_table(spark, sf))


@query(
    "u_rules_merge",
    O.RULES + "SELECT 0 AS file_no, rule_no AS line_no, id FROM rules UNION ALL "
    "SELECT 1, rule_no, id FROM rules WHERE severity = 'error'",
)
def u_rules_merge(spark, sf):
    rules = V.rule_table(spark, sf)
    merged = R.merge_rules([rules, rules.where("severity = 'error'")])
    return merged.select("file_no", "line_no", "id")


@query("u_rules_duplicates", O.RULES + "SELECT id, CAST(2 AS BIGINT) AS copies FROM rules WHERE severity = 'error'")
def u_rules_duplicates(spark, sf):
    rules = V.rule_table(spark, sf)
    return R.duplicate_ids(R.merge_rules([rules, rules.where("severity = 'error'")]))


@query(
    "src_rules_yaml",
    O.RULES + "SELECT language, severity, word, count(*) AS rules FROM rules GROUP BY ALL",
)
def src_rules_yaml(spark, sf):
    """Rule files written as JSON (which is YAML) and read back as one rule table."""
    rules = V.rule_table(spark, sf)
    body = F.struct(
        "id", "name", "severity", "language", "message",
        F.struct("shape", "where").alias("query"),
    )
    block = F.floor(F.col("rule_no") / 1000)
    files = rules.groupBy(block).agg(F.to_json(F.struct(F.collect_list(body).alias("rules"))).alias("value"))
    folder = shared_folder(spark)
    files.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    read = R.read_rules(spark, f"{folder}/*.txt")
    return read.groupBy("language", "severity", F.col("where")[0]["value"].alias("word")).agg(
        F.count(F.lit(1)).alias("rules")
    )


# --- dashboard -----------------------------------------------------------------------

_OVERVIEW = ["repo", "last_scan_at", "passed", "findings_count"]
_RECENT = "created_at >= TIMESTAMP '2001-06-01'"


def _warehouse(spark, sf):
    return V.findings(spark, sf), V.raw_scans(spark, sf), V.repos(spark, sf)


@query("findings_page", O.STAR + f"SELECT {O.PAGE_COLUMNS} FROM page WHERE org_id = 7 ORDER BY {O.PAGE_ORDER} LIMIT 500")
def findings_page(spark, sf):
    return D.findings_page(*_warehouse(spark, sf), org_id=7)


@query(
    "f_findings_severity",
    O.STAR + f"SELECT {O.PAGE_COLUMNS} FROM page WHERE org_id = 7 AND severity = 'warning' ORDER BY {O.PAGE_ORDER} LIMIT 500",
)
def f_findings_severity(spark, sf):
    return D.findings_page(*_warehouse(spark, sf), org_id=7, severity="warning")


def _page_table(spark, sf) -> PageTable:
    """All findings with their context, in two batches."""
    rows = D.findings_with_context(*_warehouse(spark, sf))
    types = dict(rows.dtypes)
    names = ("org_id", "id", "severity", "rule_id", "file_path", "line_number", "message", "repo", "scan_at")
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    table = PageTable(spark, shared_folder(spark), schema, rows_per_file=10_000)
    second = F.col("scan_id") % 3 == 0
    table.append(rows.where(~second), 0)
    table.append(rows.where(second), 1)
    return table


@query("findings_page_clustered", ORACLE["findings_page"])
def findings_page_clustered(spark, sf):
    """The page from a table laid out for it, over two batches."""
    return _page_table(spark, sf).page(org_id=7)


@query("findings_page_compacted", ORACLE["f_findings_severity"])
def findings_page_compacted(spark, sf):
    """One severity's page after both batches were made one."""
    table = _page_table(spark, sf)
    table.compact(2)
    return table.page(org_id=7, severity="warning")


@query("f_findings_severity_empty", O.STAR + f"SELECT {O.PAGE_COLUMNS} FROM page WHERE severity = ''")
def f_findings_severity_empty(spark, sf):
    return D.findings_page(*_warehouse(spark, sf), severity="")


@query("topk_findings", O.STAR + f"SELECT {O.PAGE_COLUMNS} FROM page ORDER BY {O.PAGE_ORDER} LIMIT 500")
def topk_findings(spark, sf):
    return D.findings_page(*_warehouse(spark, sf))


@query("f_tenant", O.STAR + "SELECT id, github_repo FROM repos WHERE org_id = 7")
def f_tenant(spark, sf):
    return D.of_tenant(V.repos(spark, sf), 7).select("id", "github_repo")


@query("j_findings_scan_repo", O.STAR + "SELECT id, scan_at, repo, org_id FROM page")
def j_findings_scan_repo(spark, sf):
    return D.findings_with_context(*_warehouse(spark, sf)).select("id", "scan_at", "repo", "org_id")


@query(
    "p_severity_order",
    O.STAR + "SELECT severity, CAST(severity_order AS INTEGER) AS severity_order, count(*) AS n FROM page GROUP BY 1, 2",
)
def p_severity_order(spark, sf):
    order = S.severity_order(F.col("severity")).cast("int").alias("severity_order")
    return V.findings(spark, sf).groupBy("severity", order).agg(F.count(F.lit(1)).alias("n"))


@query("repo_overview", O.STAR + f"SELECT {', '.join(_OVERVIEW)} FROM overview WHERE org_id = 7")
def repo_overview(spark, sf):
    return D.ordered_repos(
        D.repo_overview(V.repos(spark, sf), V.scans(spark, sf), V.findings(spark, sf), org_id=7)
    )


@query("o_repos", O.STAR + f"SELECT {', '.join(_OVERVIEW)} FROM overview ORDER BY last_scan_at DESC NULLS LAST, repo")
def o_repos(spark, sf):
    return D.ordered_repos(
        D.repo_overview(V.repos(spark, sf), V.scans(spark, sf), V.findings(spark, sf))
    )


_RECENT_OVERVIEW = (
    O.STAR + f", recent AS (SELECT * FROM scans WHERE {_RECENT}), rl AS (SELECT repo_id, max(created_at) AS last_scan_at, "
    "arg_max(id, row(created_at, id)) AS scan_id, arg_max(passed, row(created_at, id)) AS passed FROM recent GROUP BY repo_id) "
)


@query(
    "j_repo_scans",
    O.STAR + f"SELECT r.github_repo AS repo, s.id AS scan_id, s.created_at FROM repos r LEFT JOIN "
    f"(SELECT * FROM raw_scans WHERE {_RECENT}) s ON s.repo_id = r.id",
)
def j_repo_scans(spark, sf):
    recent = V.raw_scans(spark, sf).where(_RECENT).select(
        F.col("id").alias("scan_id"), "repo_id", "created_at"
    )
    repos = V.repos(spark, sf)
    return repos.join(recent, repos["id"] == recent["repo_id"], "left").select(
        F.col("github_repo").alias("repo"), "scan_id", "created_at"
    )


@query(
    "j_latest_scan_count",
    O.STAR + "SELECT l.repo_id, l.scan_id, coalesce(c.findings_count, 0) AS findings_count FROM latest l LEFT JOIN counts c ON c.scan_id = l.scan_id",
)
def j_latest_scan_count(spark, sf):
    return D.latest_scan_counts(V.scans(spark, sf), V.findings(spark, sf)).select(
        "repo_id", "scan_id", "findings_count"
    )


@query("a_last_scan_at", O.STAR + "SELECT repo_id, max(created_at) AS last_scan_at FROM raw_scans GROUP BY repo_id")
def a_last_scan_at(spark, sf):
    return V.raw_scans(spark, sf).groupBy("repo_id").agg(F.max("created_at").alias("last_scan_at"))


@query("a_latest_passed", O.STAR + "SELECT repo_id, passed FROM latest")
def a_latest_passed(spark, sf):
    return D.latest_scans(V.scans(spark, sf)).select("repo_id", "passed")


@query(
    "a_latest_findings_count",
    O.STAR + "SELECT r.id AS repo_id, o.findings_count FROM overview o JOIN repos r ON r.github_repo = o.repo",
)
def a_latest_findings_count(spark, sf):
    repos = V.repos(spark, sf).select(F.col("id").alias("repo_id"))
    latest = D.latest_scan_counts(V.scans(spark, sf), V.findings(spark, sf))
    return repos.join(latest, "repo_id", "left").select(
        "repo_id", F.coalesce("findings_count", F.lit(0)).alias("findings_count")
    )


@query("w_latest_scan", O.STAR + "SELECT repo_id, scan_id, last_scan_at FROM latest")
def w_latest_scan(spark, sf):
    return D.latest_scans(V.scans(spark, sf)).select("repo_id", "scan_id", "last_scan_at")


@query(
    "p_repo_row",
    _RECENT_OVERVIEW + "SELECT r.github_repo AS repo, rl.last_scan_at, rl.passed, coalesce(c.findings_count, 0) AS findings_count "
    "FROM repos r LEFT JOIN rl ON rl.repo_id = r.id LEFT JOIN counts c ON c.scan_id = rl.scan_id",
)
def p_repo_row(spark, sf):
    recent = V.scans(spark, sf).where(_RECENT)
    return D.repo_overview(V.repos(spark, sf), recent, V.findings(spark, sf))


@query(
    "p_repo_display",
    _RECENT_OVERVIEW + "SELECT r.github_repo AS repo, coalesce(strftime(rl.last_scan_at, '%Y-%m-%d %H:%M UTC'), '—') AS last_scan, "
    "CASE WHEN rl.passed THEN '✓ pass' WHEN NOT rl.passed THEN '✗ fail' ELSE '—' END AS status "
    "FROM repos r LEFT JOIN rl ON rl.repo_id = r.id",
)
def p_repo_display(spark, sf):
    recent = V.scans(spark, sf).where(_RECENT)
    rows = D.repo_overview(V.repos(spark, sf), recent, V.findings(spark, sf))
    at, status = S.repo_display(F.col("last_scan_at"), F.col("passed"))
    return rows.select("repo", at.alias("last_scan"), status.alias("status"))


@query(
    "p_finding_display",
    O.STAR + "SELECT id, CASE WHEN severity IN ('error', 'warning') THEN severity ELSE 'note' END AS shown, "
    "coalesce(CAST(nullif(line_number, 3) AS VARCHAR), '—') AS line, strftime(scan_at, '%m-%d %H:%M') AS at FROM page",
)
def p_finding_display(spark, sf):
    rows = D.findings_with_context(*_warehouse(spark, sf))
    line = F.when(F.col("line_number") != 3, F.col("line_number"))
    shown, line, at = S.finding_display(F.col("severity"), line, F.col("scan_at"))
    return rows.select("id", shown.alias("shown"), line.alias("line"), at.alias("at"))


# --- gate, ingest --------------------------------------------------------------------


@query("a_gate", O.STAR + "SELECT scan_id, passed FROM verdicts")
def a_gate(spark, sf):
    return V.verdicts(spark, sf).select("scan_id", "passed")


@query("a_findings_count", O.STAR + "SELECT scan_id, findings_count FROM counts")
def a_findings_count(spark, sf):
    return D.findings_per_scan(V.findings(spark, sf))


@query(
    "scan_response",
    O.STAR + "SELECT scan_id, passed, findings_count, CASE WHEN passed THEN 'passed' ELSE 'failed' END AS status FROM verdicts",
)
def scan_response(spark, sf):
    return policy.responses(V.verdicts(spark, sf))


_OUTBOX = (
    "CASE WHEN {p} THEN 'success' ELSE 'failure' END AS state, 'Scan ' || CASE WHEN {p} THEN 'passed' ELSE 'failed' END "
    "|| ' — ' || {n} || ' finding(s)' AS description, 'scanner/policy' AS context"
)


@query(
    "sink_status_outbox",
    O.STAR + "SELECT r.github_repo AS repo, s.commit_sha, "
    + _OUTBOX.format(p="v.passed", n="v.findings_count")
    + " FROM verdicts v JOIN raw_scans s ON s.id = v.scan_id JOIN repos r ON r.id = s.repo_id",
)
def sink_status_outbox(spark, sf):
    judged = V.verdicts(spark, sf).withColumnRenamed("scan_id", "id")
    repos = V.repos(spark, sf).select(F.col("id").alias("repo_id"), F.col("github_repo").alias("repo"))
    return ing.outbox(V.raw_scans(spark, sf).join(judged, "id").join(repos, "repo_id"))


@query(
    "s_status_text",
    O.STAR + "SELECT scan_id, 'Scan ' || CASE WHEN passed THEN 'passed' ELSE 'failed' END || ' — ' || findings_count || ' finding(s)' AS text FROM verdicts",
)
def s_status_text(spark, sf):
    text = S.status_text(F.col("passed"), F.col("findings_count"))
    return V.verdicts(spark, sf).select("scan_id", text.alias("text"))


@query(
    "j_key_org",
    O.STAR + "SELECT submission_id, CASE WHEN known THEN org_id END AS org_id FROM submitted",
)
def j_key_org(spark, sf):
    subs = V.submissions(spark, sf).select("submission_id", "key")
    keys = V.api_keys(spark, sf)
    known = ing.with_org(subs, keys).select("submission_id", "org_id")
    unknown = ing.unknown_keys(subs, keys).select(
        "submission_id", F.lit(None).cast("bigint").alias("org_id")
    )
    return known.unionByName(unknown)


@query(
    "j_rule_level",
    O.STAR + "SELECT submission_id, rule_id, severity, count(*) AS n FROM results GROUP BY ALL",
)
def j_rule_level(spark, sf):
    known = ing.with_org(V.submissions(spark, sf), V.api_keys(spark, sf))
    parsed = sarif.accepted(sarif.parse_sarif(known))
    rows = sarif.findings_of(parsed, "submission_id")
    return rows.groupBy("submission_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def _ingested(spark, sf, submissions: DataFrame | None = None) -> ing.Ingested:
    old = V.repos(spark, sf).where("id % 3 = 0")
    arrived = V.submissions(spark, sf) if submissions is None else submissions
    return ing.ingest_scans(arrived, V.api_keys(spark, sf), V.orgs(spark, sf), old)


@query("ingest_scans", O.STAR + "SELECT scan_id, passed, findings_count, CASE WHEN passed THEN 'passed' ELSE 'failed' END AS status FROM judged")
def ingest_scans(spark, sf):
    return _ingested(spark, sf).responses


@query(
    "ingest_findings",
    O.STAR + "SELECT scan_id, org_id, rule_id, severity, file_path, line_number, message FROM results",
)
def ingest_findings(spark, sf):
    return _ingested(spark, sf).findings.drop("id")


@query(
    "ingest_outbox",
    O.STAR + "SELECT a.repo, a.commit_sha, " + _OUTBOX.format(p="j.passed", n="j.findings_count")
    + " FROM accepted a JOIN judged j ON j.scan_id = a.scan_id",
)
def ingest_outbox(spark, sf):
    return _ingested(spark, sf).outbox


@query(
    "ingest_quarantine",
    O.STAR + "SELECT submission_id, 'version' AS reason FROM submitted WHERE kind = 3 AND known",
)
def ingest_quarantine(spark, sf):
    return _ingested(spark, sf).quarantine.select("submission_id", "reason")


@query(
    "m_repo_upsert",
    O.STAR + "SELECT DISTINCT org_id, repo AS github_repo, sha256(org_id || '/' || repo) AS id FROM accepted "
    "WHERE repo NOT IN (SELECT github_repo FROM repos WHERE id % 3 = 0)",
)
def m_repo_upsert(spark, sf):
    return _ingested(spark, sf).repos.select("org_id", "github_repo", "id")


@query(
    "sink_findings",
    O.STAR + "SELECT r.org_id, f.scan_id, f.rule_id, f.severity, f.file_path, f.line_number, f.message FROM findings f "
    "JOIN raw_scans s ON s.id = f.scan_id JOIN repos r ON r.id = s.repo_id",
)
def sink_findings(spark, sf):
    """Findings appended in two writes to a table kept by organization, then read back."""
    f = D.findings_with_context(*_warehouse(spark, sf)).drop("scan_at", "repo", "repo_id")
    folder = shared_folder(spark)
    ing.append(f.where("severity = 'error'"), folder, "org_id")
    ing.append(f.where("severity <> 'error'"), folder, "org_id")
    back = spark.read.schema(f.schema).parquet(folder)
    return back.select("org_id", "scan_id", "rule_id", "severity", "file_path", "line_number", "message")


_PAGE_OF_INGESTED = (
    "id, severity, rule_id, file_path, line_number, message, repo, created_at AS scan_at"
)


@query(
    "findings_page_ingested",
    O.STAR + ", numbered AS (SELECT x.*, a.repo, a.created_at, row_number() OVER (PARTITION BY x.scan_id ORDER BY x.rule_id, "
    "x.message, x.file_path, x.line_number) - 1 AS result_no FROM results x JOIN accepted a ON a.scan_id = x.scan_id WHERE x.org_id = 7), "
    "ids AS (SELECT *, scan_id || '-000000-' || lpad(CAST(result_no AS VARCHAR), 9, '0') AS id, "
    "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'note' THEN 2 ELSE 3 END AS severity_order FROM numbered) "
    f"SELECT {_PAGE_OF_INGESTED} FROM ids ORDER BY severity_order, ids.created_at DESC, id DESC LIMIT 500",
)
def findings_page_ingested(spark, sf):
    """The page over what ingest wrote: its ids sort by time of submission.

    Documents are made once; of them, each table parses those of the organization only.
    """
    got = _ingested(spark, sf, stored(V.submissions(spark, sf), shared_folder(spark), COMPRESSION))
    old = V.repos(spark, sf).where("id % 3 = 0").withColumn("id", F.col("id").cast("string"))
    repos = old.unionByName(got.repos)
    return D.findings_page(got.findings, got.scans, repos, org_id=7)


_RAW_SCANS = "SELECT j.scan_id AS id, a.commit_sha, a.branch, a.created_at, j.passed, j.findings_count AS raw_results FROM judged j JOIN accepted a ON a.scan_id = j.scan_id"


@query("sink_scans", O.STAR + f"{_RAW_SCANS} UNION ALL {_RAW_SCANS} WHERE j.passed")
def sink_scans(spark, sf):
    """Scans appended with their raw documents; the same commit sent twice is two rows."""
    scans = _ingested(spark, sf).scans
    folder = shared_folder(spark)
    ing.append(scans, folder)
    ing.append(spark.read.schema(scans.schema).parquet(folder).where("passed"), folder)
    back = spark.read.schema(scans.schema).parquet(folder)
    return back.select("id", "commit_sha", "branch", "created_at", "passed", _raw_results("sarif_json"))


def _raw_results(document: str):
    """How many results a raw document holds."""
    raw = F.from_json(document, "runs array<struct<results array<struct<ruleId:string>>>>")
    each = F.transform(raw["runs"], lambda r: F.size(r["results"]))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda n, x: n + x).alias("raw_results")


@query(
    "j_resolve_rules",
    "SELECT CAST(n_nationkey AS BIGINT) AS org_id, CASE WHEN k = 0 THEN '404 no rules repository' WHEN k = 1 THEN '200 fresh' "
    "WHEN k = 2 AND cached THEN '200 cached' WHEN k = 2 THEN '500 nothing cached' WHEN cached THEN '200 cached' ELSE '502 fetch failed' END AS status, "
    "CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'fresh ' || n_name WHEN cached THEN 'cached ' || n_name END AS rules_yaml, "
    "CASE WHEN k = 1 THEN 'tag-' || n_nationkey END AS etag FROM (SELECT *, n_nationkey % 5 AS k, n_nationkey % 2 = 0 AS cached FROM nation)",
)
def j_resolve_rules(spark, sf):
    n = V.table(spark, sf, "nation")
    k = F.col("n_nationkey") % 5
    orgs = n.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.when(k == 0, "").otherwise("org/rules").alias("rules_repo"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("cached "), "n_name")).alias("rules_cache_yaml"),
    )
    fetched = n.where(k < 4).select(
        F.col("n_nationkey").cast("bigint").alias("org_id"),
        F.when(k <= 1, "fresh").when(k == 2, "not_modified").otherwise("failed").alias("outcome"),
        F.concat(F.lit("fresh "), "n_name").alias("yaml"),
        F.concat(F.lit("tag-"), F.col("n_nationkey").cast("string")).alias("etag"),
    )
    return ing.resolve_rules(orgs, fetched)


# --- reports -------------------------------------------------------------------------


def _all_issues(spark, sf) -> DataFrame:
    return sc.scan_all(V.all_code(spark, sf), bundled_rules())


@query(
    "sink_sarif",
    f"{_ALL} SELECT file_path, rule_id, severity, start_line, message, count(*) AS n FROM issues GROUP BY ALL",
)
def sink_sarif(spark, sf):
    """One document per file, opened again as SARIF; the issues are computed once."""
    issues = stored(_all_issues(spark, sf), shared_folder(spark))
    docs = report.to_sarif(issues, by=["file_path"])
    parsed = sarif.accepted(sarif.parse_sarif(docs.withColumnRenamed("file_path", "doc")))
    rows = sarif.findings_of(parsed, "doc")
    return rows.groupBy(
        F.col("doc").alias("file_path"), "rule_id", "severity", F.col("line_number").alias("start_line"), "message"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink_json",
    f"{_ALL} SELECT file_path, '1.0.0' AS version, count(*) AS n, CAST(sum(start_column) AS BIGINT) AS columns FROM issues GROUP BY file_path",
)
def sink_json(spark, sf):
    issues = stored(_all_issues(spark, sf), shared_folder(spark))
    docs = report.to_json_report(issues, by=["file_path"])
    back = F.from_json("report", "struct<version:string,issues:array<struct<start_column:bigint>>>")
    read = docs.select("file_path", back.alias("r"))
    return read.select("file_path", "r.version", F.explode("r.issues.start_column").alias("c")).groupBy(
        "file_path", "version"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("columns"))


@query(
    "sink_sarif_whole",
    f"{_ALL} SELECT file_path, rule_id, message, CAST(start_line AS BIGINT) AS start_line, CAST(start_column AS BIGINT) AS start_column, "
    "CAST(end_line AS BIGINT) AS end_line, CAST(end_column AS BIGINT) AS end_column, code_snippet AS snippet FROM issues",
)
def sink_sarif_whole(spark, sf):
    """One report over all languages, written as lines and its results read back."""
    folder = shared_folder(spark)
    issues = stored(sc.scan_all(V.all_code(spark, sf), bundled_rules()), f"{folder}/issues")
    report.write_lines(report.sarif_lines(issues), f"{folder}/report")
    line = F.regexp_replace("value", "^,", "")
    schema = schemas.struct_of(schemas.SARIF)["runs"].dataType.elementType["results"].dataType.elementType
    read = spark.read.text(f"{folder}/report").where(F.col("value").rlike('^,?\\{"ruleId"'))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    region = place["region"]
    return read.select(F.from_json(line, schema).alias("r")).select(
        place["artifactLocation"]["uri"].alias("file_path"),
        F.col("r.ruleId").alias("rule_id"),
        F.col("r.message.text").alias("message"),
        region["startLine"].alias("start_line"),
        region["startColumn"].alias("start_column"),
        region["endLine"].alias("end_line"),
        region["endColumn"].alias("end_column"),
        region["snippet"]["text"].alias("snippet"),
    )


@query(
    "p_sarif_result",
    f"{O.issues('js-no-eval')} SELECT rule_id, file_path AS uri, CAST(start_line AS BIGINT) AS start_line, CAST(start_column AS BIGINT) AS start_column, "
    "CAST(end_line AS BIGINT) AS end_line, CAST(end_column AS BIGINT) AS end_column, code_snippet AS snippet, 1 AS locations FROM issues",
)
def p_sarif_result(spark, sf):
    issues = sc.scan_rule(V.code_corpus(spark, sf, "javascript"), _BASE["js-no-eval"])
    r = issues.select(report.sarif_result().alias("r")).select("r", F.get("r.locations", F.lit(0)).alias("l"))
    region = F.col("l.physicalLocation.region")
    return r.select(
        F.col("r.ruleId").alias("rule_id"),
        F.col("l.physicalLocation.artifactLocation.uri").alias("uri"),
        region["startLine"].alias("start_line"),
        region["startColumn"].alias("start_column"),
        region["endLine"].alias("end_line"),
        region["endColumn"].alias("end_column"),
        region["snippet"]["text"].alias("snippet"),
        F.size("r.locations").alias("locations"),
    )


_FIRST = (
    f"{_ALL}, o AS (SELECT *, row_number() OVER (PARTITION BY file_path, rule_id ORDER BY rule_no, start_line, start_column) AS k FROM issues) "
)


@query("a_sarif_rules", _FIRST + "SELECT file_path, rule_id, rule_name AS name, message AS text, severity AS level FROM o WHERE k = 1")
def a_sarif_rules(spark, sf):
    rules = report.sarif_rules(_all_issues(spark, sf).withColumn("doc", F.col("file_path")), by=["doc"])
    return rules.select(F.col("doc").alias("file_path"), "rule_id", "name", "text", "level")


@query("w_first_seen_rule", _FIRST + "SELECT file_path, rule_id, start_line, start_column, code_snippet FROM o WHERE k = 1")
def w_first_seen_rule(spark, sf):
    first = F.min_by(F.struct("start_line", "start_column", "code_snippet"), F.struct("rule_no", "fact_no", "cap_no"))
    grouped = _all_issues(spark, sf).groupBy("file_path", "rule_id").agg(first.alias("f"))
    return grouped.select("file_path", "rule_id", "f.*")


@query(
    "a_exit_status",
    f"{_ALL} SELECT CASE WHEN count(*) = 0 THEN 0 ELSE 1 END AS exit_status, count(*) AS issues FROM issues",
)
def a_exit_status(spark, sf):
    return report.exit_status(_all_issues(spark, sf))


# --- incremental ---------------------------------------------------------------------


def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents before and after a change of every third one."""
    new = V.doc_corpus(spark, sf)
    doc_id = F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint")
    changed = doc_id % 3 == 0
    old_src = F.when(changed, F.concat("src", F.lit("\n"))).otherwise(F.col("src"))
    old = new.select("path", "language", old_src.alias("src"))
    return old.withColumn("content_sha", S.sha256_hex(F.col("src"))), new


def _cache_of(corpus: DataFrame) -> DataFrame:
    return corpus.select("path", "content_sha", F.octet_length("src").alias("bytes"))


@query(
    "j_cache_lookup",
    f"SELECT {O.DOC_PATH} AS path, CASE WHEN doc_id % 3 = 0 THEN 'miss' ELSE 'hit' END AS outcome FROM documents",
)
def j_cache_lookup(spark, sf):
    old, new = _versions(spark, sf)
    cache = _cache_of(old)
    hit = inc.lookup(new, cache).select("path", F.lit("hit").alias("outcome"))
    return hit.unionByName(inc.misses(new, cache).select("path", F.lit("miss").alias("outcome")))


@query(
    "m_cache_put",
    f"SELECT {O.DOC_PATH} AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(text) WHEN doc_id % 3 = 0 THEN sha256(text || chr(10)) ELSE sha256(text) END AS content_sha FROM documents",
)
def m_cache_put(spark, sf):
    old, new = _versions(spark, sf)
    fifth = F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint") % 5 == 0
    entries = _cache_of(new.where(fifth))
    return inc.put(_cache_of(old), entries, by=("path",)).select("path", "content_sha")


@query("a_cache_len", "SELECT count(*) AS entries, count(*) = 0 AS is_empty FROM documents")
def a_cache_len(spark, sf):
    return inc.size(_cache_of(V.doc_corpus(spark, sf)))


@query("m_cache_clear", "SELECT count(*) AS entries, count(*) = 0 AS is_empty FROM documents WHERE false")
def m_cache_clear(spark, sf):
    return inc.size(inc.cleared(_cache_of(V.doc_corpus(spark, sf))))


query("a_cache_empty", ORACLE["a_cache_len"])(a_cache_len)


@query("inc_scan", ORACLE["scan_all"])
def inc_scan(spark, sf):
    """A scan of an earlier state fills the table, a scan of the present one reads the rest."""
    rules = bundled_rules()
    now = stored(V.all_code(spark, sf), shared_folder(spark))
    user = F.regexp_extract("path", r"_(\d+)/", 1).cast("bigint")
    before = now.where(user % 2 == 0).unionByName(
        now.where(user % 2 == 1)
        .withColumn("src", F.concat("src", F.lit("\n// TODO")))
        .withColumn("content_sha", S.sha256_hex(F.col("src")))
    )
    table = KeyedTable(spark, shared_folder(spark), inc.CACHE, ("path",))
    inc.scan_into(before, rules, table, 0, by=("path",))
    return inc.scan_into(now, rules, table, 1, by=("path",)).select(*_ISSUE)


# --- scalars -------------------------------------------------------------------------

_URL_PATH = "regexp_replace(url, '[?#].*$', '')"


def _url_path():
    return F.regexp_replace("url", r"[?#].*$", "")


@query(
    "s_extension",
    f"WITH p AS (SELECT page_id, regexp_extract({_URL_PATH}, '([^/]*)/*$', 1) AS f FROM pages) SELECT page_id, "
    "CASE WHEN regexp_matches(f, '^.+\\.[^.]*$') THEN lower(regexp_extract(f, '([^.]*)$', 1)) END AS ext FROM p",
)
def s_extension(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", S.file_extension(_url_path()).alias("ext"))


_PATHS = (
    f"WITH p AS (SELECT {O.PAGE_PATH} AS path, 'html' AS language FROM pages UNION ALL SELECT {O.DOC_PATH}, {O.DOC_LANGUAGE} FROM documents) "
)


def _paths(spark, sf):
    docs = V.table(spark, sf, "documents").select(V.doc_path().alias("path"))
    pages = V.table(spark, sf, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path")
    )
    return docs.unionByName(pages)


@query("s_language", _PATHS + "SELECT path, language FROM p")
def s_language(spark, sf):
    return _paths(spark, sf).select("path", S.language_of(F.col("path")).alias("language"))


@query("s_is_supported", _PATHS + "SELECT path, language IS NOT NULL AS supported FROM p")
def s_is_supported(spark, sf):
    return _paths(spark, sf).select("path", S.is_supported_file(F.col("path")).alias("supported"))


@query("s_normalize_path", "SELECT page_id, replace(url, '/', chr(92)) AS raw, url AS path FROM pages")
def s_normalize_path(spark, sf):
    raw = F.replace("url", F.lit("/"), F.lit("\\"))
    return V.table(spark, sf, "pages").select(
        "page_id", raw.alias("raw"), S.normalize_path(raw).alias("path")
    )


@query(
    "s_extract_snippet",
    "WITH d AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS parts FROM documents), "
    f"l AS (SELECT doc_id, {_LINES} AS lines, doc_id % 4 AS a, doc_id % 4 + doc_id % 3 AS b FROM d) "
    "SELECT doc_id, CASE WHEN greatest(a, 1) > least(b, len(lines)) THEN '' ELSE "
    "array_to_string(list_slice(lines, greatest(a, 1), least(b, len(lines))), chr(10)) END AS snippet FROM l",
)
def s_extract_snippet(spark, sf):
    a = (F.col("doc_id") % 4).cast("int")
    b = (F.col("doc_id") % 4 + F.col("doc_id") % 3).cast("int")
    return V.table(spark, sf, "documents").select(
        "doc_id", S.extract_snippet(F.col("text"), a, b).alias("snippet")
    )


@query(
    "s_truncate",
    "SELECT doc_id, CASE WHEN strlen(text) <= 80 THEN text ELSE left(text, 77) || '...' END AS cut FROM documents",
)
def s_truncate(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.truncate(F.col("text"), 80).alias("cut"))


@query("s_sarif_level", O.STAR + "SELECT id, severity AS level FROM findings")
def s_sarif_level(spark, sf):
    return V.findings(spark, sf).select("id", S.sarif_level(F.col("severity")).alias("level"))


@query(
    "s_severity_parse",
    O.STAR + "SELECT id, CASE WHEN line_number % 2 = 0 THEN severity END AS severity FROM findings",
)
def s_severity_parse(spark, sf):
    given = F.when(F.col("line_number") % 2 == 0, F.col("severity")).otherwise(F.upper("severity"))
    return V.findings(spark, sf).select("id", R.severity_or_null(given).alias("severity"))


@query("s_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def s_sha256(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.sha256_hex(F.col("text")).alias("sha"))


@query("s_b64_rules", "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN text END AS text FROM documents")
def s_b64_rules(spark, sf):
    """Texts wrapped as base64 lines and decoded; every tenth is no base64."""
    wrapped = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{60})", "$1\r\n ")
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(wrapped, F.lit("*"))).otherwise(wrapped)
    return V.table(spark, sf, "documents").select("doc_id", S.decode_rules(content).alias("text"))


_POLICY_TEXTS = [
    ("{}", [], True),
    ('{"fail_on_severity":["ERROR","note"]}', ["ERROR", "note"], True),
    ('{"fail_on_severity":["error"],"block_merge":false}', ["error"], False),
    ('{"fail_on_severity":["error"],"block_merge":"yes"}', [], False),
    ('{"fail_on_severity":null}', [], False),
    ('{"fail_on_severity":["error",1]}', [], False),
    ('{"fail_on_severity":[]}', [], True),
    ('{"fail_on_severity":[null]}', [], False),
    ('"x"', [], False),
    ('{"fail_on_severity":["error"', [], False),
    ('{"block_merge":null}', [], False),
    ('{"fail_on_severity":["error"],"other":1}', ["error"], True),
]


@query(
    "s_policy_parse",
    "SELECT c_custkey, CASE c_custkey % 12 "
    + " ".join(f"WHEN {n} THEN {O.lit(','.join(f))}" for n, (_, f, _b) in enumerate(_POLICY_TEXTS))
    + " END AS fails, CASE c_custkey % 12 "
    + " ".join(f"WHEN {n} THEN {str(b).lower()}" for n, (_, _f, b) in enumerate(_POLICY_TEXTS))
    + " END AS block_merge FROM customer",
)
def s_policy_parse(spark, sf):
    texts = F.array(*[F.lit(t) for t, _, _ in _POLICY_TEXTS])
    parsed = S.parse_policy(F.get(texts, (F.col("c_custkey") % 12).cast("int")))
    return V.table(spark, sf, "customer").select("c_custkey", parsed.alias("p")).select(
        "c_custkey", F.array_join("p.fail_on_severity", ",").alias("fails"), "p.block_merge"
    )


@query(
    "s_line_narrow",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey * 1000000 <= 2147483647 THEN o_orderkey * 1000000 END AS INTEGER) AS line FROM orders",
)
def s_line_narrow(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", S.line_as_int(F.col("o_orderkey") * 1000000).alias("line")
    )


@query(
    "s_first_location",
    O.STAR + "SELECT submission_id, file_path, CAST(line_number AS BIGINT) AS line FROM results",
)
def s_first_location(spark, sf):
    known = ing.with_org(V.submissions(spark, sf), V.api_keys(spark, sf))
    rows = sarif.findings_of(sarif.accepted(sarif.parse_sarif(known)), "submission_id")
    return rows.select("submission_id", "file_path", "line")


@query(
    "s_eq_ignore_case",
    "SELECT doc_id, lower(source) = 'src1' AS same, lang = 'de' AS german FROM documents",
)
def s_eq_ignore_case(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id",
        S.same_ignoring_case(F.upper("source"), F.lit("sRc1")).alias("same"),
        S.same_ignoring_case(F.initcap("lang"), F.lit("DE")).alias("german"),
    )


# --- streams -------------------------------------------------------------------------


def _as_stream(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """The rows as arriving files, in about three batches.

    They are dealt out anew only where so few files were written that they are small.
    """
    written = stored(df, folder, COMPRESSION)
    files = len(written.inputFiles())
    if files < 3:
        files, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{folder}-dealt"
        written.repartition(files).write.parquet(folder)
    reader = spark.readStream.schema(df.schema)
    return reader.option("maxFilesPerTrigger", max(files // 3, 1)).parquet(folder)


def _append_stream(stream: DataFrame, folder: str) -> DataFrame:
    st.run_available(
        stream, lambda b, n: st.write_batch(b, f"{folder}/out", n), f"{folder}/_checkpoint"
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").drop("batch_id")


def _ingest_stream(spark, sf, name: str) -> DataFrame:
    """A table that the ingest stream filled, after its last batch came a second time."""
    folder = shared_folder(spark)
    arriving = _as_stream(spark, V.submissions(spark, sf), f"{folder}/in")
    old = V.repos(spark, sf).where("id % 3 = 0")
    st.ingest_stream(arriving, V.api_keys(spark, sf), V.orgs(spark, sf), old, folder)
    return st.ingested(spark, folder, name)


@query("st_ingest", ORACLE["ingest_findings"])
def st_ingest(spark, sf):
    return _ingest_stream(spark, sf, "findings").drop("id")


@query("st_ingest_repos", ORACLE["m_repo_upsert"])
def st_ingest_repos(spark, sf):
    return _ingest_stream(spark, sf, "repositories").select("org_id", "github_repo", "id")


@query(
    "st_ingest_scans",
    O.STAR + "SELECT j.scan_id AS id, a.org_id, a.repo, a.commit_sha, a.branch, j.passed, j.findings_count, "
    "j.findings_count AS raw_results, r.id IS NOT NULL AS known_repo FROM judged j JOIN accepted a ON a.scan_id = j.scan_id "
    "LEFT JOIN repos r ON r.github_repo = a.repo AND r.org_id = a.org_id AND r.id % 3 = 0",
)
def st_ingest_scans(spark, sf):
    """Scans with their raw documents, read again here, and the repository they were given."""
    scans = _ingest_stream(spark, sf, "scans")
    return scans.select(
        "id",
        "org_id",
        "repo",
        "commit_sha",
        "branch",
        "passed",
        "findings_count",
        _raw_results("sarif_json"),
        F.col("repo_id").rlike("^[0-9]{1,18}$").alias("known_repo"),
    )


@query("st_ingest_outbox", ORACLE["ingest_outbox"])
def st_ingest_outbox(spark, sf):
    return _ingest_stream(spark, sf, "outbox")


@query("st_ingest_quarantine", ORACLE["ingest_quarantine"])
def st_ingest_quarantine(spark, sf):
    return _ingest_stream(spark, sf, "quarantine").select("submission_id", "reason")


@query("st_gate", O.STAR + "SELECT submission_id, passed, findings_count FROM judged")
def st_gate(spark, sf):
    folder = shared_folder(spark)
    arriving = _as_stream(spark, V.submissions(spark, sf), f"{folder}/in")
    policies = (
        V.api_keys(spark, sf)
        .join(V.orgs(spark, sf).withColumnRenamed("id", "org_id"), "org_id")
        .select("key_hash", S.parse_policy(F.col("policy_json"))["fail_on_severity"].alias("fail_on_severity"))
    )
    return _append_stream(st.gate_stream(arriving, policies), folder)


@query("st_scan", ORACLE["scan_all"])
def st_scan(spark, sf):
    folder = shared_folder(spark)
    arriving = _as_stream(spark, V.all_code(spark, sf), f"{folder}/in")
    return _append_stream(st.scan_stream(arriving, bundled_rules()), folder).select(*_ISSUE)


@query("st_inc", ORACLE["scan_all"])
def st_inc(spark, sf):
    """Every file arrives twice, in whatever batch, and is scanned once."""
    folder = shared_folder(spark)
    code = V.all_code(spark, sf)
    arriving = _as_stream(spark, code.unionByName(code), f"{folder}/in")
    st.scan_new_stream(arriving, bundled_rules(), folder)
    return st.new_issues(spark, folder, schemas.ISSUES).select(*_ISSUE)


@query(
    "st_repo_state",
    O.STAR + "SELECT l.repo_id, l.last_scan_at AS created_at, l.scan_id AS id, l.passed, v.findings_count FROM latest l JOIN verdicts v ON v.scan_id = l.scan_id",
)
def st_repo_state(spark, sf):
    folder = shared_folder(spark)
    judged = V.verdicts(spark, sf).withColumnRenamed("scan_id", "id")
    scans = V.raw_scans(spark, sf).join(judged, "id").select("repo_id", "created_at", "id", "passed", "findings_count")
    return st.repo_state_stream(_as_stream(spark, scans, f"{folder}/in"), f"{folder}/state").read()
