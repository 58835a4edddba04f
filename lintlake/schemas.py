"""Relations shared by the operators (column names, types, small constants)."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: languages, extensions and severities the data model knows ---
LANGUAGES = ("javascript", "typescript", "python", "html")
EXTENSION_LANGUAGE = {
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "py": "python",
    "html": "html",
    "htm": "html",
}
SEVERITIES = ("error", "warning", "note")
SEVERITY_ORDER = {"error": 0, "warning": 1, "note": 2}
SEVERITY_ORDER_OTHER = 3
JSON_REPORT_VERSION = "1.0.0"
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
DEFAULT_POLICY_JSON = '{"fail_on_severity":["error"],"block_merge":true}'
STATUS_CONTEXT = "scanner/policy"
STATUS_MAX_BYTES = 140
FINDINGS_PAGE_LIMIT = 500
# --- end of fixed values ---

CORPUS = "path string, language string, src string, content_sha string"

CAPTURE = (
    "struct<name:string,text:string,start_line:int,start_column:int,"
    "end_line:int,end_column:int>"
)
FACTS = f"path string, language string, shape string, fact_no int, caps array<{CAPTURE}>"

WHERE = "array<struct<capture:string,op:string,value:string>>"
RULES = (
    "rule_no int, id string, name string, severity string, language string, "
    f"message string, metadata string, shape string, where {WHERE}, report array<string>"
)

ISSUE_COLUMNS = (
    "rule_id",
    "rule_name",
    "severity",
    "message",
    "file_path",
    "start_line",
    "start_column",
    "end_line",
    "end_column",
    "code_snippet",
)
ISSUE_ORDER = ("file_path", "rule_no", "fact_no", "cap_no")
ISSUES = (
    "rule_id string, rule_name string, severity string, message string, file_path string, "
    "start_line int, start_column int, end_line int, end_column int, code_snippet string, "
    "rule_no int, fact_no int, cap_no int"
)

SARIF = (
    "struct<version:string,`$schema`:string,runs:array<struct<"
    "tool:struct<driver:struct<name:string,version:string,informationUri:string,"
    "rules:array<struct<id:string,name:string,shortDescription:struct<text:string>,"
    "defaultConfiguration:struct<level:string>>>>>,"
    "results:array<struct<ruleId:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,"
    "region:struct<startLine:bigint,startColumn:bigint,endLine:bigint,endColumn:bigint,"
    "snippet:struct<text:string>>>>>>>>>>"
)

SUBMISSIONS = (
    "submission_id string, key string, sarif string, repo string, commit_sha string, "
    "branch string, submitted_at timestamp"
)


def struct_of(ddl: str) -> T.StructType:
    """DDL text as a StructType."""
    return T.StructType.fromDDL(ddl)
