"""Reports: SARIF and JSON documents from issues, exit status."""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import __version__, schemas

TOOL = "lintlake"
TOOL_URI = "https://lintlake.invalid/"
_ORDER = ("file_path", "rule_no", "fact_no", "cap_no")


def sarif_result() -> Column:
    """One issue as a SARIF result with exactly one location."""
    region = F.struct(
        F.col("start_line").cast("bigint").alias("startLine"),
        F.col("start_column").cast("bigint").alias("startColumn"),
        F.col("end_line").cast("bigint").alias("endLine"),
        F.col("end_column").cast("bigint").alias("endColumn"),
        F.struct(F.col("code_snippet").alias("text")).alias("snippet"),
    )
    place = F.struct(
        F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"),
        region.alias("region"),
    )
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
    )


def sarif_rules(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rules that occur, with name, text and level of their first issue.

    One row per group and rule survives in each task before the shuffle.
    """
    first = F.min_by(F.struct("rule_name", "message", "severity"), F.struct(*_ORDER))
    return (
        issues.groupBy(*by, "rule_id")
        .agg(F.min(F.struct(*_ORDER)).alias("first_at"), first.alias("r"))
        .select(
            *by,
            "rule_id",
            "first_at",
            F.col("r.rule_name").alias("name"),
            F.col("r.message").alias("text"),
            F.col("r.severity").alias("level"),
        )
    )


def _ordered(items: Column) -> Column:
    return F.transform(F.array_sort(items), lambda x: x["item"])


def _log(rules: Column, results: Column) -> Column:
    driver = F.struct(
        F.lit(TOOL).alias("name"),
        F.lit(__version__).alias("version"),
        F.lit(TOOL_URI).alias("informationUri"),
        rules.alias("rules"),
    )
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"),
        results.alias("results"),
    )
    return F.struct(
        F.lit(schemas.SARIF_VERSION).alias("version"),
        F.lit(schemas.SARIF_SCHEMA_URI).alias("$schema"),
        F.array(run).alias("runs"),
    )


def _rule_entry(x: Column) -> Column:
    return F.struct(
        x["rule_id"].alias("id"),
        x["rule_name"].alias("name"),
        F.struct(x["message"].alias("text")).alias("shortDescription"),
        F.struct(x["severity"].alias("level")).alias("defaultConfiguration"),
    )


def to_sarif(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SARIF documents as values: one row ``(*by, sarif)`` per group, results in issue order.

    A group becomes one row, so this is for groups that are documents in a table, such as
    the issues of one file; :func:`sarif_lines` writes reports of any size.
    Without ``by`` and without issues there is one document without results.
    """
    item = F.struct(*_ORDER, "rule_id", "rule_name", "message", "severity", sarif_result().alias("item"))
    listed = issues.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    first_seen = F.transform(
        F.array_distinct("items.rule_id"),
        lambda rule_id: F.get(F.filter("items", lambda x: x["rule_id"] == rule_id), F.lit(0)),
    )
    docs = listed.select(
        *by,
        F.transform(first_seen, _rule_entry).alias("rules"),
        F.transform("items", lambda x: x["item"]).alias("results"),
    )
    return docs.select(*by, F.to_json(_log(F.col("rules"), F.col("results"))).alias("sarif"))


def to_json_report(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """JSON reports as values ``(*by, report)``, issues in order; one row per group."""
    issue = F.struct(*[F.col(c) for c in schemas.ISSUE_COLUMNS])
    item = F.struct(*[F.col(c).alias(f"o_{c}") for c in _ORDER], issue.alias("item"))
    docs = issues.groupBy(*by).agg(_ordered(F.collect_list(item)).alias("issues"))
    report = F.struct(F.lit(schemas.JSON_REPORT_VERSION).alias("version"), "issues")
    return docs.select(*by, F.to_json(report).alias("report"))


# --- reports of any size, as ordered lines -------------------------------------------

_SORT = ("section", *_ORDER)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """``left`` with the rows of ``right`` that agree in the columns, nulls included."""
    named = right.select(*[F.col(c).alias(f"_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return left.join(named, functools.reduce(operator.and_, same), how)


def _listed(items: DataFrame, by: Sequence[str], section: int) -> DataFrame:
    """Items ``(*by, *_ORDER, text)`` as lines, a comma before all but a group's first.

    Only the items at a group's first place in the order, which are few, are told apart by
    their texts and counted; the others stay in their tasks until they are sorted.
    """
    place, row = [*by, *_ORDER], [*by, *_ORDER, "text"]
    least = items.groupBy(*by).agg(F.min(F.struct(*_ORDER)).alias("f")).where("f is not null")
    least = least.select(*by, "f.*")
    head = _same(items, least, place, "left_semi").groupBy(*row).agg(F.count(F.lit(1)).alias("n"))
    first = head.groupBy(*by).agg(F.min(F.struct(*_ORDER, "text")).alias("f")).where("f is not null")
    first = first.select(*by, "f.*")
    lines = _same(head, first, row, "left").select(
        *row, F.col("_text").isNotNull().alias("first"), F.explode(F.expr("sequence(1, n)")).alias("k")
    )
    lead = F.when(F.col("first") & (F.col("k") == 1), "").otherwise(",")
    columns = [*by, F.lit(section).alias("section"), *_ORDER, "text"]
    rest = _same(items, least, place, "left_anti").select(
        *columns, F.lit(1).cast("bigint").alias("k"), F.lit(",").alias("lead")
    )
    return lines.select(*columns, "k", lead.alias("lead")).unionByName(rest)


def _fixed(issues: DataFrame, by: Sequence[str], texts: dict[int, str]) -> DataFrame:
    """Fixed lines of every group; without groups there is one report, also of no issue."""
    groups = issues.select(*by).distinct() if by else issues.sparkSession.range(1).select()
    parts = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(t).alias("text")) for n, t in texts.items()])
    types = {f.name: f.dataType for f in issues.schema}
    none = [F.lit(None).cast(types[c]).alias(c) for c in _ORDER]
    lines = groups.select(*by, F.explode(parts).alias("p"))
    once = [F.lit(1).alias("k"), F.lit("").alias("lead")]
    return lines.select(*by, "p.section", *none, "p.text", *once)


def _in_order(by: Sequence[str], *parts: DataFrame) -> DataFrame:
    lines = functools.reduce(DataFrame.unionByName, parts)
    # the comma joins the text after the sort, so the first of equal lines stays first
    ordered = lines.orderBy(*by, *_SORT, "text", "k")
    return ordered.select(*by, *_SORT, F.concat("lead", "text").alias("text"))


def sarif_lines(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SARIF reports of any size: sorted lines ``(*by, section, order columns, text)``.

    The texts of a group, one after the other, are one document with one run: head, rules by
    first issue, results in issue order, foot.  ``issues`` is read several times: give a
    written table when it is costly to compute.
    """
    mark = "@"
    shell = {
        "version": schemas.SARIF_VERSION,
        "$schema": schemas.SARIF_SCHEMA_URI,
        "runs": [
            {
                "tool": {
                    "driver": {
                        "name": TOOL,
                        "version": __version__,
                        "informationUri": TOOL_URI,
                        "rules": [mark],
                    }
                },
                "results": [mark],
            }
        ],
    }
    head, middle, foot = json.dumps(shell, separators=(",", ":")).split(f'"{mark}"')
    entry = F.struct(
        F.col("rule_id").alias("id"),
        "name",
        F.struct("text").alias("shortDescription"),
        F.struct("level").alias("defaultConfiguration"),
    )
    rules = sarif_rules(issues, by).select(*by, "first_at.*", F.to_json(entry).alias("text"))
    results = issues.select(*by, *_ORDER, F.to_json(sarif_result()).alias("text"))
    return _in_order(
        by,
        _fixed(issues, by, {0: head, 2: middle, 4: foot}),
        _listed(rules, by, 1),
        _listed(results, by, 3),
    )


def json_lines(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """JSON reports of any size as sorted lines, see :func:`sarif_lines`."""
    head = f'{{"version":"{schemas.JSON_REPORT_VERSION}","issues":['
    issue = F.to_json(F.struct(*schemas.ISSUE_COLUMNS))
    rows = issues.select(*by, *_ORDER, issue.alias("text"))
    return _in_order(by, _fixed(issues, by, {0: head, 2: "]}"}), _listed(rows, by, 1))


def write_lines(lines: DataFrame, path: str) -> None:
    """One report; its files, one after the other by name, are the document."""
    lines.select("text").write.mode("overwrite").text(path)


def write_documents(docs: DataFrame, column: str, path: str) -> None:
    """One document per line as text."""
    docs.select(column).write.mode("overwrite").text(path)


def exit_status(issues: DataFrame) -> DataFrame:
    """0 without issues, 1 with any, whatever the severity."""
    found = F.count(F.lit(1))
    return issues.agg(
        F.when(found == 0, 0).otherwise(1).alias("exit_status"), found.alias("issues")
    )


def ordered_issues(issues: DataFrame) -> DataFrame:
    """Report order: file, rule, match, capture."""
    return issues.orderBy(*schemas.ISSUE_ORDER)
