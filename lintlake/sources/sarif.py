"""SARIF documents to findings; a document with any required part missing is refused."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import scalars as S


def _missing(x: Column, *fields: str) -> Column:
    """The value lacks one of the (dotted) fields."""

    def value(field: str) -> Column:
        return functools.reduce(lambda v, part: v[part], field.split("."), x)

    return functools.reduce(operator.or_, [value(f).isNull() for f in fields])


def _reason(doc: Column, raw: Column) -> Column:
    """Why a document is refused, null when it is accepted.

    Each test relies on those before it: the lists it goes through are there.  They are gone
    through where they are, so none is put together for a test.
    """
    runs = doc["runs"]

    def some_result(test: Callable[[Column], Column]) -> Column:
        return F.exists(runs, lambda r: F.exists(r["results"], test))

    def some_place(test: Callable[[Column], Column]) -> Column:
        return some_result(lambda x: F.exists(x["locations"], lambda y: test(y["physicalLocation"])))

    def driver(r: Column) -> Column:
        return r["tool"]["driver"]

    def rule(x: Column) -> Column:
        return _missing(x, "id", "name", "shortDescription.text", "defaultConfiguration.level")

    def snippet(p: Column) -> Column:
        s = p["region"]["snippet"]
        return s.isNotNull() & s["text"].isNull()

    return (
        F.when(F.try_parse_json(raw).isNull() | doc.isNull(), "not SARIF JSON")
        .when(doc["version"].isNull(), "version")
        .when(doc["$schema"].isNull(), "$schema")
        .when(runs.isNull() | F.exists(runs, lambda r: r.isNull()), "runs")
        .when(
            F.exists(runs, lambda r: _missing(driver(r), "name", "version", "informationUri", "rules")),
            "driver",
        )
        .when(F.exists(runs, lambda r: F.exists(driver(r)["rules"], rule)), "rule")
        .when(F.exists(runs, lambda r: r["results"].isNull()), "results")
        .when(some_result(lambda x: _missing(x, "ruleId", "message.text", "locations")), "result")
        .when(
            some_place(
                lambda p: _missing(p, "artifactLocation.uri", "region.startLine", "region.startColumn")
            ),
            "location",
        )
        .when(some_place(snippet), "snippet")
    )


def _results(log: Column) -> Column:
    """All results of a document with the level of their rule.

    A rule's level comes from its own run's list: the last entry wins, ``note`` without
    one.  It is looked up inside the row, so no rule list is copied to each result.
    """

    def of_run(run: Column, run_no: Column) -> Column:
        rules = run["tool"]["driver"]["rules"]
        listed = F.struct(
            F.reverse(rules["id"]).alias("ids"),
            F.reverse(rules["defaultConfiguration"]["level"]).alias("levels"),
        )

        def flat(x: Column, k: Column, own: Column) -> Column:
            at = F.array_position(own["ids"], x["ruleId"]).cast("int") - 1
            path, line = S.first_location(x["locations"])
            return F.struct(
                run_no.alias("run_no"),
                k.alias("result_no"),
                x["ruleId"].alias("rule_id"),
                F.coalesce(F.get(own["levels"], at), F.lit("note")).alias("severity"),
                path.alias("file_path"),
                line.alias("line"),
                x["message"]["text"].alias("message"),
            )

        bound = F.transform(
            F.array(listed), lambda own: F.transform(run["results"], lambda x, k: flat(x, k, own))
        )
        return F.flatten(bound)

    return F.flatten(F.transform(log["runs"], of_run))


def parse_sarif(docs: DataFrame, column: str = "sarif") -> DataFrame:
    """Documents with ``results`` (array of findings) and ``reason`` (null when accepted)."""
    typed = docs.withColumn("log", F.from_json(F.col(column), schemas.SARIF))
    log, reason = F.col("log"), _reason(F.col("log"), F.col(column))
    both = F.struct(reason.alias("reason"), _results(log).alias("results"))
    # one-element explode: a later filter on the reason stays above it, so a document is
    # not parsed again for the filter
    judged = typed.select(*docs.columns, F.explode_outer(F.array(both)).alias("p"))
    return judged.select(*docs.columns, "p.reason", "p.results")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).drop("results")


def findings_of(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per result of the accepted documents, in all runs."""
    rows = parsed.select(*keep, F.explode_outer("results").alias("x")).where("x is not null")
    return rows.select(*keep, "x.*").withColumn("line_number", S.line_as_int(F.col("line")))
