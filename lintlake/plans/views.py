"""Corpus, warehouse and submission views over the driver's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.operators import policy, report
from lintlake.plans.templates import TEMPLATES
from lintlake.sources.files import table_corpus

EXTENSION = {"javascript": "js", "typescript": "ts", "python": "py", "html": "html"}
# A file holds the events of one user among this many consecutive ids, so it stays small
# whatever share of the events a user has.
FILE_IDS = 5000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- corpora -------------------------------------------------------------------------


def _event_files(spark: SparkSession, sf: str) -> DataFrame:
    """``name, ids``: the events of each file in order; only their ids are moved.

    The texts are many times as large as the ids, so Spark may not merge partitions by those.
    """
    block = F.floor(F.col("event_id") / FILE_IDS).cast("string")
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit("/"), block)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = table(spark, sf, "events").select(name.alias("name"), "event_id")
    ids = F.sort_array(F.collect_list("event_id"))
    return events.repartition(parts, "name").groupBy("name").agg(ids.alias("ids"))


def _written(lang: str) -> Column:
    """``path, src`` of an event file in a language: the lines of event n are those of template
    n % count."""
    templates = TEMPLATES[lang]
    texts = F.array(*[F.lit("\n".join(t.lines)) for t in templates])

    def lines(event: Column) -> Column:
        text = F.get(texts, (event % len(templates)).cast("int"))
        return F.replace(text, F.lit("{id}"), event.cast("string"))

    src = F.array_join(F.transform("ids", lines), "\n")
    return F.struct(F.concat("name", F.lit(f".{EXTENSION[lang]}")).alias("path"), src.alias("src"))


def _code(spark: SparkSession, sf: str, languages: Sequence[str]) -> DataFrame:
    files = F.explode(F.array(*[_written(lang) for lang in languages])).alias("file")
    return table_corpus(_event_files(spark, sf).select(files), F.col("file.path"), F.col("file.src"))


def code_corpus(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    return _code(spark, sf, [lang])


def all_code(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf, schemas.LANGUAGES)


def page_corpus(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table_corpus(pages, path, F.col("html"))


_DOC_EXTENSION = {"en": "py", "fr": "js", "de": "ts", "es": "txt"}


def doc_path() -> Column:
    ext = F.create_map(*[F.lit(x) for kv in _DOC_EXTENSION.items() for x in kv])
    return F.concat(
        "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext[F.col("lang")]
    )


def doc_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table_corpus(table(spark, sf, "documents"), doc_path(), F.col("text"))


# --- rules ---------------------------------------------------------------------------

_NAMES = ("eval", "exec", "print", "fetch", "alert")


def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """One rule per part; every rule looks for a call of one of a few names."""
    n = F.col("p_partkey")
    lang = F.get(F.array(*[F.lit(x) for x in ("javascript", "Python", "TYPESCRIPT", "html")]), (n % 4).cast("int"))
    word = F.get(F.array(*[F.lit(x) for x in _NAMES]), (n % len(_NAMES)).cast("int"))
    severity = F.get(F.array(*[F.lit(x) for x in schemas.SEVERITIES]), (F.col("p_size") % 3).cast("int"))
    where = F.array(
        F.struct(F.lit("fn").alias("capture"), F.lit("eq").alias("op"), word.alias("value"))
    )
    return table(spark, sf, "part").select(
        n.cast("int").alias("rule_no"),
        F.concat(F.lit("rule-"), n.cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        severity.alias("severity"),
        lang.alias("language"),
        F.col("p_type").alias("message"),
        F.lit(None).cast("string").alias("metadata"),
        F.lit("call").alias("shape"),
        where.alias("where"),
        F.array(F.lit("fn")).alias("report"),
    )


def regex_rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """The rule table with a regex of its own for each rule, none two alike.

    Every hundredth rule has one that its word meets; the others need a name that ends in the
    rule's number.
    """
    word, n = F.col("where")[0]["value"], F.col("rule_no").cast("string")
    common = F.concat(F.lit("^"), word, F.lit("(x"), n, F.lit(")?$"))
    rare = F.concat(F.lit("^"), word, F.lit("_+"), n, F.lit("(x)?$"))
    regex = F.when(F.col("rule_no") % 100 == 0, common).otherwise(rare)
    where = F.array(
        F.struct(F.lit("fn").alias("capture"), F.lit("match").alias("op"), regex.alias("value"))
    )
    return rule_table(spark, sf).withColumn("where", where)


def odd_rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """The rule table with faults by rule number modulo 7.

    1: unknown test; 2: broken regex; 3: unknown shape; 4: unknown capture; 5: a shape that
    only scripts have.
    """
    kind = F.col("rule_no") % 7

    def one(op: str, value: Column, capture: str = "fn") -> Column:
        return F.array(F.struct(F.lit(capture).alias("capture"), F.lit(op).alias("op"), value.alias("value")))

    word = F.col("where")[0]["value"]
    where = (
        F.when(kind == 1, one("like", word))
        .when(kind == 2, one("match", F.lit("(")))
        .when(kind == 4, one("eq", word, "fnn"))
        .when(kind == 5, F.array().cast(schemas.WHERE))
        .otherwise(F.col("where"))
    )
    shape = F.when(kind == 3, "no_shape").when(kind == 5, "jsx_attr").otherwise(F.col("shape"))
    report = F.when(kind == 5, F.array().cast("array<string>")).otherwise(F.col("report"))
    return rule_table(spark, sf).withColumns({"where": where, "shape": shape, "report": report})


# --- warehouse -----------------------------------------------------------------------

POLICIES = (
    "{}",
    '{"fail_on_severity":["error"],"block_merge":true}',
    '{"fail_on_severity":["ERROR","warning"]}',
    '{"fail_on_severity":["error"],"block_merge":"yes"}',
)


def orgs(spark: SparkSession, sf: str) -> DataFrame:
    policies = F.array(*[F.lit(p) for p in POLICIES])
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("github_org_login"),
        F.get(policies, F.col("n_nationkey") % len(POLICIES)).alias("policy_json"),
    )


def api_keys(spark: SparkSession, sf: str) -> DataFrame:
    """One key per organization, stored as a hash; every seventh has none."""
    return table(spark, sf, "nation").where("n_nationkey % 7 <> 6").select(
        F.sha2(F.concat(F.lit("key-"), F.col("n_nationkey").cast("string")), 256).alias("key_hash"),
        F.col("n_nationkey").cast("bigint").alias("org_id"),
    )


def repos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").cast("bigint").alias("org_id"),
        F.col("c_name").alias("github_repo"),
    )


def _commit_sha(scan_id: str) -> Column:
    return F.sha1(F.col(scan_id).cast("string"))


def raw_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scans without a verdict."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("repo_id"),
        _commit_sha("o_orderkey").alias("commit_sha"),
        F.col("o_orderpriority").alias("branch"),
        F.col("o_orderdate").alias("created_at"),
    )


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings; the id starts with a date, so its order is the order of arrival."""
    flag = F.col("l_returnflag")
    severity = F.when(flag == "R", "error").when(flag == "A", "warning").otherwise("note")

    def padded(name: str, width: int) -> Column:
        return F.lpad(F.col(name).cast("string"), width, "0")

    return table(spark, sf, "lineitem").select(
        F.concat_ws(
            "-",
            F.date_format("l_shipdate", "yyyyMMdd"),
            padded("l_orderkey", 12),
            padded("l_linenumber", 4),
            padded("l_partkey", 12),
            padded("l_suppkey", 12),
        ).alias("id"),
        F.col("l_orderkey").alias("scan_id"),
        F.concat(F.lit("rule-"), (F.col("l_partkey") % 37).cast("string"), F.lit("-"), F.lower(flag)).alias("rule_id"),
        severity.alias("severity"),
        F.concat(F.lit("src/"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file_path"),
        F.col("l_linenumber").alias("line_number"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("message"),
    )


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    scans = raw_scans(spark, sf)
    policies = policy.scan_policies(scans, repos(spark, sf), orgs(spark, sf))
    return policy.evaluate(findings(spark, sf), policies)


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scans with the verdict of the gate."""
    judged = verdicts(spark, sf).select(F.col("scan_id").alias("id"), "passed")
    return raw_scans(spark, sf).join(judged, "id")


def _submitted(x: Column, kind: Column) -> Column:
    """A finding as a result of a submitted document, see :func:`submissions`."""
    line = x["line_number"].cast("bigint")
    region = F.struct(
        line.alias("startLine"),
        F.lit(1).cast("bigint").alias("startColumn"),
        line.alias("endLine"),
        F.lit(2).cast("bigint").alias("endColumn"),
        F.struct(x["message"].alias("text")).alias("snippet"),
    )
    place = F.struct(F.struct(x["file_path"].alias("uri")).alias("artifactLocation"), region.alias("region"))
    places = F.array(F.struct(place.alias("physicalLocation")))
    return F.struct(
        x["rule_id"].alias("ruleId"),
        F.struct(x["message"].alias("text")).alias("message"),
        F.slice(places, F.lit(1), F.when(kind == 9, 0).otherwise(1)).alias("locations"),
    )


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """A SARIF document per scan; some kinds are broken or odd, by scan id modulo 11.

    3: no version (refused); 5: empty rule list (all notes); 7: rules listed twice, first
    with level none (last wins); 9: results without a location.
    """
    # a finding moves once; hashes and documents, which are many times as large as the rows
    # they come from, are made after the last join
    item = F.struct("rule_id", "message", "file_path", "line_number", "severity")
    items = findings(spark, sf).groupBy("scan_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    owners = repos(spark, sf).select(
        F.col("id").alias("repo_id"), "org_id", F.col("github_repo").alias("repo")
    )
    base = raw_scans(spark, sf).drop("commit_sha").join(owners, "repo_id")
    joined = base.join(items, base["id"] == items["scan_id"], "left")
    kind = F.col("id") % 11
    firsts = F.filter(
        "items",
        lambda x, k: (k == 0) | (F.get("items", k - 1)["rule_id"] != x["rule_id"]),
    )
    joined = joined.withColumns(
        {
            "results": F.transform("items", lambda x: _submitted(x, kind)),
            "rules": F.transform(
                firsts, lambda x: report._rule_entry(x.withField("rule_name", x["rule_id"]))
            ),
        }
    )
    rules_type = "array<struct<id:string,name:string,shortDescription:struct<text:string>,defaultConfiguration:struct<level:string>>>"
    rules = F.coalesce("rules", F.array().cast(rules_type))
    odd = F.transform(
        rules,
        lambda r: F.struct(
            r["id"].alias("id"),
            r["name"].alias("name"),
            r["shortDescription"].alias("shortDescription"),
            F.struct(F.lit("none").alias("level")).alias("defaultConfiguration"),
        ),
    )
    rules = (
        F.when(kind == 5, F.array().cast(rules_type))
        .when(kind == 7, F.concat(odd, rules))
        .otherwise(rules)
    )
    results = F.coalesce("results", F.array().cast(joined.schema["results"].dataType))
    text = F.to_json(report._log(rules, results))
    broken = F.replace(text, F.lit(f'"version":"{schemas.SARIF_VERSION}",'), F.lit(""))
    return joined.select(
        F.concat(F.col("id").cast("string"), F.lit("-0")).alias("submission_id"),
        F.concat(F.lit("key-"), F.col("org_id").cast("string")).alias("key"),
        F.when(kind == 3, broken).otherwise(text).alias("sarif"),
        "repo",
        _commit_sha("id").alias("commit_sha"),
        "branch",
        F.col("created_at").alias("submitted_at"),
    )
