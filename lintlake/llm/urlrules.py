"""URL filter: allow and block rules for a host with its subdomains and a path prefix.

A host's canonical key is its labels in reverse order, each followed by a dot, so
``a.example.net`` becomes ``net.example.a.``.  The hosts below a rule's host are then exactly
the keys in the interval ``[net., net/)`` (``/`` is the character after ``.``).  Rule intervals
nest or are disjoint, so a sweep over the sorted keys with a stack of open rules knows at each
host which rules may apply; the path decides among them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.sources.storage import shared_folder, stored

RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<size:int,rule:string,path:string,verdict:string>>"


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Text after the host up to ``?`` or ``#``; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``rule, path, verdict, key`` of (verdict, host and path) pairs."""
    table = spark.createDataFrame(list(rules), "verdict string, rule string").dropDuplicates()
    at = F.instr("rule", "/")
    return table.select(
        "verdict",
        "rule",
        F.expr("substring(rule, instr(rule, '/'))").alias("path"),
        host_key(F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)).alias("key"),
    ).where(at > 0)


def segments(rules: DataFrame) -> DataFrame:
    """``key, stack``: from each interval border on, the rules that are open there.

    A border is where a rule's interval starts or ends.  The rules open at a border are those
    whose key is a whole-label prefix of it, longest rule first.
    """
    ends = F.expr("concat(substring(key, 1, length(key) - 1), '/')")
    borders = rules.select("key").union(rules.select(ends.alias("key"))).distinct()
    labels = F.split("key", r"\.", -1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda n: F.concat(F.concat_ws(".", F.slice(labels, F.lit(1), n)), F.lit(".")),
    )
    open_here = borders.select(F.col("key").alias("border"), F.explode(prefixes).alias("key"))
    entry = F.struct((-F.length("rule")).alias("size"), "rule", "path", "verdict")
    found = open_here.join(rules, "key").groupBy("border").agg(F.collect_set(entry).alias("stack"))
    longest = F.array_sort("stack")
    return (
        borders.join(found, borders.key == found.border, "left")
        .select("key", F.coalesce(longest, F.array()).cast(STACK).alias("stack"))
    )


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, stack`` for each distinct ``host``: the rules open at it, by a sorted sweep.

    Borders and host keys are merged into one order, dealt out by range.  Within a range the
    stack of the last border is carried on; a range starts with the stack the ranges before it
    ended on, of which there is one row for each partition.
    """
    keyed = hosts.select("host", host_key(F.col("host")).alias("key"), F.lit(1).alias("turn"))
    keyed = keyed.withColumn("stack", F.lit(None).cast(STACK))
    borders = segments(rules).select(
        F.lit(None).cast("string").alias("host"), "key", F.lit(0).alias("turn"), "stack"
    )
    merged = keyed.unionByName(borders).repartitionByRange("key")
    merged = merged.withColumn("part", F.spark_partition_id())
    merged = stored(merged, f"{shared_folder(hosts.sparkSession)}/merged")
    inside = Window.partitionBy("part").orderBy("key", "turn")
    swept = merged.withColumn("own", F.last("stack", ignorenulls=True).over(inside))
    ends = merged.groupBy("part").agg(
        F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("end")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.last("end", ignorenulls=True).over(before).alias("entry"))
    return (
        swept.where("host is not null")
        .join(ends, "part")
        .select("host", F.coalesce("own", "entry", F.array().cast(STACK)).alias("stack"))
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    default: str = "allow",
    url: str = "url",
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` by the longest fitting rule.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with the
    rule's path; of equally long rules the first in text order wins.  A url that no rule fits
    has a null rule and the ``default`` verdict; so has a url that is null or lacks ``://``,
    whose host and path are empty.  Repeated rows are judged each; columns of these names in
    the input are replaced; an empty table gives an empty one.
    """
    taken = {"host", "path", "rule", "verdict", "stack"}
    kept = pages.select([c for c in pages.columns if c.lower() not in taken])
    split = kept.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    table = rule_table(pages.sparkSession, rules)
    stacks = active_rules(split.select("host").distinct(), table)
    fits = F.filter("stack", lambda e: F.col("path").startswith(e["path"]))
    return (
        split.join(stacks, "host", "left")
        .withColumn("won", F.try_element_at(fits, F.lit(1)))
        .withColumn("rule", F.col("won.rule"))
        .withColumn("verdict", F.coalesce("won.verdict", F.lit(default)))
        .drop("stack", "won")
    )
