"""Rules as data: a small rule set on the driver and the same rules as a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lintlake import schemas
from lintlake.operators.shapes import Condition
from lintlake.sources.storage import shared_folder, stored

_REQUIRED = ("id", "name", "severity", "language", "query", "message")


@dataclass(frozen=True)
class Rule:
    """One rule: a shape, the tests on its captures and the captures it reports."""

    id: str
    name: str
    severity: str
    language: str
    message: str
    shape: str
    where: tuple[Condition, ...] = ()
    report: tuple[str, ...] = ()
    metadata: str | None = None
    rule_no: int = 0


class RuleSet:
    """Rules in file order; ``rule_no`` is the position."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = [
            Rule(**{**r.__dict__, "rule_no": n}) for n, r in enumerate(rules)
        ]

    def __iter__(self) -> Iterator[Rule]:
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)

    def for_language(self, language: str) -> RuleSet:
        """Rules of a language, in any ASCII case."""
        return RuleSet(r for r in self if r.language.lower() == language.lower())

    def only(self, ids: str) -> RuleSet:
        """Rules named in a comma list; unknown ids are passed over."""
        wanted = {x.strip() for x in ids.split(",")}
        return RuleSet(r for r in self if r.id in wanted)

    def get(self, rule_id: str) -> Rule:
        return next(r for r in self if r.id == rule_id)

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = schemas.struct_of(schemas.RULES)
        # from Arrow, Spark knows the table's size when it chooses a join
        rows = pa.Table.from_pylist(_rule_values(self), to_arrow_schema(schema))
        return spark.createDataFrame(rows, schema)


def _rule_values(rules: Iterable[Rule]) -> list[dict[str, Any]]:
    return [
        {**r.__dict__, "where": [c.__dict__ for c in r.where], "report": list(r.report)}
        for r in rules
    ]


def _from_mapping(n: int, raw: Any) -> Rule:
    if not isinstance(raw, dict):
        raise ValueError(f"rule {n}: not a mapping")
    name = raw.get("id", n)
    for field in _REQUIRED:
        if field not in raw:
            raise ValueError(f"rule {name}: missing field {field}")
        if field != "query" and not isinstance(raw[field], str):
            raise ValueError(f"rule {name}: field {field} is not a string")
    if raw["severity"] not in schemas.SEVERITIES:
        raise ValueError(f"rule {name}: unknown severity {raw['severity']}")
    query = raw["query"]
    if not isinstance(query, dict) or "shape" not in query:
        raise ValueError(f"rule {name}: query must be a mapping with a shape")
    where = [Condition(**w) for w in query.get("where", [])]
    report = query.get("report") or list(dict.fromkeys(c.capture for c in where))
    metadata = raw.get("metadata")
    return Rule(
        id=raw["id"],
        name=raw["name"],
        severity=raw["severity"],
        language=raw["language"],
        message=raw["message"],
        shape=query["shape"],
        where=tuple(where),
        report=tuple(report),
        metadata=None if metadata is None else json.dumps(metadata),
    )


def parse_rules(text: str) -> RuleSet:
    """Rules from YAML text; one bad rule refuses the whole file, extra fields are ignored.

    ``query`` is a mapping ``{shape, where: [{capture, op, value}], report: [capture]}``.
    """
    import yaml

    # the loader in C, where there is one, reads the same ten times as fast
    doc = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    if not isinstance(doc, dict) or not isinstance(doc.get("rules"), list):
        raise ValueError("rules file has no list of rules")
    return RuleSet(_from_mapping(n, r) for n, r in enumerate(doc["rules"]))


def _rule_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )


def load_rules(spark: SparkSession, path: str) -> RuleSet:
    """Rules from a YAML file, or all files of a folder or pattern, in the order of their paths.

    For as many rules as a driver holds; :func:`read_rules` takes any number.
    """
    files = _rule_files(spark, path)
    texts = [r.value for r in files.orderBy("path").collect()]
    if not texts:
        raise ValueError(f"rules file not found or empty: {path}")
    return RuleSet(rule for text in texts for rule in parse_rules(text))


# --- the same operators on rule tables ----------------------------------------------


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of :func:`load_rules` as a table (``schemas.RULES``), each file parsed in a task.

    ``rule_no`` counts on over the files in the order of their paths; one bad rule refuses all.
    Files are parsed once and their rules kept below the shared folder.
    """
    files = _rule_files(spark, path)
    if files.isEmpty():
        raise ValueError(f"rules file not found or empty: {path}")
    fields = schemas.struct_of(schemas.RULES)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                rules = pa.Table.from_pylist(_rule_values(parse_rules(text)), arrow)
                names = pa.array([name] * len(rules), pa.string())
                yield from rules.append_column("path", names).to_batches()

    parsed = files.mapInArrow(run, f"{schemas.RULES}, path string")
    rows = stored(parsed, f"{shared_folder(spark)}/rules")
    # a row for each file
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    number = (F.col("start") + F.col("rule_no")).cast("int").alias("rule_no")
    numbered = rows.join(starts, "path")
    return numbered.select(*[number if n == "rule_no" else n for n in fields.names])


def rules_for_language(rules: DataFrame, language: str) -> DataFrame:
    return rules.where(F.lower("language") == language.lower())


def rules_with_ids(rules: DataFrame, ids: str) -> DataFrame:
    """Rules named in a comma list: trimmed, case-sensitive, unknown ids passed over."""
    return rules.where(F.col("id").isin([x.strip() for x in ids.split(",")]))


def rule_lines(rules: DataFrame) -> DataFrame:
    """One listing line per rule."""
    line = F.format_string("  %s - %s (%s)", "id", "name", "severity")
    return rules.select("rule_no", line.alias("line"))


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy(F.lower("language").alias("language")).agg(
        F.count(F.lit(1)).alias("rules")
    )


def merge_rules(files: Sequence[DataFrame]) -> DataFrame:
    """Rule files as one set in file order; all rules are kept, equal ids too."""
    parts = [
        f.withColumn("file_no", F.lit(n)).withColumnRenamed("rule_no", "line_no")
        for n, f in enumerate(files)
    ]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged


def duplicate_ids(rules: DataFrame) -> DataFrame:
    """Rule ids given more than once."""
    counted = rules.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return counted.where(F.col("copies") > 1)


def severity_or_null(text: Column) -> Column:
    """The severity when it is one of the known lower-case names, else null."""
    return F.when(text.isin(*schemas.SEVERITIES), text)
