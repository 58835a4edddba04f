"""A training-data pipeline over documents; each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import linedup, packing, simhash, templates, toxicity
from lintlake.llm.graph import components
from lintlake.sources.storage import discard, shared_folder, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; all documents stay."""
    kept = linedup.dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint"))
    return kept.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id.

    Near copies have SimHash fingerprints that differ in 2 bits at most, found by the pivot
    distance table, or 0.8 of their five-word shingles in common; a group follows links of both
    kinds.  Documents without words are no copies of each other, and rows without an id can't be
    named, so both stay.
    """
    folder = shared_folder(spark)
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    prints = simhash.near_duplicates(worded).select("doc_id", "component_id")
    found = simhash.similar_texts(docs, folder=folder).select("doc_id", "component_id")
    links = prints.union(found).toDF("a", "b")
    joined = components(links, f"{folder}/joined")
    gone = joined.where("node <> root").select(F.col("node").alias("doc_id"))
    gone = stored(gone, f"{shared_folder(spark)}/gone")
    discard(spark, folder)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return templates.without_leaks(docs, benchmark).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens in sequences of 2048."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written below the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/stage-{number}")
    return docs


#: Tokens and a trained classifier are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
