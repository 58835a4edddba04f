"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.sources.storage import shared_folder, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _lowest(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest of each node and its neighbours, by partial minima."""
    return (
        _both_ways(links)
        .groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("root"))
    )


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: root is the smallest node reachable.

    First every node is replaced by the smallest of itself and its neighbours, which shrinks
    dense groups to a few nodes.  Then each round takes the smallest label among a node and its
    neighbours and the label of that label, so a path shortens by half or more per round.
    Minima are partial aggregates and the joins are plain ones that Spark can split, so a node
    with very many links needs no task of its own.  Labels are written below
    ``spark.checkpoint.dir`` after each round, which cuts the lineage and survives lost
    executors.  No links give no rows; null ends and links of a node to itself are ignored;
    repeated links change nothing.  Tables of the rounds go below ``folder``, by default a new one.
    """
    folder = folder or shared_folder(links.sparkSession)
    given = links.where("a is not null and b is not null and a <> b")
    given = given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    given = stored(given.distinct(), f"{folder}/given")
    first = stored(_lowest(given), f"{folder}/first")
    merged = given
    for end in ("a", "b"):
        to = first.select(F.col("node").alias(end), F.col("root").alias("to"))
        merged = merged.join(to, end).drop(end).withColumnRenamed("to", end)
    both = stored(_both_ways(merged.where("a <> b")).distinct(), f"{folder}/links")
    labels = stored(_lowest(both), f"{folder}/labels-0")
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("low"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("root").alias("before"), F.least("root", "low").alias("root")
        )
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        new = lower.join(jump, "root").select(
            "node", "before", F.least("root", "beyond").alias("root")
        )
        new = stored(new, f"{folder}/labels-{turn}")
        if new.where("root <> before").isEmpty():
            break
        labels = new.select("node", "root")
    last = new.select(F.col("node").alias("root"), F.col("root").alias("end"))
    return first.join(last, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
