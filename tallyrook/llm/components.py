"""Connected components of a table of links, by large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm.shared import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: every node hands its least neighbour (or itself) to its larger ones; small: to its smaller ones and itself."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    told = both.join(least, "a")
    if large:
        found = told.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        found = told.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return found.filter("a != b").distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each node is linked with one smaller node only, or with larger ones only."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")))
    nodes = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return not nodes.agg(F.max((F.col("smaller") + F.col("larger") > 1).cast("int"))).first()[0]


def connected_components(links: DataFrame) -> DataFrame:
    """node and label, the least node that it is linked to over any number of links, for each node of links (a, b long).

    A round halves distances, so few rounds are needed, and none for links that say the labels already; each is written to the shared
    folder. Nulls are no nodes.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = cut(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while not _stars(links):
        links = cut(_star(_star(links, large=True), large=False))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
