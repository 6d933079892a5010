"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialise


def _step(links: DataFrame, large: bool) -> DataFrame:
    """One star step of (a > b) links: neighbours are linked to the least one instead."""
    if large:
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        out = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        out = links.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): of each linked id the least id that it reaches, by alternating large and small stars.

    links: a, b (long, in any order). Minima are combined before each shuffle, and joins on a busy id
    are split by Spark's skew handling. Ids without links are not returned.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, name)
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("id"), F.col("b").alias("component"))
            ).distinct()
        before, old = now, links
        links = materialise(_step(_step(links, True), False), name)
        drop(old)
