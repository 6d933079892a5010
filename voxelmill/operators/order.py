"""Ranks and order statistics of groups of any size: rows are dealt into sorted ranges, and counts of ranges give each its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _dealt(df: DataFrame, groups: list[str], order: list[str], size: Column) -> DataFrame:
    """df in sorted ranges, with _part, the rows before the range in its group (_before, rows weighed by ``size``) and those of the group, n."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = written(df.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*groups, "_part").agg(F.sum(size).alias("_c"))  # a row for each range
    w = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(counts.withColumn("_before", before).withColumn("n", F.sum("_c").over(w)).drop("_c"), [*groups, "_part"])


def ranked(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds r, the row's number from 0 in its group's order, and n, the rows of the group; no task holds more than a range of rows.

    The order should tell most rows apart, as rows that it doesn't are one range; ``value_ranks`` is for those that are often equal.
    """
    out = _dealt(df, groups, order, F.lit(1))
    here = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)) - 1
    return out.withColumn("r", here + F.col("_before")).drop("_part", "_before")


def value_ranks(rows: DataFrame, groups: list[str], column: str) -> DataFrame:
    """Of each distinct value of a group: ``first``, the rank from 0 of its first row, ``c``, its rows, and n, the rows of the group.

    Equal values are counted before they are shuffled, so however often one comes up, a range holds it once.
    """
    counts = written(rows.groupBy(*groups, column).agg(F.count(F.lit(1)).alias("c")))  # else the rows would be computed again to find the ranges
    out = _dealt(counts, groups, [column], F.col("c"))
    here = Window.partitionBy(*groups, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("first", F.coalesce(F.sum("c").over(here), F.lit(0)) + F.col("_before")).drop("_part", "_before")


def _at(rank: Column) -> Column:
    return (F.col("first") <= rank) & (rank < F.col("first") + F.col("c"))


def at_shares(rows: DataFrame, last: int = 0, **shares: float) -> DataFrame:
    """Per volume the values at floor(share * (n - last)) of the ascending order."""
    found = value_ranks(rows.select("volume_id", "value"), ["volume_id"], "value")
    rank = lambda q: F.least(F.floor((F.col("n") - last) * q), F.col("n") - 1)
    return found.groupBy("volume_id").agg(*(F.min(F.when(_at(rank(q)), F.col("value"))).alias(k) for k, q in shares.items()))


def quantile(rows: DataFrame, column: str, q: float, by: list[str]) -> DataFrame:
    """``cutoff`` of each group that has values: the interpolated quantile of a column."""
    found = value_ranks(rows.select(*by, F.col(column).cast("double").alias("v")).where("v is not null"), by, "v")
    place = (F.col("n") - 1) * F.lit(float(q))
    low = F.max(F.when(_at(F.floor(place)), F.col("v")))
    high = F.max(F.when(_at(F.ceil(place)), F.col("v")))
    return found.groupBy(*by).agg((low + (high - low) * F.max(place - F.floor(place))).alias("cutoff"))
