"""Ranking of functional terms by network weights, and profiles of parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .elementwise import finite
from .overlap import UNASSIGNED


def rank_terms(weights: DataFrame, profile: DataFrame, top: int = 8, least: float = 0.01, contributors: int = 3) -> DataFrame:
    """term, score and the networks that add most to it, best first.

    weights: network, fraction; profile: network, term, score, ord. Terms that differ in case or outer blanks are one, shown as first seen.
    Unassigned, networks without a profile and weights or scores that are not positive add nothing.
    """
    use = weights.where((F.col("fraction") > 0) & finite(F.col("fraction")) & (F.col("network") != UNASSIGNED))
    terms = profile.where((F.col("score") > 0) & finite(F.col("score"))).withColumn("key", F.lower(F.trim("term")))
    parts = terms.join(use, "network").select("key", "term", "ord", "network", (F.col("fraction") * F.col("score")).alias("part"))
    by_network = parts.groupBy("key", "network").agg(F.sum("part").alias("part"), F.min(F.struct("ord", "term")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("part"), "network"))
    ranked = by_network.withColumn("r", rank)
    pair = F.when(F.col("r") <= contributors, F.struct("r", "network", "part"))
    merged = ranked.groupBy("key").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"), F.sort_array(F.collect_list(pair)).alias("c"))
    out = merged.where(F.col("score") >= least).select(F.trim("seen.term").alias("term"), "score", F.col("c.network").alias("contributors"), F.col("c.part").alias("parts"))
    return out.orderBy(F.desc("score"), "term").limit(top)


def distinct_labels(atlas: DataFrame, expected: int | None = None) -> DataFrame:
    """The positive labels of an atlas in ascending order; raises if there aren't as many as expected."""
    labels = atlas.where("label > 0").select("label").distinct().orderBy("label")
    if expected is not None and (n := labels.count()) != expected:
        raise ValueError(f"{n} labels, not {expected}")
    return labels


def keep_term(term: Column, stop_words: list[str]) -> Column:
    """Non-empty, not a stop word, of three characters at least, and not only digits."""
    t = F.lower(F.trim(term))
    return (F.length(t) >= 3) & ~t.isin(stop_words) & ~t.rlike("^[0-9]+$")


def roi_association(activation: DataFrame, weights: DataFrame) -> DataFrame:
    """parcel, term, r: Pearson r over studies of mean activation in the parcel and the term's weight. Constant series give null."""
    mean = activation.groupBy("study", "parcel").agg(F.avg("value").alias("a"))
    both = mean.join(weights, "study")
    g = both.groupBy("parcel", "term").agg(
        F.covar_pop("a", "weight").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("weight").alias("sw")
    )
    return g.select("parcel", "term", F.try_divide(F.col("c"), F.col("sa") * F.col("sw")).alias("r"))


def parcel_profiles(association: DataFrame, top: int = 8, least: float = 0.0) -> DataFrame:
    """The best terms of each parcel, ranked after weak ones are left out."""
    rank = F.row_number().over(Window.partitionBy("parcel").orderBy(F.desc("r"), "term"))
    return association.where(F.col("r") > least).withColumn("rank", rank).where(F.col("rank") <= top)
