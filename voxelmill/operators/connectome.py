"""Group connectivity: region series, correlations, Fisher z and group t."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def region_series(series: DataFrame) -> DataFrame:
    """Mean series of each region: (subject, region, t, value)."""
    return series.groupBy("subject", "region", "t").agg(F.avg("value").alias("value"))


#: Regions or voxels of one side of a block.
BLOCK_REGIONS = 512


def _blocks(series: DataFrame, size: int) -> int:
    regions = series.agg(F.approx_count_distinct("region")).first()[0]
    return max(1, -(-regions // size))


def correlations(a: DataFrame, b: DataFrame, scale_by_sample: bool = True, size: int = BLOCK_REGIONS) -> DataFrame:
    """subject, source, target, n, r of series (subject, region, t, value; one value a time) over the times that both have.

    The regions or voxels of both sides are dealt into blocks of about ``size``, and each block of sources is multiplied with each block of targets as
    matrices: a task holds two blocks, a series is copied once for each block of the other side, and no row is made for a pair and a time. r is scaled by (n - 1) / n, as products of sample z-scores divided by n are; constant series give null.
    """
    # Both sides may come from one table, so their columns are named apart.
    one = lambda df, s, name, t, v: df.select(F.col("subject").alias(s), F.col("region").cast("string").alias(name), F.col("t").alias(t), F.col("value").cast("double").alias(v))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows, columns = _blocks(a, size), _blocks(b, size)
    x = one(a, "subject", "source", "t", "x").withColumns({"row": own("source", rows)}).withColumn("column", every(columns))
    y = one(b, "of", "target", "time", "y").withColumns({"part": own("target", columns)}).withColumn("line", every(rows))

    def table(subject, source, target, n, r) -> pd.DataFrame:
        text = lambda c: pd.Series(list(c), dtype=object)
        return pd.DataFrame({"subject": pd.Series([subject] * len(n), dtype=type(subject) if not isinstance(subject, str) else object), "source": text(source), "target": text(target), "n": n, "r": r})

    def multiply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        times = [] if left.empty or right.empty else np.intersect1d(left["t"], right["time"])
        if not len(times):
            return table(key[0], [], [], np.zeros(0, np.int64), np.zeros(0))
        sides = ((left, "source", "t", "x"), (right, "target", "time", "y"))
        rows = [d.pivot_table(index=c, columns=t, values=v, dropna=False).reindex(columns=times) for d, c, t, v in sides]
        (u, mu), (v, mv) = ((np.nan_to_num((m := r.to_numpy(float)) - np.nanmean(m, 1, keepdims=True)), (~np.isnan(m)).astype(float)) for r in rows)
        n = mu @ mv.T
        with np.errstate(all="ignore"):
            su, sv = u @ mv.T / n, mu @ v.T / n
            var = lambda q, s, full: np.where(q / n - s * s > 1e-24 * full, q / n - s * s, np.nan)
            vu, vv = var(u**2 @ mv.T, su, (u**2).max() + 1), var(mu @ (v**2).T, sv, (v**2).max() + 1)
            r = (u @ v.T / n - su * sv) / np.sqrt(vu * vv)
        i, j = np.nonzero(n)
        k = n[i, j]
        found = np.where(np.isnan(r[i, j]), None, r[i, j] * ((k - 1) / k if scale_by_sample else 1))
        names = [r.index.to_numpy(object) for r in rows]
        return table(key[0], names[0][i], names[1][j], k.astype(np.int64), found.astype(float))

    kind = a.schema["subject"].dataType.simpleString()
    out = x.groupBy("subject", "row", "column").cogroup(y.groupBy("of", "line", "part")).applyInPandas(multiply, f"subject {kind}, source string, target string, n long, r double")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def fisher_z(r, limit: float = 0.999):
    return F.atanh(F.greatest(F.least(r, F.lit(limit)), F.lit(-limit)))


def group_t(z: DataFrame, by: list[str], sample: bool = True, floor: float = 1e-6) -> DataFrame:
    """n, mean_z and t of z over subjects; deviation of the sample or of the population, one subject counts as no deviation."""
    std = F.coalesce(F.stddev_samp("z") if sample else F.stddev_pop("z"), F.lit(0.0))
    sem = F.greatest(std / F.sqrt(F.count(F.lit(1))), F.lit(floor))
    return z.where("z is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"), (F.avg("z") / sem).alias("t"))


def group_connectome(series: DataFrame, sample: bool = True) -> DataFrame:
    """t of every pair of regions."""
    return group_t(subject_z(series), ["source", "target"], sample)


# Mergeable moments: a stored state to which new subjects are added without reading old ones


def subject_z(series: DataFrame) -> DataFrame:
    """subject, source, target, z of every pair of regions that has more than two times."""
    means = region_series(series)
    r = correlations(means, means).where("source <> target and n > 2")
    return r.select("subject", "source", "target", fisher_z(F.col("r")).alias("z"))


def pair_state(z: DataFrame, by: list[str]) -> DataFrame:
    """by, n, s1, s2: the number of values of z, their sum and the sum of their squares. States of disjoint subjects add up."""
    return z.where("z is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s1"), F.sum(F.col("z") * F.col("z")).alias("s2"))


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    return states.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2")))


def add_run(state: DataFrame, folder: str, run: str) -> None:
    """Stores the state of one run of subjects. A run that is stored again replaces itself, so a repeated job counts nobody twice; other runs aren't read."""
    state.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)


def stored_state(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """The state of all runs of a folder."""
    return merged(spark.read.parquet(folder), by)


def state_t(state: DataFrame, by: list[str], sample: bool = True, floor: float = 1e-6) -> DataFrame:
    """What group_t gives for all values that a state has seen."""
    n, mean = F.col("n"), F.col("s1") / F.col("n")
    spread = F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * mean)
    std = F.when(n > 1, F.sqrt(spread / (n - 1 if sample else n))).otherwise(0.0)
    return state.select(*by, "n", mean.alias("mean_z"), (mean / F.greatest(std / F.sqrt(n), F.lit(floor))).alias("t"))
