"""Quantiles, histograms, moments and boxes of volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .order import quantile


def abs_quantile(volume: DataFrame, q: float) -> DataFrame:
    """volume_id, cutoff: the exact interpolated quantile of each volume's absolute values; 0 for q <= 0, the maximum for q >= 1."""
    a = F.abs(F.col("value"))
    if 0 < q < 1:
        return quantile(volume.select("volume_id", a.alias("a")), "a", q, ["volume_id"])
    return volume.groupBy("volume_id").agg((F.lit(0.0) if q <= 0 else F.max(a)).alias("cutoff"))


def percentile_mask(volume: DataFrame, q: float, symmetric: bool = False) -> DataFrame:
    """Voxels strictly beyond the quantile of their volume's absolute values, by value or by absolute value. The volumes are computed once."""
    volume = written(volume)
    cut = abs_quantile(volume, q)  # a row for each volume
    return volume.join(cut, "volume_id").where((F.abs(F.col("value")) if symmetric else F.col("value")) > F.col("cutoff")).select(*volume.columns)


def histogram(volume: DataFrame, bins: int = 4096) -> DataFrame:
    """volume_id, bin, n, cumulative, low, high of the nonempty bins."""
    ends = volume.groupBy("volume_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    place = F.floor((F.col("value") - F.col("low")) * (bins - 1) / span + 0.5)
    counts = volume.join(ends, "volume_id").groupBy("volume_id", "low", "high", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy("volume_id").orderBy("bin")))


def percentile_window(volume: DataFrame, low: float = 0.02, high: float = 0.998, bins: int = 4096) -> DataFrame:
    """volume_id, low_bin, high_bin, low_value, high_value: first bins whose cumulative count reaches floor(n * share)."""
    h = histogram(volume, bins).withColumn("total", F.sum("n").over(Window.partitionBy("volume_id")))
    first = lambda q: F.min(F.when(F.col("cumulative") >= F.floor(F.col("total") * q), F.col("bin")))
    out = h.groupBy("volume_id").agg(first(low).alias("low_bin"), first(high).alias("high_bin"), F.min("low").alias("lo"), F.min("high").alias("hi"))
    value = lambda b: F.col("lo") + F.col(b) * (F.col("hi") - F.col("lo")) / (bins - 1)
    return out.select("volume_id", "low_bin", "high_bin", value("low_bin").alias("low_value"), value("high_bin").alias("high_value"))


def moments(mask: DataFrame) -> DataFrame:
    """Per volume the number of voxels, centroid and population covariance of a mask."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return mask.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs))


def centroid(mask: DataFrame) -> tuple[float, float, float]:
    """The centroid of a mask of one volume; raises where there is none or more than one."""
    rows = moments(mask).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("an empty mask has no centroid" if not rows else "a centroid of several volumes was asked for; use moments")
    return rows[0].cx, rows[0].cy, rows[0].cz


def bounding_box(volume: DataFrame, dims, margin: int = 0, positive: bool = False, full_if_empty: bool = False) -> DataFrame:
    """Per volume x0, y0, z0 and the exclusive ends x1, y1, z1 around nonzero (or positive) voxels, clamped to the grid.

    ``dims`` are three numbers for all volumes, or names of columns of ``volume`` that hold each one's own. A volume without such voxels has nulls, or
    its whole grid, and ``empty`` true.
    """
    some = F.col("value") > 0 if positive else F.col("value") != 0
    size = {c: F.max(n) if isinstance(n, str) else F.lit(n) for c, n in zip("xyz", dims, strict=True)}
    found = volume.groupBy("volume_id").agg(
        F.count_if(some).alias("_n"), *(f(F.when(some, F.col(c))).alias(f"_{k}{c}") for c in "xyz" for k, f in (("a", F.min), ("b", F.max))), *(n.alias(f"_n{c}") for c, n in size.items())
    )
    empty, out = F.col("_n") == 0, ["volume_id", (F.col("_n") == 0).alias("empty")]
    for c in "xyz":
        n = F.col(f"_n{c}")
        ends = F.greatest(F.lit(0), F.col(f"_a{c}") - margin), F.least(n, F.col(f"_b{c}") + 1 + margin)
        for k, (end, whole) in enumerate(zip(ends, (F.lit(0), n), strict=True)):
            out.append(F.when(~empty, end).otherwise(whole if full_if_empty else F.lit(None)).cast("int").alias(f"{c}{k}"))
    return found.select(*out)


def value_stats(volume: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    return volume.groupBy(*(by or [])).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count_if(F.col("value") >= threshold).alias("over")
    )
