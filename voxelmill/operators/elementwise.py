"""Projections and filters over voxel tables (volume_id, vid, x, y, z, value), one row a voxel.

Statistics are joined per volume rather than taken by windows, so that they are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import at_shares, ranked

def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def with_stats(volume: DataFrame, **stats: Column) -> DataFrame:
    per = volume.groupBy("volume_id").agg(*(c.alias(k) for k, c in stats.items()))
    return volume.join(per, "volume_id")


def half_up(c: Column) -> Column:
    """Rounding of halves upwards, also for negative values."""
    return F.floor(c + 0.5)


def binarise(volume: DataFrame) -> DataFrame:
    return volume.where(F.col("value") > 0)


def above(volume: DataFrame, threshold: float, symmetric: bool = False) -> DataFrame:
    return volume.where((F.abs(F.col("value")) if symmetric else F.col("value")) > threshold)


def below(volume: DataFrame, border: float) -> DataFrame:
    return volume.where(F.col("value") < border)


def at_least(blend: DataFrame, threshold: float) -> DataFrame:
    """Voxels of a weighted blend (p, w) whose ratio reaches the threshold; those without weight drop out."""
    return blend.where((F.col("w") > 0) & (F.col("p") >= threshold * F.col("w")))


def foreground(volume: DataFrame, share: float = 0.05) -> DataFrame:
    return with_stats(volume, top=F.max("value")).where(F.col("value") > share * F.col("top")).drop("top")


def foreground_or_centre(volume: DataFrame, dims, share: float = 0.05) -> DataFrame:
    """The foreground, or the centre voxel of a volume that has none."""
    found = foreground(volume, share)
    nx, ny, nz = dims
    x, y, z = nx // 2, ny // 2, nz // 2
    empty = volume.select("volume_id").distinct().join(found.select("volume_id").distinct(), "volume_id", "left_anti")
    centre = empty.withColumns({"vid": F.lit(x + nx * (y + ny * z)), "x": F.lit(x), "y": F.lit(y), "z": F.lit(z), "value": F.lit(1.0)})
    return found.unionByName(centre.select(*found.columns))


def z_score(volume: DataFrame) -> DataFrame:
    """Population z-score; a constant volume is divided by 1."""
    out = with_stats(volume, m=F.avg("value"), s=F.stddev_pop("value"))
    return out.withColumn("value", (F.col("value") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).drop("m", "s")


def z_score_nonzero(volume: DataFrame) -> DataFrame:
    """z-score by the finite nonzero values; all finite values are shifted, the others become 0."""
    some = F.when(finite(F.col("value")) & (F.col("value") != 0), F.col("value"))
    out = with_stats(volume, m=F.avg(some), s=F.stddev_pop(some))
    m, s = F.coalesce("m", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    shifted = (F.col("value") - m) / F.when(s == 0, 1.0).otherwise(s)
    return out.withColumn("value", F.when(finite(F.col("value")), shifted).otherwise(0.0)).drop("m", "s")


def p99_normalise(volume: DataFrame) -> DataFrame:
    """Subtract the minimum, divide by the nonzero value at rank floor(0.99 n), clamp to [0, 1]."""
    low = with_stats(volume, low=F.min("value")).withColumn("value", F.col("value") - F.col("low")).drop("low")
    top = at_shares(low.where(F.col("value") > 0).select("volume_id", "value"), top=0.99)
    ratio = F.when(F.coalesce("top", F.lit(0.0)) > 0, F.col("value") / F.col("top")).otherwise(F.col("value"))
    return low.join(top, "volume_id", "left").withColumn("value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))).drop("top")


def robust_normalise(volume: DataFrame, mask: DataFrame | None = None, zero_outside: bool = False, sample: int = 200_000) -> DataFrame:
    """Scale by the values at floor(0.01 (n - 1)) and floor(0.99 (n - 1)) of a strided sample of the masked values, clamp to [0, 1].

    NaN counts as 0 in the sample. A volume of which the mask holds no voxel raises when it is computed.
    """
    inside = volume if mask is None else volume.join(mask.select("volume_id", "vid"), ["volume_id", "vid"], "left_semi")
    sampled = ranked(inside.select("volume_id", "vid", "value"), ["volume_id"], ["vid"])
    sampled = sampled.where(F.col("r") % F.greatest(F.lit(1), F.floor(F.col("n") / sample)) == 0)
    ends = at_shares(sampled.select("volume_id", F.nanvl(F.col("value").cast("double"), F.lit(0.0)).alias("value")), 1, lo=0.01, hi=0.99)
    ends = volume.select("volume_id").distinct().join(ends, "volume_id", "left")
    ends = ends.withColumn("lo", F.when(F.col("lo").isNull(), F.raise_error(F.concat(F.lit("no voxel of the mask is in "), "volume_id"))).otherwise(F.col("lo")))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    out = volume.join(ends, "volume_id").withColumn("value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("lo")) / span))).drop("lo", "hi")
    if mask is not None and zero_outside:
        flag = mask.select("volume_id", "vid", F.lit(True).alias("in_mask"))
        out = out.join(flag, ["volume_id", "vid"], "left").withColumn("value", F.when(F.col("in_mask"), F.col("value")).otherwise(0.0)).drop("in_mask")
    return out


def min_max(volume: DataFrame) -> DataFrame:
    out = with_stats(volume, lo=F.min("value"), hi=F.max("value"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return out.withColumn("value", (F.col("value") - F.col("lo")) / span).drop("lo", "hi")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def collapse_logits(lesion: Column, background: Column) -> Column:
    return lesion - background


def softmax(logits: Column, channel: int) -> Column:
    """Probability of one channel of an array of logits, by shifted exponentials with a floor on their sum."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.exp(F.get(logits, F.lit(channel)) - top) / F.greatest(total, F.lit(1e-12))


def magnitude(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def checkerboard(a: DataFrame, b: DataFrame, block: int = 8) -> DataFrame:
    """Blocks of a and b in turn; even blocks are from a."""
    both = a.join(b.select("volume_id", "vid", F.col("value").alias("other")), ["volume_id", "vid"])
    parity = (F.floor(F.col("x") / block) + F.floor(F.col("y") / block) + F.floor(F.col("z") / block)) % 2
    return both.withColumn("value", F.when(parity == 0, F.col("value")).otherwise(F.col("other"))).drop("other")


def clean_label(c: Column) -> Column:
    return F.greatest(half_up(c), F.lit(0).cast("long"))


def label_base(atlas: DataFrame) -> DataFrame:
    """The voxels of an atlas that have a label."""
    return atlas.where("label > 0")


def min_voxels(summary: DataFrame, n: float, column: str = "voxels") -> DataFrame:
    return summary if int(n) <= 1 else summary.where(F.col(column) >= int(n))


def parcel_colour(label: Column) -> Column:
    """An RGB struct by golden-angle hue, saturation 0.65 and brightness 0.95."""
    h = (label * 137.508) % 360 / 60
    v, c = 0.95, 0.95 * 0.65
    x = c * (1 - F.abs(h % 2 - 1))
    zero, full = F.lit(0.0), F.lit(c)
    table = [(full, x, zero), (x, full, zero), (zero, full, x), (zero, x, full), (x, zero, full), (full, zero, x)]
    pick = lambda k: F.coalesce(*(F.when(F.floor(h) == s, t[k]) for s, t in enumerate(table)))
    return F.struct(*(half_up((pick(k) + (v - c)) * 255).cast("int").alias(n) for k, n in enumerate("rgb")))


def clean_parcel_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("7Networks_LH_"), F.lit("LH_")), F.lit("7Networks_RH_"), F.lit("RH_"))


def finite_range(volume: DataFrame) -> DataFrame:
    v = F.when(finite(F.col("value")), F.col("value"))
    return volume.groupBy("volume_id").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.max(F.abs(v)).alias("top"))
