"""Channel packs: weights of channels and the weighted sum of their maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.pack import CHANNELS_A_SHARD
from .overlap import UNASSIGNED


def network_weights(channels: DataFrame, summary: DataFrame) -> DataFrame:
    """channel, w: the fraction of the channel's network, 0 if it has none; Unassigned has no channel."""
    known = summary.where(F.col("network") != UNASSIGNED).select("network", "fraction")
    return channels.join(known, "network", "left").select("channel", F.coalesce("fraction", F.lit(0.0)).alias("w"))


def parcel_weights(labels: DataFrame, parcels: DataFrame) -> DataFrame:
    """label, w of numeric labels given as strings; labels that the mask misses weigh 0."""
    hit = parcels.select(F.col("label").cast("string").alias("label"), F.col("fraction_of_lesion").alias("w"))
    out = labels.select(F.col("label").cast("string").alias("label")).join(hit, "label", "left")
    return out.select("label", F.coalesce("w", F.lit(0.0)).alias("w")).orderBy(F.col("label").cast("int"))


def weighted_sum(pack: DataFrame, weights: DataFrame) -> DataFrame:
    """vid, value = sum of w * t over channels of nonzero weight. Weights are at most one row a channel."""
    some = weights.where("w <> 0")
    return pack.join(some, "channel").groupBy("vid").agg(F.sum(F.col("w") * F.col("t")).alias("value"))


#: Weights that are broadcast at most; a weight is a row of some 20 bytes.
BROADCAST_WEIGHTS = 100_000


def weighted_sum_of_shards(spark: SparkSession, path: str, weights: DataFrame, per_shard: int = CHANNELS_A_SHARD) -> DataFrame:
    """weighted_sum of a pack in shards (see sources.pack.write_pack): shards whose channels all weigh 0 are pruned while the query runs.

    The weights are computed once; with up to BROADCAST_WEIGHTS of them their shards become a filter on the partitions of the scan. Beyond
    that the join is shuffled, and all shards are read.
    """
    shard = F.floor((F.col("channel") - 1) / per_shard).cast("int")
    some = written(weights.select("channel", "w", shard.alias("shard"))).where("w <> 0")
    pack = spark.read.parquet(path)
    side = F.broadcast(some) if some.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS else some
    return pack.join(side, ["shard", "channel"]).groupBy("vid").agg(F.sum(F.col("w") * F.col("t")).alias("value"))


def requested_shards(shards: DataFrame, requested: DataFrame) -> DataFrame:
    """Shards that hold a requested channel label. shards: shard, channel_labels (array)."""
    listed = shards.select("shard", F.explode("channel_labels").alias("channel_label"))
    return listed.join(requested.select("channel_label"), "channel_label", "left_semi").select("shard").distinct()


def map_stats(volume: DataFrame, strong: float = 5.0) -> DataFrame:
    v = F.col("value")
    return volume.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(F.abs(v) > strong).alias("strong"))
