"""The overlap and scoring aggregates over streams of voxels (an extension beside the batch forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_overlap(mask: DataFrame, atlas: DataFrame) -> DataFrame:
    """Running voxel counts by volume and label of a stream of mask voxels (volume_id, vid); label 0 is outside."""
    labelled = mask.join(atlas.select("vid", "label"), "vid", "left")
    return labelled.groupBy("volume_id", F.coalesce("label", F.lit(0)).alias("label")).agg(F.count(F.lit(1)).alias("voxels"))


def stream_confusion(pairs: DataFrame) -> DataFrame:
    """Running tp, fp, fn of a stream of (case_id, pred, truth) flags."""
    p, t = F.col("pred") == 1, F.col("truth") == 1
    return pairs.groupBy("case_id").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and value sums of events by type and time window; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
