"""Channel packs: Parquet partitioned by shard, and the packed binary form with its JSON index."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_MAJOR, FORTRAN = {"row-major", "c-order"}, {"nifti", "f-order", "fortran"}
CHANNELS_A_SHARD = 40


def write_pack(pack: DataFrame, path: str, per_shard: int = CHANNELS_A_SHARD) -> None:
    """pack: channel, vid, t. Each shard of channels is one Parquet partition, so that readers skip the others."""
    pack.withColumn("shard", F.floor((F.col("channel") - 1) / per_shard).cast("int")).repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def read_pack(spark: SparkSession, path: str, channels: list[int] | None = None, per_shard: int = CHANNELS_A_SHARD) -> DataFrame:
    """The pack, or only the shards that hold the channels asked for; raises if none does."""
    pack = spark.read.parquet(path)
    if not channels:
        return pack
    shards = sorted({(c - 1) // per_shard for c in channels})
    out = pack.where(F.col("shard").isin(shards)).where(F.col("channel").isin(channels))
    if out.isEmpty():
        raise ValueError(f"no shard holds channels {channels}")
    return out


def half_floats(raw: bytes) -> np.ndarray:
    """Little-endian IEEE half floats, subnormal values included."""
    return np.frombuffer(raw, "<f2").astype(np.float32)


def index(text: str) -> dict:
    """A pack index with its voxel order checked; row-major if it names none."""
    out = json.loads(text)
    out.setdefault("voxelOrder", "row-major")
    if out["voxelOrder"] not in ROW_MAJOR | FORTRAN:
        raise ValueError(f"unknown voxel order {out['voxelOrder']}")
    if out.get("dtype", "float32") not in ("float16", "float32"):
        raise ValueError(f"unknown dtype {out['dtype']}")
    return out


def decode_pack(files: DataFrame, described: dict) -> DataFrame:
    """channel (from 1), x, y, z, t of packed maps. files: first_channel, content, one row a shard."""
    n, *dims = described["shape"]
    size = int(np.prod(dims))
    half, order = described.get("dtype") == "float16", "F" if described["voxelOrder"] in FORTRAN else "C"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.unravel_index(np.arange(size), dims, order=order)
        for b in batches:
            for first, raw in zip(b["first_channel"], b["content"], strict=True):
                values = half_floats(raw) if half else np.frombuffer(raw, "<f4")
                if len(values) % size:
                    raise ValueError("the pack's length doesn't fit its shape")
                for k in range(len(values) // size):
                    yield pd.DataFrame({"channel": first + k, "x": places[0], "y": places[1], "z": places[2], "t": values[k * size : (k + 1) * size]})

    return files.select("first_channel", "content").mapInPandas(run, "channel int, x int, y int, z int, t float")


def encode_shards(pack: DataFrame, dims, per_shard: int = CHANNELS_A_SHARD) -> DataFrame:
    """shard, channel_labels, bytes, checksum, content of row-major half floats; one shard is one group of bounded size."""
    size = int(np.prod(dims))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        labels = sorted(rows["channel"].unique().tolist())
        out = np.zeros((len(labels), *dims), "<f2")
        out[rows["channel"].map({c: k for k, c in enumerate(labels)}), rows["x"], rows["y"], rows["z"]] = rows["t"]
        raw = out.reshape(len(labels), size).tobytes()
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "channel_labels": [[str(c) for c in labels]], "content": [raw]})

    shards = pack.withColumn("shard", F.floor((F.col("channel") - 1) / per_shard).cast("int")).groupBy("shard").applyInPandas(run, "shard int, channel_labels array<string>, content binary")
    return shards.select("shard", "channel_labels", F.length("content").alias("bytes"), F.sha2("content", 256).alias("checksum"), "content")


def profile_json(profile: DataFrame, profile_id: str) -> DataFrame:
    """One row: the profile (network, term, score, rank, ord) as JSON text that read_profiles takes, its bytes and SHA-256.

    A profile has one entry for each network with its few terms, so it is one small document; networks are in alphabetical order, terms in order of ``ord``.
    """
    term = F.struct("ord", F.struct("term", "score", "rank").alias("t"))
    nets = profile.groupBy("network").agg(F.transform(F.sort_array(F.collect_list(term)), lambda x: x["t"]).alias("terms"))
    whole = nets.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("network", "terms")))).alias("networkProfiles"))
    text = F.to_json(F.struct(F.lit(profile_id).alias("id"), "networkProfiles"), {"pretty": "true"})
    return whole.select(text.alias("value")).select("value", F.octet_length("value").alias("bytes"), F.sha2("value", 256).alias("checksum"))


def read_profiles(spark: SparkSession, path: str, asset_id: str | None = None) -> DataFrame:
    """network, term, score, rank, ord of a profile JSON; its id must match and it must have networkProfiles."""
    raw = spark.read.text(path, wholetext=True)
    kind = "struct<id:string,networkProfiles:map<string,array<struct<term:string,score:double,rank:int>>>>"
    doc = raw.select(F.from_json("value", kind).alias("d")).select("d.*")
    row = doc.select("id", F.col("networkProfiles").isNull().alias("bare")).first()
    if row is None or row.bare or (asset_id is not None and row.id != asset_id):
        raise ValueError(f"{path} is not the profile {asset_id}")
    nets = doc.select(F.explode("networkProfiles").alias("network", "terms"))
    terms = nets.select("network", F.posexplode("terms").alias("ord", "p"))
    return terms.select("network", "p.term", "p.score", "p.rank", "ord")
