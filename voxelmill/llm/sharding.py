"""Shards by vector bin packing (operator 7).

Groups of equal texts are placed so that bytes, tokens and rows come out even together: each goes, largest first, where
the dot product of its shares with a shard's remaining shares is highest. Groups with a share above
1 / (SMALL * shards), at most 3 * SMALL * shards of them, are placed on the driver. All others are placed by the same rule in
parallel: each task has its part of what the large groups left of every shard, in proportion to what its groups hold, and places
them within that. A task misses its part by about one small group, so the shards come out even however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, number_rows, partitions, table

SHARDS, SMALL = 40, 400
KEY = ["group", "text_crc32", "size"]


def place(shares: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each item (rows of shares of each measure), largest item first; ``room`` (shards, measures) is what remains and is used up."""
    out = np.zeros(len(shares), np.int64)
    for k in np.argsort(-shares.max(1), kind="stable").tolist():
        out[k] = best = int(np.argmax(room @ shares[k]))
        room[best] -= shares[k]
    return out


def _place_small(groups: DataFrame, totals: np.ndarray, room: np.ndarray) -> DataFrame:
    """KEY and shard of each group, placed within each task's part of the room."""
    spare = np.maximum(room, 0)
    spare /= np.maximum(spare.sum(0), 1e-300)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in KEY])
            shares = np.stack([t.column(c).to_numpy() for c in "btr"], 1) / totals
            shard = place(shares, spare * shares.sum(0))
            cols = [t.column(c).combine_chunks() for c in KEY]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shard, pa.int32())], names=[*KEY, "shard"])

    return groups.select(*KEY, "b", "t", "r").mapInArrow(work, "group long, text_crc32 long, size long, shard int")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, by the law ``bytes``.

    Equal texts share a shard unless together they have more of the bytes, tokens or rows than a shard's equal part; the rows of such a group are
    numbered and dealt in turn into parts of half a shard at most, which are placed each. Null texts count as empty. Slots run from 0 without gaps in each shard;
    repeated rows and null doc_ids take slots of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
    )
    rows = materialise(rows, "sizes")
    groups = rows.groupBy(*KEY).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    groups = materialise(groups, "groups")
    totals = np.array([float(x or 1) for x in groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).first()])
    big = F.greatest(*(F.col(c) / x for c, x in zip("btr", totals.tolist(), strict=True))) > 1 / (SMALL * shards)
    large = groups.where(big).orderBy(*KEY).collect()  # 3 * SMALL * shards at most
    parts, shares = [], []
    for g in large:
        share = np.array([g.b, g.t, g.r]) / totals
        n = 1 if share.max() <= 1 / shards else int(np.ceil(2 * shards * share.max()))
        parts += [(g.group, g.text_crc32, g.size, n, k) for k in range(n)]
        shares += [share / n] * n
    room = np.full((shards, 3), 1 / shards)
    where = place(np.array(shares).reshape(-1, 3), room).tolist()
    key = "group long, text_crc32 long, size long"
    whole = spark.createDataFrame([(*p[:3], s) for p, s in zip(parts, where, strict=True) if p[3] == 1], key + ", shard int")
    split = spark.createDataFrame([(*p, s) for p, s in zip(parts, where, strict=True) if p[3] > 1], key + ", parts int, part int, shard int")
    small = materialise(_place_small(groups.where(~big), totals, room), "placed")
    split_keys = F.broadcast(split.select(*KEY, "parts").distinct())  # 3 * shards at most, as each has more than a shard's part
    out = rows.drop("tokens").join(split_keys.drop("parts"), KEY, "left_anti").join(small.unionByName(whole), KEY)
    if any(p[3] > 1 for p in parts):
        dealt = materialise(rows.drop("tokens").join(split_keys, KEY), "split-rows")
        dealt = number_rows(dealt, KEY, ["doc_id"], F.col("doc_id"), partitions(spark), "rank").withColumn("part", (F.col("rank") % F.col("parts")).cast("int"))
        dealt = dealt.drop("parts").join(F.broadcast(split.drop("parts")), [*KEY, "part"])
        out = out.unionByName(dealt.select(*out.columns))
    out = materialise(out.select("doc_id", "size", "text_crc32", "shard", "group"), "sharded")
    out = number_rows(out, ["shard"], ["doc_id", "group"], F.struct("doc_id", "group"), partitions(spark), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
