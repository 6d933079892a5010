"""Dense volumes as bricks: one row holds a block of voxels, and steps that look around exchange borders only.

A table of bricks (volume_id, bx, by, bz, nx, ny, nz, reach, data) is bucketed by its key, so joins of bricks with bricks of the same place move
nothing. Each brick sends copies of its border layers to the neighbours that they touch, which is the one shuffle of a step; inside a brick NumPy works on
the block with its halo. Points that a displacement takes further than the halo go on to the bricks they fall into and come back in a second pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .grids import DIMS

KEY = ["volume_id", "bx", "by", "bz"]
SIDE = 32
_AROUND = [d for d in product((-1, 0, 1), repeat=3) if d != (0, 0, 0)]
_SLAB = "array<struct<dx: int, dy: int, dz: int, data: binary>>"


def bucketed(df: DataFrame) -> DataFrame:
    """Bricks written as a table bucketed by their key: later joins on the key read it without a shuffle, and lineage ends there."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    name = f"bricks_{uuid.uuid4().hex}"
    df.repartition(n, *KEY).write.bucketBy(n, *KEY).sortBy(*KEY).option("path", new_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def as_meta(volume: DataFrame, dims) -> DataFrame:
    """volume_id, nx, ny, nz: ``dims`` itself if it is such a table, else these dims for each volume."""
    if isinstance(dims, DataFrame):
        return dims.select("volume_id", *DIMS)
    return volume.select("volume_id").distinct().select("volume_id", *(F.lit(int(n)).alias(c) for n, c in zip(dims, DIMS, strict=True)))


def _sizes(at, dims, side: int) -> tuple[int, ...]:
    """Voxels of the brick at ``at`` along each axis: the last ones are cut by the grid."""
    return tuple(min(side, n - b * side) for b, n in zip(at, dims, strict=True))


def to_bricks(volume: DataFrame, dims, values: tuple[str, ...] = ("value",), side: int = SIDE, channels: int = 0) -> DataFrame:
    """Bricks of voxel rows (volume_id, x, y, z and values); voxels that have no row are 0, and bricks without any row are left out.

    With ``channels`` the one value belongs to the channel (0, 1, ...) that the column ``channel`` names.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        at = [int(head[c]) for c in KEY[1:]]
        dims = [int(head[c]) for c in DIMS]
        data = np.zeros((channels or len(values), *_sizes(at, dims, side)))
        place = tuple(rows[c].to_numpy() - b * side for c, b in zip("xyz", at, strict=True))
        if channels:
            data[(rows["channel"].to_numpy(), *place)] = rows[values[0]].to_numpy(float)
        for k, v in enumerate(values if not channels else ()):
            data[k][place] = rows[v].to_numpy(float)
        return pd.DataFrame({"volume_id": [head["volume_id"]], **{c: [v] for c, v in zip([*KEY[1:], *DIMS], [*at, *dims], strict=True)}, "reach": [np.abs(data).max(initial=0.0)], "data": [data.tobytes()]})

    rows = volume.join(as_meta(volume, dims), "volume_id")
    rows = rows.withColumns({f"b{c}": F.floor(F.col(c) / side).cast("int") for c in "xyz"})
    kept = rows.select(*KEY, *DIMS, "x", "y", "z", *values, *(["channel"] if channels else []))
    schema = "volume_id string, bx int, by int, bz int, nx int, ny int, nz int, reach double, data binary"
    return bucketed(kept.groupBy(*KEY).applyInPandas(work, schema))


def from_bricks(bricks: DataFrame, values: tuple[str, ...] = ("value",), side: int = SIDE, nonzero: bool = False) -> DataFrame:
    """volume_id, x, y, z and values of every voxel of the bricks, or of those where some value isn't 0."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = [row[c] for c in KEY[1:]]
                data = np.frombuffer(row["data"]).reshape(len(values), *_sizes(at, [row[c] for c in DIMS], side))
                place = [i.ravel() for i in np.indices(data.shape[1:], np.int32)]
                flat = data.reshape(len(values), -1)
                keep = np.flatnonzero(flat.any(0)) if nonzero else slice(None)
                columns = [pa.array(p[keep] + np.int32(b * side)) for p, b in zip(place, at, strict=True)] + [pa.array(f[keep]) for f in flat]
                yield pa.RecordBatch.from_arrays([pa.array([row["volume_id"]] * len(columns[0]), pa.string()), *columns], names=["volume_id", "x", "y", "z", *values])

    schema = "volume_id string, x int, y int, z int, " + ", ".join(f"{v} double" for v in values)
    return bricks.select(*KEY, *DIMS, "data").mapInArrow(work, schema)


def _array(raw: bytes, sizes) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, *sizes)


def _rows(*columns: pa.Array):
    return zip(*(c.to_pylist() for c in columns), strict=True)


def borders(bricks: DataFrame, halo: int, side: int = SIDE) -> DataFrame:
    """KEY and dims of each neighbour that a brick touches, and ``slabs``: the layers that its neighbours lend it, by direction to the lender.

    At most 26 slabs a brick. Only these layers are shuffled.
    """

    def cut(bx, by, bz, nx, ny, nz, data):
        out = []
        for *at, a, b, c, raw in _rows(bx, by, bz, nx, ny, nz, data):
            dims = (a, b, c)
            block = _array(raw, _sizes(at, dims, side))
            slabs = []
            for d in _AROUND:
                if all(0 <= (p + s) * side < n for p, s, n in zip(at, d, dims, strict=True)):
                    part = tuple(slice(None) if s == 0 else slice(-halo, None) if s > 0 else slice(0, halo) for s in d)
                    slabs.append({"dx": d[0], "dy": d[1], "dz": d[2], "data": np.ascontiguousarray(block[(slice(None), *part)]).tobytes()})
            out.append(slabs)
        return pa.array(out, pa.list_(pa.struct([("dx", pa.int32()), ("dy", pa.int32()), ("dz", pa.int32()), ("data", pa.binary())])))

    lent = F.arrow_udf(cut, _SLAB)(*KEY[1:], *DIMS, "data")
    each = bricks.select(*KEY, *DIMS, F.explode(lent).alias("s"))
    to = [(F.col(f"b{c}") + F.col(f"s.d{c}")).alias(f"b{c}") for c in "xyz"]
    back = F.struct(*((-F.col(f"s.d{c}")).alias(f"d{c}") for c in "xyz"), F.col("s.data").alias("data"))
    moved = each.select("volume_id", *to, *DIMS, back.alias("slab"))
    return moved.groupBy(*KEY).agg(*(F.first(n).alias(f"_{n}") for n in DIMS), F.collect_list("slab").alias("slabs"))


def padded(data: bytes | None, slabs: list | None, at, dims, halo: int, channels: int, side: int) -> np.ndarray:
    """A brick's block with its halo around it; what no neighbour lends is 0."""
    sizes = _sizes(at, dims, side)
    out = np.zeros((channels, *(n + 2 * halo for n in sizes)))
    if data is not None:
        out[(slice(None), *(slice(halo, halo + n) for n in sizes))] = _array(data, sizes)
    for slab in slabs or []:
        d = [slab["dx"], slab["dy"], slab["dz"]]
        own = _sizes([p + s for p, s in zip(at, d, strict=True)], dims, side)
        shape = [n if s == 0 else min(halo, n) for s, n in zip(d, own, strict=True)]
        start = [halo if s == 0 else halo + n if s > 0 else 0 for s, n in zip(d, sizes, strict=True)]
        out[(slice(None), *(slice(a, a + w) for a, w in zip(start, shape, strict=True)))] = np.frombuffer(slab["data"]).reshape(-1, *shape)
    return out


def around(bricks: DataFrame, halo: int, work: Callable[[np.ndarray], np.ndarray], channels: int = 1, side: int = SIDE) -> DataFrame:
    """Each brick by ``work`` of its block with a halo (channels, x, y, z), which gives the block back with the halo still around it.

    Bricks that were left out as empty come up where a neighbour lends them something. The grid's outside is 0 before and after.
    """
    if halo > side:
        raise ValueError(f"a halo of {halo} is wider than a brick of {side}")

    def run(bx, by, bz, nx, ny, nz, data, slabs):
        out = []
        for *at, a, b, c, raw, lent in _rows(bx, by, bz, nx, ny, nz, data, slabs):
            dims = (a, b, c)
            block = work(padded(raw, lent, at, dims, halo, channels, side))
            inner = block[(slice(None), *(slice(halo, halo + n) for n in _sizes(at, dims, side)))]
            out.append({"data": np.ascontiguousarray(inner, float).tobytes(), "reach": float(np.abs(inner).max(initial=0.0))})
        return pa.array(out, pa.struct([("data", pa.binary()), ("reach", pa.float64())]))

    both = bricks.join(borders(bricks, halo, side), KEY, "full_outer")
    both = both.withColumns({n: F.coalesce(n, f"_{n}") for n in DIMS})
    done = both.withColumn("_r", F.arrow_udf(run, "struct<data: binary, reach: double>")(*KEY[1:], *DIMS, "data", "slabs"))
    return bucketed(done.select(*KEY, *DIMS, F.col("_r.reach").alias("reach"), F.col("_r.data").alias("data")))


# Sampling at displaced places


def _targets(disp: np.ndarray, at, dims, side: int, clamp: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where each voxel of a brick is taken (3, voxels), and whether that is inside the grid."""
    place = np.indices(disp.shape[1:], float).reshape(3, -1) + np.array(at, float)[:, None] * side + disp.reshape(3, -1)
    top = np.array(dims, float)[:, None] - 1
    if clamp:
        return np.clip(place, 0, top), np.ones(place.shape[1], bool)
    return place, ((place >= 0) & (place <= top)).all(0)


def _corners(place: np.ndarray, nearest: bool):
    """Corner voxels (3, points) and their weights, those of weight 0 included."""
    if nearest:
        yield np.floor(place + 0.5).astype(np.int64), np.ones(place.shape[1])
        return
    low = np.floor(place).astype(np.int64)
    part = place - low
    for d in product((0, 1), repeat=3):
        step = np.array(d)[:, None]
        yield low + step, np.where(step == 1, part, 1 - part).prod(0)


def _reach(bricks: DataFrame) -> float:
    return bricks.agg(F.max("reach")).first()[0] or 0.0


def sample(field: DataFrame, source: DataFrame, channels: int, combine: str = "value", clamp: bool = False, nearest: bool = False, halo: int | None = None, side: int = SIDE) -> DataFrame:
    """Bricks of source(p + field(p)) for each voxel p of the field's bricks, trilinear or nearest.

    Places outside the grid give 0, or with ``clamp`` the edge. ``combine``: the value, "add" the field to it, or its "negative". The halo
    is as wide as the largest displacement asks for, at most a brick; what goes beyond it is fetched in a second pass.
    """
    if halo is None:
        halo = int(np.ceil(_reach(field))) + 1
    halo = max(1, min(side, halo))
    sign = -1.0 if combine == "negative" else 1.0

    def run(bx, by, bz, nx, ny, nz, disp, data, slabs):
        out = []
        for *at, a, b, c, moves, raw, lent in _rows(bx, by, bz, nx, ny, nz, disp, data, slabs):
            dims, d = (a, b, c), _array(moves, _sizes(at, (a, b, c), side))
            block = padded(raw, lent, at, dims, halo, channels, side)
            place, inside = _targets(d, at, dims, side, clamp)
            total, far = np.zeros((channels, place.shape[1])), np.zeros(place.shape[1], bool)
            base = np.array(at)[:, None] * side - halo
            bound = np.array(block.shape[1:])[:, None]
            for corner, w in _corners(place, nearest):
                local = corner - base
                near = ((local >= 0) & (local < bound)).all(0)
                used = inside & (w > 0)
                far |= used & ~near
                k = np.flatnonzero(used & near)
                total[:, k] += w[k] * block[(slice(None), *local[:, k])]
            total[:, far] = 0.0
            result = sign * total + (d.reshape(3, -1) if combine == "add" else 0.0)
            k = np.flatnonzero(far)
            out.append({"data": result.tobytes(), "reach": float(np.abs(result).max(initial=0.0)), "far": np.concatenate([k.astype(float)[None], place[:, k]]).tobytes()})
        return pa.array(out, pa.struct([("data", pa.binary()), ("reach", pa.float64()), ("far", pa.binary())]))

    known = source.select(*KEY, F.col("data").alias("_source"))
    lent = borders(source, halo, side).select(*KEY, "slabs")
    both = field.join(known, KEY, "left").join(lent, KEY, "left")
    r = F.arrow_udf(run, "struct<data: binary, reach: double, far: binary>")(*KEY[1:], *DIMS, "data", "_source", "slabs")
    done = bucketed(both.withColumn("_r", r).select(*KEY, *DIMS, "_r.reach", "_r.data", "_r.far"))
    if not done.where(F.length("far") > 0).isEmpty():
        done = bucketed(_fetch_far(done, known, channels, sign, nearest, side))
    return done.select(*KEY, *DIMS, "reach", "data")


def _fetch_far(done: DataFrame, known: DataFrame, channels: int, sign: float, nearest: bool, side: int) -> DataFrame:
    """Second pass: places out of a halo's reach are sent to the bricks that hold their corners, by brick, and what is found there is added."""
    items = pa.list_(pa.struct([("bx", pa.int32()), ("by", pa.int32()), ("bz", pa.int32()), ("items", pa.binary())]))

    def send(nx, ny, nz, far):
        out = []
        for a, b, c, raw in _rows(nx, ny, nz, far):
            rows = np.frombuffer(raw).reshape(4, -1)
            found = [(rows[0], *corner, w) for corner, w in _corners(rows[1:], nearest)]
            k, x, y, z, w = (np.concatenate(v) for v in zip(*found, strict=True))
            use = w > 0
            k, at, w = k[use], np.stack([x, y, z])[:, use], w[use]
            brick = at // side
            local = at - brick * side
            shape = [np.minimum(side, n - q * side) for n, q in zip((a, b, c), brick, strict=True)]
            index = (local[0] * shape[1] + local[1]) * shape[2] + local[2]
            keys, group = np.unique(brick, axis=1, return_inverse=True)
            group = group.ravel()
            out.append([{"bx": int(t[0]), "by": int(t[1]), "bz": int(t[2]), "items": np.stack([k[group == g], index[group == g].astype(float), w[group == g]]).tobytes()} for g, t in enumerate(keys.T)])
        return pa.array(out, items)

    def gather(rows, data):
        out = []
        for raw, block in _rows(rows, data):
            k, index, w = np.frombuffer(raw).reshape(3, -1)
            values = np.frombuffer(block).reshape(channels, -1)[:, index.astype(np.int64)] * w
            out.append(np.concatenate([k[None], values]).tobytes())
        return pa.array(out, pa.binary())

    def add(data, found):
        out = []
        for raw, parts in _rows(data, found):
            total = np.frombuffer(raw).reshape(channels, -1).copy()
            for part in parts or []:
                part = np.frombuffer(part).reshape(channels + 1, -1)
                for ch in range(channels):
                    np.add.at(total[ch], part[0].astype(np.int64), sign * part[1 + ch])
            out.append({"data": total.tobytes(), "reach": float(np.abs(total).max(initial=0.0))})
        return pa.array(out, pa.struct([("data", pa.binary()), ("reach", pa.float64())]))

    sent = F.explode(F.arrow_udf(send, "array<struct<bx: int, by: int, bz: int, items: binary>>")(*DIMS, "far"))
    origin = F.struct(*KEY).alias("origin")
    asked = done.where(F.length("far") > 0).select(origin, "volume_id", sent.alias("s"))
    asked = asked.select("origin", "volume_id", *(f"s.{c}" for c in KEY[1:]), "s.items")
    found = asked.join(known, KEY).select("origin.*", F.arrow_udf(gather, "binary")("items", "_source").alias("part"))
    found = found.groupBy(*KEY).agg(F.collect_list("part").alias("parts"))  # one for each brick that the voxels of one brick are taken to
    both = done.join(found, KEY, "left").withColumn("_r", F.arrow_udf(add, "struct<data: binary, reach: double>")("data", "parts"))
    return both.select(*KEY, *DIMS, "_r.reach", "_r.data")


def scaled(bricks: DataFrame, factor: float) -> DataFrame:
    """All values times a number, in place: nothing is moved."""

    def run(data):
        return pa.array([(np.frombuffer(raw) * factor).tobytes() for raw in data.to_pylist()], pa.binary())

    out = bricks.select(*KEY, *DIMS, (F.col("reach") * abs(factor)).alias("reach"), F.arrow_udf(run, "binary")("data").alias("data"))
    return bucketed(out)
