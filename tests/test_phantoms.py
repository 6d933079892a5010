"""Small inputs of our own: random volumes against plain Python and NumPy, and a few answers worked out by hand."""

import collections
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill import model
from voxelmill.functions import scalars
from voxelmill.operators import connect, connectome, elementwise, evaluate, geometry, morphology, order, overlap, rank, registration, score, stats, steps
from voxelmill.sources import assets, nifti, pack
from voxelmill.streaming import overlap as streaming


def volume(spark, values, name="v"):
    """values: {(x, y, z): value}"""
    return spark.createDataFrame([(name, *k, float(v)) for k, v in values.items()], "volume_id string, x int, y int, z int, value double")


def dense(spark, array, name="v"):
    return volume(spark, {k: array[k] for k in np.ndindex(array.shape)}, name)


def points(df):
    return {(r.x, r.y, r.z) for r in df.collect()}


def with_vid(df, dims):
    return df.withColumn("vid", geometry.linear_id(dims))


# Overlap


def random_overlap(spark, seed, extra=0):
    """A mask and an atlas of four labels on 5 x 3 x 6 voxels, as tables and as plain values."""
    rng = np.random.default_rng(seed)
    atlas = {v: int(rng.integers(0, 5)) for v in range(60)}
    mask = sorted({int(v) for v in rng.integers(0, 60, 30)} | set(range(60, 60 + extra)))
    tables = spark.createDataFrame([(v,) for v in mask], "vid int"), spark.createDataFrame([(v, k) for v, k in atlas.items() if k], "vid int, label int")
    return (*tables, mask, atlas)


@pytest.mark.parametrize("extra", [0, 11])
def test_parcel_overlap(spark, extra):
    mask, atlas, at, labels = random_overlap(spark, 3 + extra, extra)
    hits, sizes = collections.Counter(labels.get(v, 0) for v in at), collections.Counter(labels.values())
    rows = {r.label: r for r in overlap.parcel_overlap(mask, atlas).collect()}
    assert set(rows) == set(hits) - {0}
    for k, r in rows.items():
        assert (r.voxels, r.parcel_size) == (hits[k], sizes[k])
        assert (r.fraction_of_parcel, r.fraction_of_lesion) == pytest.approx((hits[k] / sizes[k], hits[k] / len(at)))
    names = spark.createDataFrame([(1, "a", "North"), (2, "b", "South"), (4, "c", "North")], "label int, parcel string, network string")
    want = {"North": hits[1] + hits[4], "South": hits[2], "Unassigned": hits[3]}
    assert {r.network: r.voxels for r in overlap.network_rollup(overlap.parcel_overlap(mask, atlas), names).collect()} == want
    total = overlap.overlap_totals(mask, atlas).first()
    assert (total.total_voxels, total.outside_voxels, total.assigned_voxels) == (len(at), hits[0], len(at) - hits[0])
    assert overlap.parcel_overlap(mask.limit(0), atlas).count() == 0


def test_overlap_csv(spark):
    rows = [("Unassigned", 50, 0.5, [8], None, None), ("North", 31, 0.31, [3, 12, 20], 62, 0.5), ("East", 19, 0.19, [5], 3000, 19 / 3000)]
    table = spark.createDataFrame(rows, "network string, voxels long, fraction double, parcels array<int>, network_size long, fraction_of_network double")
    lines = [r.line for r in overlap.overlap_csv(table).collect()]
    assert lines[1:] == ["North,31,0.3100,62,0.5000,3;12;20", "East,19,0.1900,3000,0.0063,5", "Unassigned,50,0.5000,,,8"]
    assert overlap.overlap_csv(table.limit(0)).count() == 1
    assert overlap.percent_table(table).where("network = 'North'").first().pct == "31.0"


def test_locale_order(spark):
    table = spark.createDataFrame([("Älpha", 1), ("default", 1), ("Beta", 2)], "network string, voxels int")
    assert [r.network for r in overlap.order_networks(table).collect()] == ["Beta", "Älpha", "default"]


# Channel packs


def test_weights_and_sum(spark):
    rng = np.random.default_rng(8)
    names = ["North", "East", "South", "West", "Up"]
    share = {"East": 0.45, "Up": 0.2, "Unassigned": 0.35}
    channels = spark.createDataFrame(list(enumerate(names)), "channel int, network string")
    w = connect.network_weights(channels, spark.createDataFrame(list(share.items()), "network string, fraction double"))
    assert [r.w for r in w.orderBy("channel").collect()] == [share.get(n, 0) for n in names]
    maps = rng.normal(size=(5, 6))
    rows = spark.createDataFrame([(k, v, float(maps[k, v])) for k in range(5) for v in range(6)], "channel int, vid int, t double")
    got = {r.vid: r.value for r in connect.weighted_sum(rows, w).collect()}
    assert got == pytest.approx(dict(enumerate(np.array([share.get(n, 0) for n in names]) @ maps)))
    parcels = spark.createDataFrame([(103, 0.7), (12, 0.1)], "label int, fraction_of_lesion double")
    labels = spark.createDataFrame([("103",), ("12",), ("60",)], "label string")
    assert [(r.label, r.w) for r in connect.parcel_weights(labels, parcels).collect()] == [("12", 0.1), ("60", 0.0), ("103", 0.7)]


def test_half_floats():
    """All finite codes, against their sign, exponent and fraction."""
    codes = [c for c in range(1 << 16) if (c >> 10) & 31 != 31]
    value = lambda c: (-1) ** (c >> 15) * ((c & 1023) * 2.0**-24 if not (c >> 10) & 31 else (1024 + (c & 1023)) * 2.0 ** (((c >> 10) & 31) - 25))
    assert pack.half_floats(np.array(codes, "<u2").tobytes()).tolist() == [value(c) for c in codes]


@pytest.mark.parametrize("order", ["row-major", "fortran"])
def test_pack_orders(spark, order):
    data = np.random.default_rng(1).normal(size=(3, 4, 2, 5)).astype("<f4")
    raw = b"".join(m.tobytes(order="F" if order == "fortran" else "C") for m in data)
    described = pack.index(json.dumps({"shape": [3, 4, 2, 5], "voxelOrder": order}))
    rows = pack.decode_pack(spark.createDataFrame([(1, raw)], "first_channel int, content binary"), described).collect()
    assert len(rows) == 120 and all(r.t == data[r.channel - 1, r.x, r.y, r.z] for r in rows)
    with pytest.raises(ValueError):
        pack.index('{"voxelOrder": "zigzag"}')


def test_shards_are_pruned(spark, tmp_path):
    maps = spark.createDataFrame([(k, v, float(k)) for k in range(1, 7) for v in range(3)], "channel int, vid int, t double")
    pack.write_pack(maps, str(tmp_path / "p"), 2)
    some = pack.read_pack(spark, str(tmp_path / "p"), [3], 2)
    assert {r.channel for r in some.collect()} == {3}
    assert "PartitionFilters: [isnotnull(shard" in some._jdf.queryExecution().toString() or "shard" in some._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        pack.read_pack(spark, str(tmp_path / "p"), [70], 2)
    shards = pack.encode_shards(spark.createDataFrame([(1, 0, 0, 0, 0.5), (2, 0, 0, 1, 1.5)], "channel int, x int, y int, z int, t double"), (1, 1, 2))
    row = shards.first()
    assert row.channel_labels == ["1", "2"] and row.bytes == 8 and pack.half_floats(bytes(row.content)).tolist() == [0.5, 0, 0, 1.5]


# Thresholds and statistics


def test_quantiles_and_masks(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=150).round(1)
    v = spark.createDataFrame([("v", i, i, 0, 0, float(x)) for i, x in enumerate(data)], "volume_id string, vid int, x int, y int, z int, value double").repartition(3)
    assert elementwise.above(v, 0.4).count() == (data > 0.4).sum() and elementwise.above(v, 0.4, True).count() == (abs(data) > 0.4).sum()
    for q in (0, 0.13, 0.5, 0.9, 0.99, 1):
        want = np.quantile(abs(data), q) if q else 0
        assert stats.abs_quantile(v, q).first().cutoff == pytest.approx(want)
        assert stats.percentile_mask(v, q).count() == (data > want + 1e-12).sum() and stats.percentile_mask(v, q, True).count() == (abs(data) > want + 1e-12).sum()
    assert stats.abs_quantile(v.limit(0), 0.5).count() == 0
    two = v.unionByName(v.withColumns({"volume_id": F.lit("w"), "value": F.col("value") * 3}))
    cuts = {r.volume_id: r.cutoff for r in stats.abs_quantile(two, 0.6).collect()}
    assert cuts["w"] == pytest.approx(3 * cuts["v"]) == pytest.approx(3 * np.quantile(abs(data), 0.6))
    assert stats.percentile_mask(two, 0.6).count() == 2 * stats.percentile_mask(v, 0.6).count()
    assert stats.percentile_mask(v.withColumn("value", F.lit(-2.5)), 0.7).count() == 0
    assert model.top_percent_quantile(3) == 0.97 and model.top_percent_quantile(40) == 0.9
    both = v.unionByName(v.limit(40).withColumn("volume_id", F.lit("w")))
    for name, n in (("v", 150), ("w", 40)):
        rows = order.ranked(both, ["volume_id"], ["value", "vid"]).where(F.col("volume_id") == name).orderBy("r").collect()
        assert [r.r for r in rows] == list(range(n)) and all(r.n == n for r in rows) and [r.value for r in rows] == sorted(r.value for r in rows)


def test_cluster_cleanup(spark):
    rng = np.random.default_rng(12)
    values = {(x, y, 1): 3.0 + x for x in range(4) for y in range(3)} | {(7, 0, 5): 9.0, (7, 1, 5): 8.0}
    values |= {(int(x), int(y), 3): 0.5 for x, y in rng.integers(0, 8, (20, 2))}
    cut = sorted(values.values())[-15] + 0.01  # just below the fourteen strong ones
    q = np.interp(cut, np.sort(list(values.values())), np.linspace(0, 1, len(values)))
    kept, counts = morphology.threshold_and_clean(volume(spark, values), (8, 8, 8), float(q), least=3)
    row = counts.first()
    assert (row.raw_count, row.kept_count, row.removed_by_cluster) == (14, 12, 2) and {p[2] for p in points(kept)} == {1}


def test_normalisation(spark):
    rng = np.random.default_rng(3)
    data = rng.gamma(2, 30, 211).round(3)
    v = with_vid(volume(spark, {(i, 0, 0): x for i, x in enumerate(data)}), (211, 1, 1))
    low = data - data.min()
    some = np.sort(low[low > 0])
    want = np.clip(low / some[int(len(some) * 0.99)], 0, 1)
    assert {r.x: r.value for r in elementwise.p99_normalise(v).collect()} == pytest.approx(dict(enumerate(want)))
    flat = v.withColumn("value", F.lit(0.0))
    for f in (elementwise.p99_normalise, elementwise.z_score, elementwise.min_max, elementwise.z_score_nonzero):
        assert {r.value for r in f(flat).collect()} == {0.0}
    inside = np.arange(211) % 3 == 0
    strided = np.sort(data[inside][:: len(data[inside]) // 20])
    lo, hi = strided[int((len(strided) - 1) * 0.01)], strided[int((len(strided) - 1) * 0.99)]
    want = np.where(inside, np.clip((data - lo) / (hi - lo), 0, 1), 0)
    got = elementwise.robust_normalise(v, v.where("x % 3 = 0"), True, sample=20)
    assert {r.x: r.value for r in got.collect()} == pytest.approx(dict(enumerate(want)))
    with pytest.raises(Exception, match="no voxel of the mask"):
        elementwise.robust_normalise(v, v.limit(0)).collect()
    line = elementwise.robust_normalise(with_vid(volume(spark, {(k, 0, 0): k for k in range(100)}), (100, 1, 1))).collect()
    assert sorted(r.x for r in line if r.value == 0) == [0] and sorted(r.x for r in line if r.value == 1) == [98, 99]
    odd = volume(spark, {(0, 0, 0): 1, (1, 0, 0): 3, (2, 0, 0): math.nan, (3, 0, 0): 0, (4, 0, 0): math.inf})
    assert {r.x: r.value for r in elementwise.z_score_nonzero(odd).collect()} == {0: -1.0, 1: 1.0, 2: 0.0, 3: -2.0, 4: 0.0}
    assert elementwise.at_least(spark.createDataFrame([(0.9, 2.0), (0.7, 2.0), (0.0, 0.0)], "p double, w double"), 0.4).count() == 1


def test_boxes_and_moments(spark):
    rng = np.random.default_rng(10)
    at = rng.integers((1, 4, 2), (7, 9, 5), (25, 3))
    cloud = volume(spark, {tuple(map(int, p)): 1 for p in at})
    box = lambda *a, **k: tuple(stats.bounding_box(*a, **k).first()[c] for c in ("x0", "y0", "z0", "x1", "y1", "z1"))
    lo, hi = at.min(0), at.max(0) + 1
    assert box(cloud, (9, 10, 6)) == (*lo, *hi)
    assert box(cloud, (9, 10, 6), 3) == (*np.maximum(lo - 3, 0), *np.minimum(hi + 3, (9, 10, 6)))
    dark = cloud.withColumn("value", F.lit(0.0))
    assert box(dark, (9, 10, 6)) == (None,) * 6 and box(dark, (9, 10, 6), full_if_empty=True) == (0, 0, 0, 9, 10, 6)
    two = cloud.unionByName(cloud.withColumns({"volume_id": F.lit("w"), "x": F.col("x") + 1})).withColumn("nx", F.when(F.col("volume_id") == "v", 9).otherwise(7))
    found = {r.volume_id: (r.x0, r.x1) for r in stats.bounding_box(two, ("nx", 10, 6)).collect()}
    assert found == {"v": (lo[0], hi[0]), "w": (lo[0] + 1, min(7, hi[0] + 1))}
    signed = cloud.withColumn("value", F.when(F.col("x") > 3, -1.0).otherwise(1.0))
    some = at[at[:, 0] <= 3]
    assert box(signed, (9, 10, 6), positive=True) == (*some.min(0), *(some.max(0) + 1))
    unique = np.unique(at, axis=0)
    assert stats.centroid(cloud) == pytest.approx(tuple(unique.mean(0)))
    row, cov = stats.moments(cloud).first(), np.cov(unique.T, bias=True)
    assert (row.cxx, row.cxy, row.czz) == pytest.approx((cov[0, 0], cov[0, 1], cov[2, 2]))
    with pytest.raises(ValueError):
        stats.centroid(cloud.limit(0))


# Components


def flood(at):
    """The components of a set of voxels, each as a set."""
    left, found = set(at), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            p = todo.pop()
            seen.add(p)
            for d in itertools.product((-1, 0, 1), repeat=3):
                q = tuple(int(v) for v in np.add(p, d))
                if q in left:
                    left.remove(q)
                    todo.append(q)
        found.append(seen)
    return found


@pytest.mark.parametrize(("n", "block"), [(90, 32), (90, 4), (200, 3), (330, 5)])
def test_components(spark, n, block):
    rng = np.random.default_rng(n + block)
    dims = (11, 9, 13)
    at = {tuple(map(int, p)) for p in rng.integers(0, dims, (n, 3))}
    other = {(0, 0, 0), (1, 1, 1), (10, 8, 12)}
    both = volume(spark, dict.fromkeys(at, 1), "a").unionByName(volume(spark, dict.fromkeys(other, 1), "b"))
    ids = lambda ps: min(x + 11 * (y + 9 * z) for x, y, z in ps)
    want = {("a", *p): ids(c) for c in flood(at) for p in c} | {("b", *p): ids(c) for c in flood(other) for p in c}
    labelled = morphology.label_components(both, dims, block)
    assert {(r.volume_id, r.x, r.y, r.z): r.component for r in labelled.collect()} == want
    assert morphology.component_sizes(labelled).count() == len(flood(at)) + 2
    top = sorted((len(c) for c in flood(at)), reverse=True)
    row = morphology.component_summary(labelled).where("volume_id = 'a'").first()
    assert (row.components, row.largest, row.largest_five) == (len(top), top[0], ",".join(map(str, top[:5])))
    if block == 32:
        assert morphology.remove_small(both.where("volume_id = 'a'"), dims, 3).count() == sum(k for k in top if k >= 3)


def test_long_snake_is_one_component(spark):
    line = [(x, 2 * y, 0) for y in range(8) for x in (range(15) if y % 2 == 0 else range(14, -1, -1))]
    turns = [(14 if y % 2 == 0 else 0, 2 * y + 1, 0) for y in range(7)]
    assert {r.component for r in morphology.label_components(volume(spark, dict.fromkeys(line + turns, 1)), (15, 15, 1), 6).collect()} == {0}


def test_fill_and_dilate(spark):
    room = {p: 1 for p in itertools.product(range(5), range(4), range(6)) if not (1 <= p[0] <= 2 and p[1] == 2 and 2 <= p[2] <= 4)}
    filled = morphology.keep_largest_and_fill(volume(spark, room | {(8, 8, 8): 1, (8, 7, 8): 1}), (9, 9, 9))
    assert points(filled) == set(itertools.product(range(5), range(4), range(6)))
    assert morphology.keep_largest_and_fill(volume(spark, room), (9, 9, 9)).count() == len(room)
    assert morphology.keep_largest_and_fill(volume(spark, room), (9, 9, 9), True).count() == 120
    start = {(1, 0, 3), (4, 4, 4)}
    grown = {q for p in start for q in itertools.product(range(6), repeat=3) if sum(abs(a - b) for a, b in zip(p, q, strict=True)) <= 2}
    assert points(morphology.dilate(volume(spark, dict.fromkeys(start, 1)), (6, 6, 6), 2)) == grown


# Geometry


def test_resampling(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(5, 6, 4))
    v = dense(spark, data)
    src = np.array([[1.5, 0, 0, -3], [0, 2, 0, 1], [0, 0, 1, 4], [0, 0, 0, 1]])
    dst = np.array([[0, 1.2, 0, -2], [2.5, 0, 0, 2], [0, 0, 0.8, 4.1], [0, 0, 0, 1]])
    m = np.linalg.inv(src) @ dst
    near, linear = {}, {}
    for p in itertools.product(range(4), range(5), range(6)):
        s = (m @ [*p, 1])[:3]
        q = tuple(int(np.floor(c + 0.5)) for c in s)
        near[p] = data[q] if all(0 <= c < n for c, n in zip(q, data.shape, strict=True)) else 0
        low, total = np.floor(s).astype(int), 0.0
        for d in itertools.product((0, 1), repeat=3):
            c = low + d
            if all(0 <= a < n for a, n in zip(c, data.shape, strict=True)):
                total += np.prod(1 - abs(s - c)) * data[tuple(c)]
        linear[p] = total
    got = lambda df: {(r.x, r.y, r.z): r.value for r in df.collect()}
    assert got(geometry.resample_nearest(v, src, (4, 5, 6), dst)) == pytest.approx(near)
    assert got(geometry.resample_linear(v, src, (4, 5, 6), dst)) == pytest.approx(linear, abs=1e-9)
    with pytest.raises(ValueError):
        model.inverse(np.diag([1.0, 0, 1, 1]))


def test_round_trip(spark):
    rng = np.random.default_rng(4)
    cloud = volume(spark, {tuple(map(int, p)): 1 for p in rng.integers(1, 6, (30, 3))})
    coarse, fine = np.diag([3.0, 3, 3, 1]), np.diag([1.5, 1.5, 1.5, 1])
    up = geometry.resample_mask(cloud, coarse, (14, 14, 14), fine)
    assert points(geometry.resample_mask(up, fine, (7, 7, 7), coarse)) == points(cloud)


def test_padding_and_slices(spark):
    v = dense(spark, np.arange(1.0, 25).reshape(2, 3, 4))
    padded, dims = geometry.zero_pad(v, (2, 3, 4), (4, 2, 4))
    assert dims == (4, 4, 4) and padded.count() == 64 and padded.where("value <> 0").count() == 24
    assert points(geometry.unpad(padded, (2, 3, 4))) == points(v)
    part = geometry.slice_range(v, 1, 9, 4)
    assert {p[2] for p in points(part)} == {0, 1, 2} and points(geometry.slice_embed(part, 1, (2, 3, 3), (2, 3, 4))) == {p for p in points(v) if p[2]}
    assert {p[2] for p in points(geometry.slice_embed(part, 2, (2, 3, 3), (2, 3, 4)))} == {2, 3}
    with pytest.raises(ValueError):
        geometry.slice_embed(part, 0, (2, 2, 3), (2, 3, 4))


def test_layouts(spark):
    v = volume(spark, {(1, 2, 3): 7})
    dims = (4, 5, 6)
    turned = geometry.orient(v, dims, (2, 0, 1), (True, False, False))
    assert points(turned) == {(2, 1, 2)} and points(geometry.orient_back(turned, dims, (2, 0, 1), (True, False, False))) == {(1, 2, 3)}
    padded = geometry.centre_pad(v, dims, (8, 8, 8))
    assert points(padded) == {(3, 3, 4)} and points(geometry.centre_unpad(padded, dims, (8, 8, 8))) == {(1, 2, 3)}
    assert model.conform_dims((100, 200, 400)) == (192, 256, 320)
    assert model.padded_dims((10, 128, 130), (128, 128, 128)) == (128, 128, 256)
    assert geometry.spaced_dims((10, 3, 1), (1, 1, 1), (2, 2, 2)) == (5, 2, 1)
    assert geometry.patch_starts(16, 7, 0.25) == [0, 5, 9] and geometry.patch_starts(5, 7, 0.25) == [0]
    assert model.orientation(np.diag([-1.0, 2, 3, 1])) == ((0, 1, 2), (True, False, False))
    moved = np.eye(4)
    moved[0, 3] = 1
    assert geometry.view_overlap((3, 3, 3), np.eye(4), (3, 3, 3), np.eye(4)) == 1.0
    assert geometry.view_overlap((3, 3, 3), np.eye(4), (3, 3, 3), moved) == pytest.approx(2 / 3)
    flipped = geometry.flip_patch(spark.createDataFrame([(0, 1, 2)], "ix int, iy int, iz int"), (4, 4, 4), (0, 2)).first()
    assert tuple(flipped) == (3, 1, 1)
    assert model.target_spacing((96, 96, 96), (1, 1, 1), (191, 191, 191)) == 1.0
    assert model.target_spacing((256, 256, 256), (1, 1, 1), (180, 200, 190)) == pytest.approx(200 / 191)
    assert model.target_spacing((60, 60, 60), (4, 5, 5), (55, 60, 60)) == 2.0
    assert model.target_spacing((300, 300, 30), (1.2, 1.2, 5), (250, 250, 25)) == pytest.approx(250 * 1.2 / 191)
    assert model.target_spacing((256, 256, 256), (1, 1, 1), None) == 1.0


# Registration


def field(spark, dims, d):
    g = geometry.grid(volume(spark, {(0, 0, 0): 1}), dims)
    return g.withColumns({c: F.lit(float(v)) for c, v in zip(("dx", "dy", "dz"), d, strict=True)})


def test_fields(spark):
    dims = (5, 4, 3)
    for r in registration.integrate(field(spark, dims, (0.6, -1.2, 0.3)), dims, 3).collect():
        assert (r.dx, r.dy, r.dz) == pytest.approx((0.6, -1.2, 0.3))
    for r in registration.enlarge(field(spark, (3, 2, 2), (0.5, 1.5, -1)), (3, 2, 2), (6, 6, 2)).collect():
        assert (r.dx, r.dy, r.dz) == pytest.approx((1, 4.5, -1))
    data = np.random.default_rng(5).normal(size=dims) + 5
    v = dense(spark, data)
    moved = {(r.x, r.y, r.z): r.value for r in registration.warp(v, field(spark, dims, (1, -2, 0)), dims).collect()}
    want = {(x, y, z): data[x + 1, y - 2, z] if x + 1 < 5 and y >= 2 else 0 for x, y, z in np.ndindex(dims)}
    assert moved == pytest.approx(want)
    back = registration.inverse_warp(registration.warp(v, field(spark, dims, (1, -2, 0)), dims), field(spark, dims, (1, -2, 0)), dims, True, 2)
    inside = {(r.x, r.y, r.z): r.value for r in back.collect() if r.x >= 1 and r.y <= 1}
    assert inside == pytest.approx({k: data[k] for k in np.ndindex(dims) if k[0] >= 1 and k[1] <= 1})
    assert spark.range(1).select(elementwise.magnitude(F.lit(2.0), F.lit(-3.0), F.lit(6.0))).first()[0] == 7
    field_, warped = registration.register(field(spark, (3, 2, 2), (0.0, 0.0, 0.0)), v, (3, 2, 2), dims, 2)
    assert {r.magnitude for r in field_.collect()} == {0.0} and {(r.x, r.y, r.z): r.value for r in warped.collect()} == pytest.approx({k: data[k] for k in np.ndindex(dims)})


def test_prealignment():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(3, 3))
    cov = a @ a.T
    values, axes = model.principal_axes(cov)
    assert list(values) == sorted(values, reverse=True) and np.allclose(axes @ np.diag(values) @ axes.T, cov)
    turn, _ = np.linalg.qr(np.eye(3) + 0.2 * rng.normal(size=(3, 3)))
    turn = turn * np.sign(np.diag(turn))
    turn[:, 2] *= np.linalg.det(turn)
    shape = np.diag([9.0, 4.0, 1.0])
    m = model.axes_prealign((1, 2, 3), shape, (7, 8, 6), turn @ shape @ turn.T)
    assert np.allclose(m[:3, :3], turn) and np.allclose(m @ [1, 2, 3, 1], [7, 8, 6, 1])
    c = model.centroid_prealign((2, 0, 5), (-1, 4, 8), (1, -1, 1))
    assert np.allclose(c @ [2, 0, 5, 1], [-1, 4, 8, 1]) and np.allclose(np.diag(c), (1, -1, 1, 1))


# Ranking, evaluation, connectivity


def test_rank_terms(spark):
    weights = spark.createDataFrame([("North", 0.2), ("East", 0.6), ("Unassigned", 0.9), ("Nowhere", 0.3), ("South", float("nan"))], "network string, fraction double")
    rows = [("East", "river", 0.5), ("North", "hill", 0.9), ("North", " River", 0.75), ("East", "lake", 0.1), ("South", "dune", 0.9), ("North", "moor", -0.5)]
    profile = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "network string, term string, score double, ord int")
    got = rank.rank_terms(weights, profile).collect()
    assert [(r.term, pytest.approx(r.score)) for r in got] == [("river", 0.45), ("hill", 0.18), ("lake", 0.06)]
    assert got[0].contributors == ["East", "North"] and got[0].parts == pytest.approx([0.3, 0.15])
    assert [r.term for r in rank.rank_terms(weights, profile, top=2).collect()] == ["river", "hill"] and rank.rank_terms(weights, profile, least=0.2).count() == 1
    assert rank.rank_terms(weights.withColumn("fraction", F.lit(0.0)), profile).count() == 0
    assert [r.label for r in rank.distinct_labels(spark.createDataFrame([(7,), (0,), (3,), (7,)], "label int"), 2).collect()] == [3, 7]
    with pytest.raises(ValueError):
        rank.distinct_labels(spark.createDataFrame([(7,)], "label int"), 2)
    words = spark.createDataFrame([("ab",), ("123",), ("the",), ("Motor",)], "t string")
    assert [r.t for r in words.where(rank.keep_term(F.col("t"), ["the"])).collect()] == ["Motor"]


def test_scores(spark):
    kind = "c string, tp long, fp long, fn long"
    rows = {r.c: r for r in evaluate.scores(spark.createDataFrame([("none", 0, 0, 0), ("miss", 0, 0, 3), ("extra", 0, 2, 0), ("some", 2, 1, 1)], kind)).collect()}
    assert rows["none"].dice == rows["none"].jaccard == 1 and rows["miss"].precision == 0
    assert math.isinf(rows["extra"].volume_ratio) and rows["some"].dice == pytest.approx(2 / 3)
    v = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (float("inf"),)], "v double")
    assert v.select(evaluate.finite_mean(F.col("v"))).first()[0] == 2
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, a double, b double")
    assert evaluate.masked_correlation(flat, ["g"]).first().r is None


def test_correlations(spark):
    rng = np.random.default_rng(14)
    regions, voxels = rng.normal(size=(3, 12)), rng.normal(size=(40, 12))
    voxels[7], voxels[8, 3:6] = 2.5, np.nan
    rows = lambda m: [(1, str(k), t, float(m[k, t])) for k in range(len(m)) for t in range(12) if not np.isnan(m[k, t])]
    kind = "subject int, region string, t int, value double"
    got = {(int(r.source), int(r.target)): (r.n, r.r) for r in connectome.correlations(spark.createDataFrame(rows(regions), kind), spark.createDataFrame(rows(voxels), kind), size=3).collect()}
    assert len(got) == 120
    for (i, j), (n, r) in got.items():
        ok = ~np.isnan(voxels[j])
        assert n == ok.sum() and (r is None if j == 7 else r == pytest.approx(np.corrcoef(regions[i][ok], voxels[j][ok])[0, 1] * (n - 1) / n))


def test_group_t(spark):
    z = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, z double")
    rows = {r.k: r for r in connectome.group_t(z, ["k"]).collect()}
    assert rows["a"].t == pytest.approx(2.0) and rows["b"].t == pytest.approx(2e6)
    assert {r.k: r.t for r in connectome.group_t(z, ["k"], sample=False).collect()}["a"] == pytest.approx(2 * math.sqrt(2))


# Scoring


def test_sliding_window(spark):
    v = dense(spark, np.arange(216.0).reshape(6, 6, 6))
    p, mask = score.sliding_window(v, (6, 6, 6), (4, 4, 4), lambda b: np.full(b.shape, 0.7), threshold=0.5)
    assert p.count() == 216 == mask.count() and all(r.p == pytest.approx(0.7) for r in p.collect())
    stats_ = score.patch_stats(score.score_patches(geometry.patch_voxels(v, (6, 6, 6), (4, 4, 4), 0.25), (4, 4, 4), lambda b: b), 2)
    assert stats_.count() == 2


def test_segmentation_of_other_spacing(spark):
    data = np.zeros((8, 8, 6))
    data[2:6, 2:6, 1:5] = 10
    data[7, 7, 5] = 10
    v = dense(spark, data)
    mask = steps.segment(v, (8, 8, 6), (1.0, 1.0, 1.0), lambda b: b, (4, 4, 4), target=(2.0, None, None), least=5, sigma=2.0)
    assert points(mask) >= {(3, y, z) for y in range(2, 6) for z in range(1, 5)} and (7, 7, 5) not in points(mask)


def test_brain_extraction(spark):
    rng = np.random.default_rng(1)
    data = np.zeros((9, 10, 8))
    data[1:7, 2:9, 1:6] = rng.uniform(50, 100, (6, 7, 5))
    data[3, 4, 3] = 1  # a hole inside
    data[8, 0, 7] = 100  # and a speck
    v = dense(spark, data)
    inside = lambda b: np.where(b > 0.2, -1.0, 5.0)
    mask = steps.extract_brain(v, (9, 10, 8), (1.0, 1.0, 1.0), inside, conform=lambda d: tuple(n + 4 for n in d))
    assert points(mask) == set(itertools.product(range(1, 7), range(2, 9), range(1, 6)))
    coarse = steps.extract_brain(v, (9, 10, 8), (2.0, 2.0, 2.0), inside, conform=lambda d: tuple(n + 1 for n in d))
    assert len(points(coarse) ^ points(mask)) < 0.5 * len(points(mask)) and (8, 0, 7) not in points(coarse)
    assert steps.extract_brain(v.withColumn("value", F.lit(0.0)), (9, 10, 8), (1.0, 1.0, 1.0), inside).count() == 0


# Sources


def test_nifti_round_trip(spark, tmp_path):
    data = np.arange(24.0).reshape(2, 3, 4)
    affine = np.array([[2.0, 0, 0, -1], [0, 3, 0, 5], [0, 0, 4, 6], [0, 0, 0, 1]])
    assert nifti.write_files(nifti.to_files(dense(spark, data, "a"), (2, 3, 4), affine), str(tmp_path)) == 1
    (tmp_path / "notes.txt").write_text("not a volume")
    got = {(r.x, r.y, r.z): r.value for r in nifti.read_voxels(spark, str(tmp_path)).collect()}
    assert got == {k: data[k] for k in np.ndindex(data.shape)}
    meta = nifti.read_meta(spark, str(tmp_path)).first()
    assert (meta.nx, meta.ny, meta.nz, meta.datatype) == (2, 3, 4, 16) and np.allclose(meta.affine, affine)
    assert nifti.read_voxels(spark, str(tmp_path), nonzero=True).count() == 23


def test_nifti_keeps_a_source_header(spark, tmp_path):
    import struct

    source = bytearray(nifti.encode(np.ones((2, 3, 4)), np.diag([2.0, 3, 4, 1])))
    source[148:160] = b"made by hand"
    struct.pack_into("<h", source, 252, 2)
    labels = nifti.encode(np.arange(24).reshape(2, 3, 4) * 20, labels=True, source=bytes(source))
    h = nifti.header(labels)
    assert labels[148:160] == b"made by hand" and struct.unpack_from("<h", labels, 252) == (2,) and np.allclose(np.diag(h["affine"]), (2, 3, 4, 1))
    assert h["code"] == 512 and struct.unpack_from("<2f", labels, 124) == (460, 0) and np.frombuffer(labels, "<u2", 24, 352).max() == 460
    with pytest.raises(ValueError):
        nifti.encode(np.ones((2, 2, 2)), source=bytes(source))


def test_nifti_headers():
    raw = bytearray(nifti.encode(np.ones((2, 2, 2)), labels=True))
    assert nifti.header(bytes(raw))["code"] == 2
    import struct

    struct.pack_into("<2h", raw, 252, 1, 0)
    struct.pack_into("<6f", raw, 256, 0, 0, 0, 7, 8, 9)
    assert np.allclose(nifti.header(bytes(raw))["affine"][:3, 3], (7, 8, 9))
    struct.pack_into("<8h", raw, 40, 4, 2, 2, 2, 5, 1, 1, 1)
    with pytest.raises(ValueError):
        nifti.header(bytes(raw))


def test_profiles_and_assets(spark, tmp_path):
    path = str(tmp_path / "p.json")
    (tmp_path / "p.json").write_text(json.dumps({"id": "p7", "networkProfiles": {"Visual": [{"term": "visual", "score": 0.8, "rank": 1}]}}))
    assert pack.read_profiles(spark, path, "p7").first().term == "visual"
    with pytest.raises(ValueError):
        pack.read_profiles(spark, path, "other")
    (tmp_path / "a.bin").write_bytes(b"abc")
    sha = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    rows = [("a", "a.bin", 3, sha, "supported", [2, 2, 2]), ("b", "b.bin", 9, "x", "planned", [1, 1, 1])]
    table = spark.createDataFrame(rows, "id string, filename string, sizeBytes long, checksum string, supportStatus string, dims array<int>")
    assert assets.lookup(table, "a").sizeBytes == 3 and assets.budget(table).first().bytes == 3
    assert {r.id: r.ok for r in assets.checksums(spark, str(tmp_path), table).collect()} == {"a": True, "b": False}
    assert assets.load_atlas(table, "a", (2, 2, 2)) == (2, 2, 2)
    with pytest.raises(ValueError):
        assets.lookup(table, "b")
    assert assets.repeated_ids(table, table.where("id = 'a'")).first().id == "a"
    made = []
    for _ in range(2):
        assets.cached(spark, "k", str(tmp_path), lambda: made.append(1) or spark.range(2))
    assert made == [1]


def test_cases(spark):
    listing = spark.createDataFrame([("s1_t1.nii",), ("s1_t1_mask.nii",), ("s2_t1.nii",)], "path string")
    subjects = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "subject string")
    find = lambda paired: assets.discover_cases(subjects, ["t1"], listing, "%s_%s.nii", "%s_%s_mask.nii", paired).count()
    assert (find(True), find(False)) == (1, 2)
    tokens = spark.createDataFrame([(0, "b, a"), (1, "a,c")], "ord int, tokens string")
    assert [r.subject for r in scalars.expand_subjects(tokens).collect()] == ["b", "a", "c"]
    mixed = assets.union_of_columns([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "b int, a int")])
    assert mixed.columns == ["a", "b"] and mixed.count() == 2


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.term_name(F.lit("x__working_memory"))) == "working memory"
    assert one(scalars.term_name(F.lit("Neurosynth_TFIDF__topic__pain__low_back"))) == "pain  low back"
    assert one(scalars.term_name(F.lit("TFIDF__reward"))) == "reward"
    assert one(scalars.network_of_label(F.lit("7N_LH_Vis_1"), {"Vis": "Visual"})) == "Visual"
    assert one(scalars.network_of_label(F.lit("7N"), {"Vis": "Visual"})) == "Unassigned"
    assert one(scalars.threshold_list(F.lit("0.5, 0.1,0.5"))) == [0.1, 0.5]
    for wrong in ("", "0.5,x", "0.5,1", "0"):
        with pytest.raises(Exception, match="thresholds must be"):
            one(scalars.threshold_list(F.lit(wrong)))
    assert one(scalars.dims_of(F.lit("7x31x12"))) == [7, 31, 12] and one(scalars.dims_of(F.lit("7x31"))) is None
    assert one(elementwise.half_up(F.lit(-0.5))) == 0
    assert one(scalars.flat_affine(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))) == [1, 2, 3, 4]
    assert [tuple(e) for e in one(scalars.ordered_entries(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))))] == [("a", 2), ("b", 1)]


# Plans


def test_spaces():
    a = model.VolumeMeta("a", (2, 2, 2), space="mni160")
    b = model.VolumeMeta("b", (2, 2, 2))
    model.require_same_space(a, b)
    with pytest.raises(ValueError):
        model.require_same_space(a, b, True)
    with pytest.raises(ValueError):
        model.require_space(a, "native-t1")
    assert model.same_grid(a, b) and not model.same_grid(a, model.VolumeMeta("c", (2, 2, 3)))
    with pytest.raises(ValueError):
        model.check_length(a, 7)


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([("v", i % 5) for i in range(40)], "volume_id string, vid int")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    atlas = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "vid int, label int")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.stream_overlap(stream, atlas).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.label: r.voxels for r in spark.table("running").collect()} == {0: 16, 1: 16, 2: 8}
