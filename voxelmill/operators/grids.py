"""Volumes of different grids in one table: each row's own affine and dims come from a table of grids by an equality join.

``meta`` tables have volume_id, nx, ny, nz and affine (array<array<double>>, voxel to world), as the NIfTI source gives them. Maps between
two grids are arrays of three rows of four numbers, computed for each volume, so that no grid passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elementwise import half_up
from .geometry import AT, _weigh

DIMS = ["nx", "ny", "nz"]
LEAST = 1e-12


def _cell(m: Column, i: int, j: int) -> Column:
    return m[i][j]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in there: without it, maps of maps grow with each step."""
    return F.transform(F.array(value), use)[0]


def inverse_of(affine: Column) -> Column:
    """The inverse of an affine by its adjugate; raises where it has none."""

    def solved(m: Column) -> Column:
        a = [[_cell(m, i, j) for j in range(4)] for i in range(3)]
        minor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
        det = reduce(lambda x, y: x + y, (a[0][j] * minor(0, j) for j in range(3)))
        det = F.when(F.abs(det) >= LEAST, det).otherwise(F.raise_error(F.lit("the affine can't be inverted")))
        turned = let(det, lambda d: F.array(*(F.array(*(minor(j, i) / d for j in range(3))) for i in range(3))))
        shift = lambda t, i: -reduce(lambda x, y: x + y, (t[i][j] * a[j][3] for j in range(3)))
        return let(turned, lambda t: F.array(*(F.array(*(t[i][j] for j in range(3)), shift(t, i)) for i in range(3))))

    return let(affine, solved)


def composed(first: Column, second: Column) -> Column:
    """The map that takes a point by ``second``, then by ``first``."""

    def product(f: Column, s: Column) -> Column:
        line = lambda i: [reduce(lambda x, y: x + y, (_cell(f, i, k) * _cell(s, k, j) for k in range(3))) for j in range(4)]
        rows = [(line(i), _cell(f, i, 3)) for i in range(3)]
        return F.array(*(F.array(*r[:3], r[3] + shift) for r, shift in rows))

    return let(first, lambda f: let(second, lambda s: product(f, s)))


def image(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(_cell(m, i, 0) * x + _cell(m, i, 1) * y + _cell(m, i, 2) * z + _cell(m, i, 3) for i in range(3))


def spacing(affine: Column) -> Column:
    """Lengths of the three voxel axes in world space."""
    return F.array(*(F.sqrt(reduce(lambda x, y: x + y, (_cell(affine, i, j) ** 2 for i in range(3)))) for j in range(3)))


def to_grid(meta: DataFrame, dims, affine) -> DataFrame:
    """The same target grid for each volume of ``meta``."""
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in affine))
    return meta.select("volume_id", *(F.lit(int(n)).alias(c) for n, c in zip(dims, DIMS, strict=True)), rows.alias("affine"))


def cells(meta: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All voxels of each row's own grid, generated plane by plane where the row is."""
    planes = meta.select("volume_id", "nx", "ny", *keep, F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z"))
    lines = planes.select("volume_id", "nx", *keep, "z", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y"))
    return lines.select("volume_id", *keep, F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"), "y", "z")


def between(source: DataFrame, target: DataFrame) -> DataFrame:
    """target with ``map``, which takes its voxels to those of the source grid of the same volume."""
    s = source.select("volume_id", F.col("affine").alias("_source"))
    return target.join(s, "volume_id").withColumn("map", composed(inverse_of(F.col("_source")), F.col("affine"))).drop("_source")


def _points(source: DataFrame, target: DataFrame) -> DataFrame:
    at = cells(between(source, target), ("map",))
    return at.select(*AT, *(c.alias(n) for c, n in zip(image(F.col("map"), *(F.col(c) for c in "xyz")), ("sx", "sy", "sz"), strict=True)))


def resample_nearest(volume: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Each volume on its own target grid with the nearest source values; 0 where the source has none."""
    at = _points(source, target).select(*AT, *(half_up(F.col(c)).cast("int").alias(c) for c in ("sx", "sy", "sz")))
    known = volume.select("volume_id", *(F.col(c).alias(f"s{c}") for c in "xyz"), "value")
    return at.join(known, ["volume_id", "sx", "sy", "sz"], "left").select(*AT, F.coalesce("value", F.lit(0)).alias("value"))


def resample_linear(volume: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Each volume on its own target grid with trilinear source values; corners that the source doesn't have count as 0."""
    return _weigh(_points(source, target), volume, AT, ["value"])


def resample_mask(mask: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The target voxels whose nearest source voxel is in the mask, as resample_nearest has them, without making the target grid.

    Each mask voxel generates the target voxels of its own preimage's box and keeps those that round to it exactly, so rows follow the mask.
    """
    maps = between(source, target).select("volume_id", *DIMS, "map", inverse_of(F.col("map")).alias("back"))
    m = mask.select(*AT).join(maps, "volume_id")
    back = F.col("back")
    middle = image(back, *(F.col(c).cast("double") for c in "xyz"))
    for i, (c, n) in enumerate(zip("xyz", DIMS, strict=True)):
        reach = 0.5 * reduce(lambda x, y: x + y, (F.abs(_cell(back, i, j)) for j in range(3))) + 1e-6
        low = F.greatest(F.lit(0), F.ceil(middle[i] - reach).cast("int"))
        high = F.least(F.col(n) - 1, F.floor(middle[i] + reach).cast("int"))
        m = m.withColumn(f"_low{c}", low).withColumn(f"_high{c}", high)
    m = m.where(reduce(lambda a, b: a & b, (F.col(f"_low{c}") <= F.col(f"_high{c}") for c in "xyz")))
    for c in "xyz":
        m = m.withColumn(f"t{c}", F.explode(F.sequence(f"_low{c}", f"_high{c}")))
    exact = image(F.col("map"), *(F.col(f"t{c}") for c in "xyz"))
    hit = reduce(lambda a, b: a & b, (half_up(e) == F.col(c) for e, c in zip(exact, "xyz", strict=True)))
    return m.where(hit).select("volume_id", *(F.col(f"t{c}").alias(c) for c in "xyz"))


def orientation(affine: Column) -> Column:
    """perm: for each world axis the grid axis that follows it most, taken greedily, the lower of equals; flip: whether it runs backwards."""
    size = lambda i, k: F.abs(_cell(affine, i, k))
    p0 = F.when((size(0, 0) >= size(0, 1)) & (size(0, 0) >= size(0, 2)), 0).when(size(0, 1) >= size(0, 2), 1).otherwise(2)
    pick = lambda a, b: F.when(size(1, a) >= size(1, b), a).otherwise(b)
    p1 = F.when(p0 == 0, pick(1, 2)).when(p0 == 1, pick(0, 2)).otherwise(pick(0, 1))
    perm = F.array(p0, p1, 3 - p0 - p1)
    return F.struct(perm.alias("perm"), F.array(*(F.get(affine[i], perm[i]) < 0 for i in range(3))).alias("flip"))


def orient(volume: DataFrame, meta: DataFrame) -> DataFrame:
    """Each volume with its axes along the world's, as its affine says: new axis k is old axis perm[k], counted backwards where flip[k]."""
    how = meta.select("volume_id", F.array(*DIMS).alias("_dims"), orientation(F.col("affine")).alias("_o"))
    v = volume.join(how, "volume_id")
    at = F.array(*"xyz")
    turned = []
    for k, c in enumerate("xyz"):
        p = F.col("_o.perm")[k]
        turned.append(F.when(F.col("_o.flip")[k], F.get("_dims", p) - 1 - F.get(at, p)).otherwise(F.get(at, p)).cast("int").alias(c))
    rest = [c for c in volume.columns if c not in AT]
    return v.select("volume_id", *turned, *rest)


def orient_back(volume: DataFrame, meta: DataFrame) -> DataFrame:
    """The inverse of orient; ``meta`` has the grids before it."""
    how = meta.select("volume_id", F.array(*DIMS).alias("_dims"), orientation(F.col("affine")).alias("_o"))
    v = volume.join(how, "volume_id")
    at = F.array(*"xyz")
    turned = []
    for j, c in enumerate("xyz"):
        k = F.array_position("_o.perm", F.lit(j)).cast("int") - 1
        turned.append(F.when(F.get("_o.flip", k), F.col("_dims")[j] - 1 - F.get(at, k)).otherwise(F.get(at, k)).cast("int").alias(c))
    rest = [c for c in volume.columns if c not in AT]
    return v.select("volume_id", *turned, *rest)


def oriented_meta(meta: DataFrame) -> DataFrame:
    """The grids after orient: dims in the new order, and the affine of the turned voxels, so that each keeps its place in the world."""
    m = meta.withColumn("_o", orientation(F.col("affine"))).withColumn("_dims", F.array(*DIMS))
    a, perm, flip = F.col("affine"), F.col("_o.perm"), F.col("_o.flip")
    sign = [F.when(flip[k], -1.0).otherwise(1.0) for k in range(3)]
    rows = []
    for i in range(3):
        column = [F.get(a[i], perm[k]) for k in range(3)]
        shift = reduce(lambda x, y: x + y, (F.when(flip[k], column[k] * (F.get("_dims", perm[k]) - 1)).otherwise(0.0) for k in range(3)))
        rows.append(F.array(*(column[k] * sign[k] for k in range(3)), a[i][3] + shift))
    rows.append(F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    dims = [F.get("_dims", perm[k]).alias(n) for k, n in enumerate(DIMS)]
    rest = [c for c in meta.columns if c not in ("volume_id", *DIMS, "affine")]
    return m.select("volume_id", *dims, F.array(*rows).alias("affine"), *rest)


def boxes(volume: DataFrame, meta: DataFrame, margin: int = 0, positive: bool = False, full_if_empty: bool = False) -> DataFrame:
    """volume_id, empty, x0, x1, y0, y1, z0, z1 of every volume of ``meta``: the box of its nonzero (or positive) voxels on its own grid, ends exclusive.

    Volumes without such voxels, or without any row, have nulls or their whole grid.
    """
    some = F.col("value") > 0 if positive else F.col("value") != 0
    ends = volume.where(some).groupBy("volume_id").agg(*(f(c).alias(f"_{k}{c}") for c in "xyz" for k, f in (("a", F.min), ("b", F.max))))
    out = meta.select("volume_id", *DIMS).join(ends, "volume_id", "left")
    empty = F.col("_ax").isNull()
    whole = lambda v: v if full_if_empty else F.lit(None)
    columns = []
    for c, n in zip("xyz", DIMS, strict=True):
        columns.append(F.when(~empty, F.greatest(F.lit(0), F.col(f"_a{c}") - margin)).otherwise(whole(F.lit(0))).cast("int").alias(f"{c}0"))
        columns.append(F.when(~empty, F.least(F.col(n), F.col(f"_b{c}") + 1 + margin)).otherwise(whole(F.col(n))).cast("int").alias(f"{c}1"))
    return out.select("volume_id", empty.alias("empty"), *columns)


def crop(volume: DataFrame, found: DataFrame) -> DataFrame:
    """Each volume's own box, with coordinates counted from its corner; volumes whose box is empty drop out."""
    v = volume.join(found.where(~F.col("empty")).drop("empty"), "volume_id")
    v = v.where(reduce(lambda a, b: a & b, ((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1")) for c in "xyz")))
    return v.withColumns({c: F.col(c) - F.col(f"{c}0") for c in "xyz"}).select(*volume.columns)


def place_back(box: DataFrame, found: DataFrame, meta: DataFrame, fill: float = 0.0) -> DataFrame:
    """The inverse of crop: every volume of ``meta`` on its whole grid, with ``fill`` around its box."""
    back = box.join(found.select("volume_id", "x0", "y0", "z0"), "volume_id").select("volume_id", *((F.col(c) + F.col(f"{c}0")).alias(c) for c in "xyz"), "value")
    return cells(meta).join(back, AT, "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def centre(volume: DataFrame, meta: DataFrame, target: DataFrame) -> DataFrame:
    """Each volume moved to the centre of its target grid, larger or smaller; what falls outside goes. With the tables swapped it moves back."""
    new = target.select("volume_id", *(F.col(n).alias(f"_{n}") for n in DIMS))
    v = volume.join(meta.select("volume_id", *DIMS).join(new, "volume_id"), "volume_id")
    # The offset of a smaller grid from a larger one is the larger's from the smaller, turned round.
    half = lambda n: F.when(F.col(f"_{n}") >= F.col(n), F.floor((F.col(f"_{n}") - F.col(n)) / 2)).otherwise(-F.floor((F.col(n) - F.col(f"_{n}")) / 2))
    v = v.withColumns({c: (F.col(c) + half(n)).cast("int") for c, n in zip("xyz", DIMS, strict=True)})
    return v.where(reduce(lambda a, b: a & b, (F.col(c).between(F.lit(0), F.col(f"_{n}") - 1) for c, n in zip("xyz", DIMS, strict=True)))).select(*volume.columns)


def target_spacing(found: DataFrame, meta: DataFrame) -> DataFrame:
    """volume_id, spacing: what each volume's box asks for, by the rule of model.target_spacing; 1 for an empty box."""
    m = meta.select("volume_id", *DIMS, spacing(F.col("affine")).alias("_s")).join(found, "volume_id")
    s = F.col("_s")
    keeps = F.least(*(F.col(n) * s[k] for k, n in enumerate(DIMS))) / 48
    fits = F.greatest(*((F.col(f"{c}1") - F.col(f"{c}0")) * s[k] for k, c in enumerate("xyz"))) / 191
    floor = F.least(F.lit(2.0), F.greatest(F.lit(1.0), F.array_min(s)))
    value = F.greatest(floor, F.least(F.lit(2.0), keeps, fits))
    return m.select("volume_id", F.when(F.col("empty"), 1.0).otherwise(value).alias("spacing"))


def _world_box(dims: list[Column], affine: Column) -> list[tuple[Column, Column]]:
    """Ends of the grid's box along each world axis; each voxel axis adds its length to one end."""
    out = []
    for i in range(3):
        parts = [_cell(affine, i, j) * dims[j] for j in range(3)]
        add = lambda f: reduce(lambda a, b: a + b, (f(p, F.lit(0.0)) for p in parts)) + _cell(affine, i, 3)  # noqa: B023, E731
        out.append((add(F.least), add(F.greatest)))
    return out


def view_overlap(sources: DataFrame, targets: DataFrame, by: list[str], tolerance: float = 1e-3, least: float = 0.8) -> DataFrame:
    """by, overlap, same_grid, close and warning of pairs of grids that share ``by``: the share of the target's box in the world that the source's covers.

    ``same_grid`` asks for equal dims and affines within the tolerance, ``close`` for the affines alone; the warning is null where affines are
    close and the overlap is ``least`` or more.
    """
    name = lambda p, df: df.select(*by, *(F.col(c).alias(f"_{p}{c}") for c in [*DIMS, "affine"]))
    both = name("s", sources).join(name("t", targets), by)
    ends = {p: _world_box([F.col(f"_{p}{n}") for n in DIMS], F.col(f"_{p}affine")) for p in "st"}
    product = lambda parts: reduce(lambda a, b: a * b, parts)
    shared = product(F.greatest(F.lit(0.0), F.least(s[1], t[1]) - F.greatest(s[0], t[0])) for s, t in zip(ends["s"], ends["t"], strict=True))
    size = product(t[1] - t[0] for t in ends["t"])
    near = reduce(lambda a, b: a & b, (F.abs(_cell(F.col("_saffine"), i, j) - _cell(F.col("_taffine"), i, j)) <= tolerance for i in range(3) for j in range(4)))
    same = near & reduce(lambda a, b: a & b, (F.col(f"_s{n}") == F.col(f"_t{n}") for n in DIMS))
    out = both.select(*by, F.when(size > 0, shared / size).otherwise(0.0).alias("overlap"), same.alias("same_grid"), near.alias("close"))
    text = F.concat(F.lit("grid or field of view differs; overlap of the target "), F.format_string("%.3f", "overlap"))
    return out.withColumn("warning", F.when(~F.col("close") | (F.col("overlap") < least), text))
