"""Principal axes of many masks at once, and the rigid maps between them, as column expressions over their moments."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grids import let
from .stats import moments

#: Rotations of each of the three pairs of axes; six sweeps take any symmetric matrix of three rows to rounding.
SWEEPS = 6
_PAIRS = ((0, 1), (0, 2), (1, 2))
_AT = {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4, (2, 2): 5}


def _place(i: int, j: int) -> int:
    return _AT[min(i, j), max(i, j)]


def _turned(state: Column, p: int, q: int) -> Column:
    """One Jacobi rotation: the symmetric matrix ``a`` (six numbers) with a[p][q] brought to 0, and the axes ``v`` (nine, by rows) turned with it."""
    r = 3 - p - q
    a, v = state["a"], state["v"]
    app, aqq, apq, arp, arq = (a[_place(*k)] for k in ((p, p), (q, q), (p, q), (r, p), (r, q)))
    half = (aqq - app) / (2 * apq)
    t = F.when(apq == 0, 0.0).otherwise(F.when(half >= 0, 1.0).otherwise(-1.0) / (F.abs(half) + F.sqrt(half * half + 1)))

    def new(t: Column) -> Column:
        c = 1 / F.sqrt(t * t + 1)

        def cells(c: Column) -> Column:
            s = t * c
            now = {_place(p, p): app - t * apq, _place(q, q): aqq + t * apq, _place(p, q): F.lit(0.0), _place(r, p): c * arp - s * arq, _place(r, q): s * arp + c * arq}
            axes = []
            for k in range(3):
                row = [v[3 * k + j] for j in range(3)]
                row[p], row[q] = c * row[p] - s * row[q], s * row[p] + c * row[q]
                axes += row
            return F.struct(F.array(*(now.get(i, a[i]) for i in range(6))).alias("a"), F.array(*axes).alias("v"))

        return let(c, cells)

    return let(t, new)


def eigen(covariance: list[Column]) -> Column:
    """Array of (value, axis) in descending order of a symmetric matrix (xx, xy, xz, yy, yz, zz); an axis is three numbers."""
    start = F.struct(F.array(*(c.cast("double") for c in covariance)).alias("a"), F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))).alias("v"))

    def step(state: Column, i: Column) -> Column:
        return F.when(i % 3 == 0, _turned(state, *_PAIRS[0])).when(i % 3 == 1, _turned(state, *_PAIRS[1])).otherwise(_turned(state, *_PAIRS[2]))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(3 * SWEEPS - 1)), start, step)
    found = let(done, lambda d: F.array(*(F.struct(d["a"][_place(k, k)].alias("value"), F.array(*(d["v"][3 * i + k] for i in range(3))).alias("axis")) for k in range(3))))
    return F.sort_array(found, asc=False)


def principal_axes(mask: DataFrame) -> DataFrame:
    """volume_id, n, mean (array) and axes: (value, axis) in descending order, of every volume of a mask."""
    m = moments(mask)
    pairs = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    return m.select("volume_id", "n", F.array("cx", "cy", "cz").alias("mean"), eigen([F.col(c) for c in pairs]).alias("axes"))


def _dot(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x + y, (a[i] * b[i] for i in range(3)))


def _det(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def prealign(fixed: DataFrame, moving: DataFrame, by: list[str]) -> DataFrame:
    """by, affine: for each pair of masks (tables of principal_axes with the columns ``by``) the rigid map from fixed to moving.

    Moving axes are matched to fixed ones by the permutation of the largest sum of absolute cosines, the first of equals, and turned to point the same way;
    where that is a reflection, the axis that agrees least is turned back. The map takes one mean to the other and is an array of three rows of four.
    """
    f = fixed.select(*by, F.col("mean").alias("_fm"), F.transform("axes", lambda e: e["axis"]).alias("_f"))
    m = moving.select(*by, F.col("mean").alias("_mm"), F.transform("axes", lambda e: e["axis"]).alias("_m"))
    both = f.join(m, by)
    cos = lambda k, j: _dot(F.col("_m")[k], F.col("_f")[j])
    both = both.withColumn("_cos", F.array(*(F.array(*(cos(k, j) for j in range(3))) for k in range(3))))
    orders = [
        F.struct(reduce(lambda x, y: x + y, (F.abs(F.col("_cos")[k][j]) for j, k in enumerate(p))).alias("sum"), F.lit(-i).alias("i"), F.array(*map(F.lit, p)).alias("p"))
        for i, p in enumerate(permutations(range(3)))
    ]
    both = both.withColumn("_p", F.array_max(F.array(*orders))["p"])
    both = both.withColumn("_along", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.get(F.get("_cos", F.get("_p", j)), j)))
    sign = F.transform("_along", lambda c: F.when(c < 0, -1.0).otherwise(1.0))
    both = both.withColumn("_sign", sign).withColumn("_turned", F.transform("_p", lambda k: F.get("_m", k)))

    def rotation(signs: Column) -> Column:
        cell = lambda a, b: reduce(lambda x, y: x + y, (signs[j] * F.col("_turned")[j][a] * F.col("_f")[j][b] for j in range(3)))
        return F.array(*(F.array(*(cell(a, b) for b in range(3))) for a in range(3)))

    both = both.withColumn("_r", rotation(F.col("_sign")))
    weakest = F.array_position(F.transform("_along", F.abs), F.array_min(F.transform("_along", F.abs))).cast("int") - 1
    back = F.transform("_sign", lambda s, j: F.when(j == weakest, -s).otherwise(s))
    mirrored = _det([[F.col("_r")[a][b] for b in range(3)] for a in range(3)]) < 0
    both = both.withColumn("_sign", F.when(mirrored, back).otherwise(F.col("_sign"))).withColumn("_r", rotation(F.col("_sign")))
    rows = [F.array(*(F.col("_r")[a][b] for b in range(3)), F.col("_mm")[a] - _dot(F.col("_r")[a], F.col("_fm"))) for a in range(3)]
    return both.select(*by, F.array(*rows).alias("affine"))
