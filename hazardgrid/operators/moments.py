"""Kernel sums around probes from the moments of small cells.

The kernel 1 - d²/r² is quadratic in the coordinates, so what a cell that lies wholly in a probe's circle adds
follows from five sums of the cell, whatever it holds. Only cells that the rim crosses are joined row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial

#: Cells along a radius. More of them leave fewer rows to the rim, and repeat each probe more often (some
#: four times their square).
FINE = 4


def _cells(probe: DataFrame, key: str, radius: float, fine: int) -> DataFrame:
    """(key, px, py, cx, cy, whole): the cells that meet each probe's circle; ``whole`` if all of the cell is in
    it. Rounding can only make a cell one of the rim."""
    side, width = radius / fine, 2 * fine + 3
    k = F.col("k")
    rows = probe.select(key, "px", "py", F.explode(F.sequence(F.lit(0), F.lit(width * width - 1))).alias("k"))
    rows = rows.withColumn("cx", F.floor(F.col("px") / side) + k % width - (fine + 1)).withColumn("cy", F.floor(F.col("py") / side) + F.floor(k / width) - (fine + 1))
    near, far = [], []
    for p, c in (("px", "cx"), ("py", "cy")):
        low, high = F.col(c) * side - F.col(p), F.col(p) - (F.col(c) + 1) * side
        gap = F.greatest(low, high, F.lit(0.0))
        reach = F.greatest(F.abs(low), F.abs(high))
        near.append(gap * gap)
        far.append(reach * reach)
    rows = rows.where(near[0] + near[1] <= radius * radius * (1 + 1e-9))
    return rows.select(key, "px", "py", "cx", "cy", (far[0] + far[1] <= radius * radius * (1 - 1e-9)).alias("whole"))


def cell_moments(points: DataFrame, value: Column, side: float, sums: dict[str, Column]) -> DataFrame:
    """(cx, cy, n, v, vx, vy, vq, ...) of ``points(x, y, ...)``: of each cell the number of its points, the sums
    of the value, of its products with the offsets from the cell's centre and with their squares, and of
    ``sums``."""
    cx, cy = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    dx, dy = F.col("x") - (cx + 0.5) * side, F.col("y") - (cy + 0.5) * side
    rows = points.select(cx.alias("cx"), cy.alias("cy"), value.alias("v"), dx.alias("dx"), dy.alias("dy"), *[c.alias(n) for n, c in sums.items()])
    return rows.groupBy("cx", "cy").agg(
        F.count("*").alias("n"), F.sum("v").alias("v"), F.sum(F.expr("v * dx")).alias("vx"), F.sum(F.expr("v * dy")).alias("vy"),
        F.sum(F.expr("v * (dx * dx + dy * dy)")).alias("vq"), *[F.sum(n).alias(n) for n in sums],
    )


def kernel_sums(probe: DataFrame, key: str, points: DataFrame, value: Column, radius: float, sums: dict[str, Column] | None = None, fine: int = FINE) -> DataFrame:
    """(key, n, wsum, ...) for each key of ``probe(key, px, py)`` with a point of ``points(x, y, ...)`` in its closed
    circle: their number, the sum of ``value`` weighted by the kernel, and the plain sums of ``sums``.

    Points and probes without coordinates meet nothing. Repeated keys add up. Points are combined a cell
    before they are shuffled; a cell that holds many of them is one row for every probe that contains it.
    """
    sums = sums or {}
    side, r2 = radius / fine, radius * radius
    cells = _cells(probe, key, radius, fine)
    gx, gy = (F.col("cx") + 0.5) * side - F.col("px"), (F.col("cy") + 0.5) * side - F.col("py")
    d2 = F.col("vq") + 2 * (gx * F.col("vx") + gy * F.col("vy")) + (gx * gx + gy * gy) * F.col("v")
    inner = cells.where("whole").join(cell_moments(points, value, side, sums), ["cx", "cy"]).select(key, "n", (F.col("v") - d2 / r2).alias("wsum"), *sums)
    rows = points.select("x", "y", value.alias("v"), F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"), *[c.alias(n) for n, c in sums.items()])
    at = spatial.squared_distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    rim = cells.where("not whole").join(rows, ["cx", "cy"]).where(at <= r2).select(key, F.lit(1).cast("long").alias("n"), (F.col("v") * (1 - at / r2)).alias("wsum"), *sums)
    return inner.unionByName(rim).groupBy(key).agg(F.sum("n").alias("n"), F.sum("wsum").alias("wsum"), *[F.sum(n).alias(n) for n in sums])
