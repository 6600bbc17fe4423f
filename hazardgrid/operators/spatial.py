"""Distance joins by grid cells, nearest neighbours, polylines and a boundary test.

A radius predicate alone plans as a nested loop. Here both sides get a cell of the radius' size, the
probe side nine of them, and the join is an equi join on cells with the exact distance as a residual:
it shuffles by cell, and adaptive execution may broadcast a small side or split a crowded cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def radius_join(probe: DataFrame, points: DataFrame, radius: float, at: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Rows of ``probe(px, py, ...)`` with those of ``points(x, y, ...)`` within ``radius``, and ``d2``.

    The side with fewer rows should be the probe: it is repeated ninefold.
    """
    x, y = at
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cells = probe.withColumn("__o", F.explode(offsets)).withColumn("__cx", F.floor(F.col("px") / radius) + F.col("__o.i")).withColumn("__cy", F.floor(F.col("py") / radius) + F.col("__o.j")).drop("__o")
    placed = points.withColumn("__cx", F.floor(F.col(x) / radius)).withColumn("__cy", F.floor(F.col(y) / radius))
    d2 = squared_distance(F.col("px"), F.col("py"), F.col(x), F.col(y))
    return cells.join(placed, ["__cx", "__cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("__cx", "__cy")


def nearest(probe: DataFrame, key: str, points: DataFrame, point_id: str, cap: float) -> DataFrame:
    """(key, node, dist): the nearest point within ``cap``, of equals the smaller id; node -1 and a
    null distance if there is none."""
    hits = radius_join(probe, points, cap)
    best = hits.groupBy(key).agg(F.min(F.struct("d2", point_id)).alias("b")).select(key, F.col(f"b.{point_id}").alias("node"), F.sqrt("b.d2").alias("dist"))
    return probe.select(key).join(best, key, "left").select(key, F.coalesce("node", F.lit(-1)).cast("long").alias("node"), "dist")


def sample_line(vertices: DataFrame, key: str, step: float) -> DataFrame:
    """(key, pos, px, py): a point every ``step`` along each segment of the polyline
    ``vertices(key, seq, x, y)``, and its last vertex."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("seq")
    seg = vertices.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    length = F.sqrt(squared_distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))
    seg = seg.withColumn("len", F.coalesce(length, F.lit(0.0)))
    steps = F.when(F.col("len") > 0, F.ceil(F.col("len") / step).cast("int")).otherwise(F.when(F.col("nx").isNull(), F.lit(1)).otherwise(F.lit(0)))
    many = seg.withColumn("n", steps).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = F.when(F.col("len") > 0, F.col("k") * step / F.col("len")).otherwise(F.lit(0.0))
    px = F.col("x") + F.coalesce((F.col("nx") - F.col("x")) * share, F.lit(0.0))
    py = F.col("y") + F.coalesce((F.col("ny") - F.col("y")) * share, F.lit(0.0))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("seq", "k")) - 1
    return many.select(key, pos.cast("long").alias("pos"), px.alias("px"), py.alias("py"))


def inside(points: DataFrame, key: str, boundary: list[tuple[float, float]]) -> DataFrame:
    """(key, inside) of ``points(px, py, ...)``, see is_inside."""
    return points.select(key, is_inside(F.col("px"), F.col("py"), boundary).alias("inside"))


def is_inside(px: Column, py: Column, boundary: list[tuple[float, float]]) -> Column:
    """Ray casting over a polygon given as vertices. The polygon is part of the plan, as an array, so no
    join is needed."""
    edges = list(zip(boundary, boundary[1:] + boundary[:1], strict=True))
    array = F.array(*[F.struct(F.lit(a[0]).alias("ax"), F.lit(a[1]).alias("ay"), F.lit(b[0]).alias("bx"), F.lit(b[1]).alias("by")) for a, b in edges])

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > py) != (e["by"] > py)
        at = (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        return F.when(spans, px < at).otherwise(F.lit(False))

    return F.size(F.filter(array, crosses)) % 2 == 1
