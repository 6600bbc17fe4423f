"""Which points lie inside a boundary that is a table of edges: many rings, holes and islands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Points and edges of a task; a row with more is dealt out in blocks.
TASK_POINTS, TASK_EDGES = 400_000, 150_000
#: Columns of a task's points, and tests that are done at once.
COLUMNS, TESTS = 256, 1_000_000
EDGE = ["ax", "ay", "bx", "by"]


def edges_of(vertices: DataFrame, ring: str, seq: str) -> DataFrame:
    """(ax, ay, bx, by): the edges of closed rings ``vertices(ring, seq, x, y)``."""
    w = Window.partitionBy(ring).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return vertices.select(F.col("x").alias("ax"), F.col("y").alias("ay"), following("x").alias("bx"), following("y").alias("by"))


def _crossed(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, bottom: float, top: float) -> np.ndarray:
    """How many edges the ray east of each point crosses, for points between ``bottom`` and ``top``. Points are met
    by columns: edges that lie wholly east of one are counted by their ends, those that reach into it
    are tested against its points at their height."""
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    at = lambda y: (bx - ax) * (y - ay) / (by - ay) + ax
    x0, x1 = at(np.clip(bottom, low, high)), at(np.clip(top, low, high))
    slack = 1e-9 * (np.abs(ax) + np.abs(bx) + 1)
    west, east = np.minimum(x0, x1) - slack, np.maximum(x0, x1) + slack
    width = max(float(np.ptp(px)) / COLUMNS, 1e-9)
    col = np.floor((px - px.min()) / width).astype(np.int64)
    order = np.lexsort((py, col))
    cuts = np.flatnonzero(np.diff(col[order], prepend=-1, append=-1))
    by_low, by_high, out = np.argsort(low), np.argsort(high), np.zeros(len(px), dtype=np.int64)
    for s, e in zip(cuts, cuts[1:], strict=False):
        own = order[s:e]
        x, y = px[own], py[own]
        far = west > x.max()
        n = np.searchsorted(low[by_low[far[by_low]]], y, "right") - np.searchsorted(high[by_high[far[by_high]]], y, "right")
        near = np.flatnonzero(~far & (east >= x.min()))
        first = np.searchsorted(y, low[near])
        count = np.searchsorted(y, high[near]) - first
        near, first, count = near[count > 0], first[count > 0], count[count > 0]
        parts = [*np.flatnonzero(np.diff(np.cumsum(count) // TESTS, prepend=-1)).tolist(), len(near)]
        for i, j in zip(parts, parts[1:], strict=False):
            k, m = np.repeat(near[i:j], count[i:j]), count[i:j]
            at_ = np.repeat(first[i:j], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            right = x[at_] < (bx[k] - ax[k]) * (y[at_] - ay[k]) / (by[k] - ay[k]) + ax[k]
            n = n + np.bincount(at_[right], minlength=len(y))
        out[own] = n
    return out


def inside_rings(points: DataFrame, key: str, edges: DataFrame, side: float) -> DataFrame:
    """(key, inside) for each row of ``points(key, px, py)``, key unique: whether an odd number of ``edges(ax, ay, bx,
    by)`` crosses the ray east of it. Points without coordinates are outside.

    The plane is cut into rows of height ``side``; each point is in one, an edge in those that it meets. A row is a
    task, in blocks of points and edges if it holds many, whose counts add up. The tests are those of plain
    ray casting, so the results are the same, also for points on edges. The rows, a few numbers each, are
    broadcast.
    """
    ship_package(points.sparkSession)
    slack = side * 1e-9
    finite = lambda c: F.abs(F.col(c)) < F.lit(float("inf"))
    e = edges.where("ay <> by").select(*[F.col(c).cast("double").alias(c) for c in EDGE], F.least("ay", "by").alias("low"), F.greatest("ay", "by").alias("high"))
    e = e.select(*EDGE, F.explode(F.sequence(F.floor((F.col("low") - slack) / side), F.floor((F.col("high") + slack) / side))).alias("row"))
    placed = points.where(finite("px") & finite("py")).select(F.col(key).alias("k"), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), F.floor(F.col("py") / side).alias("row"))
    blocks = lambda rows, most, name: rows.groupBy("row").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    spread = F.broadcast(blocks(placed, TASK_POINTS, "np").join(blocks(e, TASK_EDGES, "ne"), "row"))
    deal = lambda n, *own: F.pmod(F.xxhash64(*own), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(spread, "row").withColumn("bp", deal("np", "k")).withColumn("be", every("ne")).drop("np", "ne")
    right = e.join(spread, "row").withColumn("be", deal("ne", *EDGE)).withColumn("bp", every("np")).drop("np", "ne")

    def work(p: pa.Table, e: pa.Table) -> pa.Table:
        schema = pa.schema([p.schema.field("k"), pa.field("n", pa.int64())])
        if not p.num_rows or not e.num_rows:
            return schema.empty_table()
        row = p.column("row")[0].as_py()
        n = _crossed(*(p.column(c).to_numpy() for c in ("px", "py")), *(e.column(c).to_numpy() for c in EDGE), (row - 1e-6) * side, (row + 1 + 1e-6) * side)
        some = np.flatnonzero(n)
        return pa.Table.from_arrays([p.column("k").take(pa.array(some)), pa.array(n[some])], schema=schema)

    task = ["row", "bp", "be"]
    met = left.groupBy(task).cogroup(right.groupBy(task)).applyInArrow(work, f"k {dict(placed.dtypes)['k']}, n long")
    odd = met.groupBy(F.col("k").alias(key)).agg((F.sum("n") % 2 == 1).alias("inside"))
    return points.select(key).join(odd, key, "left").select(key, F.coalesce("inside", F.lit(False)).alias("inside"))
