"""Embedding whitening: the covariance is gathered as exact whole numbers on Spark, cyclic Jacobi rotations
on the driver diagonalise it, and the whitening matrix, a few columns, is broadcast.

Entries c become whole numbers x = floor(1024 c) + 100000. Sums, the centred scatter and the squared
distances to the mean are exact, so whitened rows don't depend on how rows are partitioned or ordered.

Dropped are rows whose vector is null, empty or holds null or non-finite entries, and those of another
length than most vectors have (of equally frequent lengths, the longest counts). Entries must lie below
2**40 in magnitude; a larger one is an error, as its number would not be exact. A null vec_id stays null;
repeated rows count as often as they stand; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 1024, 100_000
#: Rows that are multiplied at once: with entries up to 2**20 their scatter stays below 2**53.
BLOCK = 4096
EXACT = 1 << 53
#: Entries must be smaller in magnitude.
LARGEST = float(1 << 40)


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric positive semidefinite
    matrix. Sweeps of rotations go over all pairs until each off-diagonal entry vanishes against the
    two diagonal ones beside it, which keeps small eigenvalues accurate relative to their own size."""
    a = np.array(a, dtype=np.float64)
    d = len(a)
    v = np.eye(d)
    tiny = np.finfo(np.float64).eps / 4
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(a[p, q]) <= tiny * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                t = (a[q, q] - a[p, p]) / (2.0 * a[p, q])
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                c = 1.0 / np.hypot(1.0, t)
                s = t * c
                away = t * a[p, q]
                app, aqq = a[p, p] - away, a[q, q] + away
                rows = a[[p, q]]
                a[p], a[q] = c * rows[0] - s * rows[1], s * rows[0] + c * rows[1]
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                cols = v[:, [p, q]]
                v[:, p], v[:, q] = c * cols[:, 0] - s * cols[:, 1], s * cols[:, 0] + c * cols[:, 1]
        if not turned:
            break
    else:
        raise RuntimeError("the rotations did not settle")
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v / np.linalg.norm(v, axis=0)


def whole_numbers(part: pa.RecordBatch) -> np.ndarray:
    """The x-vectors of a batch's column ``embedding`` (all of one length)."""
    flat = part.column(part.schema.get_field_index("embedding"))
    x = np.floor(np.asarray(flat.flatten(), dtype=np.float64) * SCALE)
    return (x.astype(np.int64) + SHIFT).reshape(part.num_rows, -1)


def sound(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that remain, entries as doubles, and their length (0 for no rows)."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", e.alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    most = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"]
    return (rows.where(F.size("embedding") == most), most) if most else (rows.limit(0), 0)


def scatter(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sums of the products (x_i - centre_i) (x_j - centre_j), exact, as Python numbers (d x d). Each task
    adds up its own d x d numbers; these are added by Spark, and the sums, one matrix, are collected."""
    spark = vectors.sparkSession
    d = len(centre)
    told = spark.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = whole_numbers(batch.slice(at, BLOCK)) - told.value
                most = int(np.abs(z).max(initial=0))
                if most * most * len(z) < EXACT:  # then the products of doubles are exact, too
                    y = z.astype(np.float64)
                    total += (y.T @ y).astype(np.int64).astype(object)
                else:
                    y = z.astype(object)
                    total += y.T @ y
        for i in range(d):  # a row at a time, as text: the numbers may be long
            yield pa.RecordBatch.from_arrays([pa.array([i] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([str(int(x)) for x in total[i]])], names=["i", "j", "s"])

    parts = vectors.select("embedding").mapInArrow(run, "i int, j int, s string")
    out = np.zeros((d, d), dtype=object)
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).toLocalIterator():
        out[r["i"], r["j"]] = int(r["s"])
    return out


def covariance(n: int, sums: list[int], centre: list[int], products: np.ndarray) -> np.ndarray:
    """The covariance from sums and the scatter about whole numbers near the mean, each entry an exact
    fraction rounded once."""
    off = [s - n * c for s, c in zip(sums, centre, strict=True)]
    d = len(off)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = float(Fraction(n * int(products[i, j]) - off[i] * off[j], n * n))
    return out


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each sound row of
    ``vectors(vec_id, embedding)`` and each of the first ``components`` components.

    n counts the fit list, all sound rows, with sums S; deviation is the sum of (n x - S)**2 over the
    dimensions, exact, null where it doesn't fit a long; whitened is x - S/n projected on the component's
    unit eigenvector over the root of its eigenvalue e; explained is e over the trace. A component whose
    eigenvalue vanishes (by double precision) has null in whitened. identity_error is measured over the
    written whitened rows: the largest absolute entry of their covariance minus the identity, without
    vanishing components (null if there are no others).
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = sound(vectors)
    if not d:
        return spark.createDataFrame([], schema)
    x = [F.floor(F.element_at("embedding", i + 1) * SCALE).cast("decimal(20,0)") for i in range(d)]
    largest = F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding"))))
    first = rows.agg(F.count("*").alias("n"), largest.alias("largest"), F.array(*[F.sum(c) for c in x]).alias("sums")).first()
    if first["largest"] >= LARGEST:
        raise ValueError("an entry of a vector is too large for exact whole numbers")
    n, sums = first["n"], [int(s) + SHIFT * first["n"] for s in first["sums"]]
    centre = [round(Fraction(s, n)) for s in sums]
    products = scatter(rows, np.array(centre, dtype=np.int64))
    cov = covariance(n, sums, centre, products)
    values, vectors_ = jacobi(cov)
    k = min(components, d)
    trace = float(sum(Fraction(n * int(products[i, i]) - (sums[i] - n * centre[i]) ** 2, n * n) for i in range(d)))
    alive = values[:k] > max(trace, 0.0) * d * np.finfo(np.float64).eps
    matrix = np.where(alive, vectors_[:, :k] / np.sqrt(np.where(alive, values[:k], 1.0)), 0.0)
    fraction = np.array([float(Fraction(s, n) - c) for s, c in zip(sums, centre, strict=True)])
    told = spark.sparkContext.broadcast((np.array(centre, dtype=np.int64), fraction, matrix, [s - n * c for s, c in zip(sums, centre, strict=True)]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, rest, w, off = told.value
        for batch in batches:
            z = whole_numbers(batch) - near
            most = n * (int(np.abs(z).max(initial=0)) + 1)
            if most < 1 << 31 and most * most * d < 1 << 62:
                far = [int(t) for t in ((n * z - np.array(off, dtype=np.int64)) ** 2).sum(axis=1)]
            else:
                far = [int(t) for t in ((n * z.astype(object) - np.array(off, dtype=object)) ** 2).sum(axis=1)]
            far = [t if t < 1 << 63 else None for t in far]
            y = np.zeros((len(z), w.shape[1]))
            for i, row in enumerate(w):  # in this order for any size of batch
                y += (z[:, i] - rest[i])[:, None] * row
            lists = pa.ListArray.from_arrays(np.arange(0, (len(z) + 1) * w.shape[1], w.shape[1], dtype=np.int32), y.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.int64()), lists], names=["vec_id", "deviation", "w"])

    out = common.durable(rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(project, "vec_id long, deviation long, w array<double>"))
    live = [i for i in range(k) if alive[i]]
    error = None
    if live:
        w = [F.element_at("w", i + 1) for i in live]
        means = out.agg(F.array(*[F.avg(c) for c in w]).alias("m")).first()["m"]
        centred = [c - m for c, m in zip(w, means, strict=True)]
        products_ = out.agg(F.array(*[F.avg(a * b) for i, a in enumerate(centred) for b in centred[i:]]).alias("c")).first()["c"]
        wanted = [float(i == j) for i in range(len(live)) for j in range(i, len(live))]
        error = max(abs(c - e) for c, e in zip(products_, wanted, strict=True))
    shown = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.element_at("w", i + 1) if alive[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(float(values[i] / trace) if trace else None).cast("double").alias("explained")) for i in range(k)])
    each = out.select("vec_id", "deviation", F.explode(shown).alias("c"))
    return each.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
