"""Ranks of values inside groups without a global sort, a group in one task or a job before the query.

A histogram of different values is cut into ranges at a sample of the values themselves, some cube root of
their number, taken by hash. The sample is a function of the values, so every use cuts alike in any
partitioning; at 1e10 different values some 2,000 cuts, which every row meets, leave 5e6 values a range.
Counts run inside a range; the ranges' totals say how many values lie before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame) -> DataFrame:
    """(band, v, n) of ``rows(band, v)``; nulls don't count."""
    return rows.where("v is not null and band is not null").groupBy("band", "v").agg(F.count("*").alias("n"))


def cut_points(counted: DataFrame) -> Column:
    """Map of each band to the sorted values that its ranges begin with, as a scalar subquery."""
    step = counted.agg(F.greatest(F.lit(1), F.ceil(F.pow(F.count("*"), F.lit(2 / 3)))).cast("long").alias("step")).scalar()
    cuts = counted.where(F.pmod(F.xxhash64("v"), step) == 0).groupBy("band").agg(F.array_sort(F.collect_list("v")).alias("cuts"))
    return cuts.agg(F.map_from_entries(F.collect_list(F.struct("band", "cuts")))).scalar()


def range_of(cuts: Column, v: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``v``, by bisection."""
    size = F.coalesce(F.size(cuts), F.lit(0))
    state = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when((s["lo"] < s["hi"]) & (F.get(cuts, mid) <= v), state(mid + 1, s["hi"])).otherwise(state(s["lo"], mid))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    return F.aggregate(rounds, state(F.lit(0), size), halve, lambda s: s["lo"])


def ranked(counted: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Adds ``upto`` (rows of the band that are at most ``v``) and ``total`` (all rows of the band) to
    ``counted(band, v, n)``, whose values are different, and to those of ``asked(band, v)``.

    ``counted`` is read some eight times and should be cheap, as a stored table is; ``asked`` is read once."""
    cuts = cut_points(counted)
    cut = lambda rows: rows.withColumn("cuts", F.element_at(cuts, F.col("band"))).withColumn("part", range_of(F.col("cuts"), F.col("v"))).drop("cuts")
    band = Window.partitionBy("band")
    # every range but the first holds the row that it begins with
    first = counted.select("band", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"))
    parts = cut(counted).select("band", "part", "n").unionByName(first).groupBy("band", "part").agg(F.sum("n").alias("own"))
    before = parts.select("band", "part", (F.sum("own").over(band.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(band).alias("total"))
    both = counted
    if asked is not None:
        both = counted.unionByName(asked.select("band", "v").distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("band", "v").agg(F.sum("n").alias("n"))
    inside = cut(both).withColumn("inside", F.sum("n").over(Window.partitionBy("band", "part").orderBy("v")))
    return inside.join(before, ["band", "part"]).select("band", "v", "n", (F.col("before") + F.col("inside")).alias("upto"), "total")


def percentiles(rows: DataFrame, shares: list[float]) -> DataFrame:
    """(band, p): the exact percentiles of ``rows(band, v)``, between neighbours in proportion."""
    counted = ranked(histogram(rows))
    at = lambda share: F.lit(share) * (F.col("total") - 1)
    met = lambda rank: F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("v")))
    ends = [e for k, s in enumerate(shares) for e in (met(F.floor(at(s))).alias(f"lo{k}"), met(F.ceil(at(s))).alias(f"hi{k}"))]
    found = counted.groupBy("band", "total").agg(*ends)

    def between(k: int, share: float) -> Column:
        lo, hi, place = F.col(f"lo{k}"), F.col(f"hi{k}"), at(share)
        return F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi)

    return found.select("band", F.array(*[between(k, s) for k, s in enumerate(shares)]).alias("p"))
