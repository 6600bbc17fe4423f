"""Aggregates over the accidents in reach, trends, strata, shrinkage and percentile scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scalar as S
from . import ranks

def casualty_columns(pedestrian: str) -> list[Column]:
    """n, fat, inj, ped_fat of a group of hits."""
    dead = F.when((F.col("fat") > 0) & S.mentions(F.col("parties"), pedestrian), F.col("fat")).otherwise(0)
    return [F.count("*").alias("n"), F.sum("fat").cast("long").alias("fat"), F.sum("inj").cast("long").alias("inj"), F.sum(dead).cast("long").alias("ped_fat")]


def share_columns() -> list[Column]:
    """n_hours, night, peak of a group of hits."""
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return [F.count("*").alias("n_hours"), one(S.is_night(F.col("hour"))).alias("night"), one(S.is_peak(F.col("hour"))).alias("peak")]


def involvement_columns(pedestrian: str, large: tuple[str, ...]) -> list[Column]:
    return [F.count_if(S.mentions(F.col("parties"), pedestrian)).alias("ped"), F.count_if(S.mentions(F.col("parties"), *large)).alias("large")]


def casualty_sums(pedestrian: str) -> dict[str, Column]:
    """fat, inj and ped_fat as sums over accidents."""
    dead = F.when((F.col("fat") > 0) & S.mentions(F.col("parties"), pedestrian), F.col("fat")).otherwise(0)
    return {"fat": F.col("fat"), "inj": F.col("inj"), "ped_fat": dead}


def share_sums() -> dict[str, Column]:
    """Accidents in night and in peak hours, for ``as_shares``."""
    return {"night": S.is_night(F.col("hour")).cast("int"), "peak": S.is_peak(F.col("hour")).cast("int")}


def as_shares(sums: DataFrame) -> DataFrame:
    """``sums(n, night, peak, ...)`` with the shares of n in place of the numbers, and ``n_hours``."""
    return sums.withColumns({"n_hours": F.col("n"), **{c: F.col(c).cast("double") / F.nullif(F.col("n"), F.lit(0)) for c in ("night", "peak")}})


def involvement_sums(pedestrian: str, large: tuple[str, ...]) -> dict[str, Column]:
    return {"ped": S.mentions(F.col("parties"), pedestrian).cast("int"), "large": S.mentions(F.col("parties"), *large).cast("int")}


def month_sums(months: int) -> dict[str, Column]:
    """Accidents in each month of the period, for ``monthly_sums``."""
    return {f"m{k}": (F.col("mi") == k).cast("int") for k in range(months)}


def monthly_sums(keys: DataFrame, sums: DataFrame, key: str, months: int, first: str) -> DataFrame:
    """(key, ym, n, partial) with a row for every month of the period, from ``month_sums`` of the keys that
    have accidents."""
    rows = keys.select(key).join(sums.select(key, F.array(*[f"m{k}" for k in range(months)]).alias("__m")), key, "left")
    rows = rows.select(key, "__m", F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("mi"))
    ym = F.date_format(F.add_months(F.lit(first).cast("date"), F.col("mi")), "yyyy-MM")
    return rows.select(key, ym.alias("ym"), F.coalesce(F.get("__m", F.col("mi")), F.lit(0)).alias("n"), F.lit(False).alias("partial"))


def weight_column(radius: float) -> Column:
    """Kernel-weighted severity."""
    return F.sum(F.col("sev") * S.kernel_squared(F.col("d2"), radius)).alias("wsum")


def casualties(hits: DataFrame, key: str, pedestrian: str) -> DataFrame:
    return hits.groupBy(key).agg(*casualty_columns(pedestrian))


def density(hits: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, n, wsum): accidents in the closed circle and their kernel-weighted severity."""
    return hits.groupBy(key).agg(F.count("*").alias("n"), weight_column(radius))


def network_km(hits: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, km): kernel-weighted length of road segments, weighted at their midpoints."""
    return hits.groupBy(key).agg((F.sum(F.col("len_m") * S.kernel_squared(F.col("d2"), radius)) / 1000.0).alias("km"))


def shares(hits: DataFrame, key: str) -> DataFrame:
    """(key, n_hours, night, peak) of the rows themselves."""
    return hits.groupBy(key).agg(*share_columns())


def with_fallback(own: DataFrame, accidents: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Shares of keys with few rows become those of all accidents."""
    everywhere = accidents.agg(*share_columns())
    few = F.coalesce("n_hours", F.lit(0)) < config.fallback_below
    for c in ("night", "peak"):
        own = own.withColumn(c, F.when(few, F.coalesce(everywhere.select(c).scalar(), F.lit(0.0))).otherwise(F.col(c)))
    return own


def involvement(hits: DataFrame, key: str, pedestrian: str, large: tuple[str, ...]) -> DataFrame:
    return hits.groupBy(key).agg(*involvement_columns(pedestrian, large))


def monthly_trend(keys: DataFrame, hits: DataFrame, key: str, months: int, first: str) -> DataFrame:
    """(key, ym, n, partial) with a row for every month of the period."""
    counted = hits.where((F.col("mi") >= 0) & (F.col("mi") < months)).groupBy(key, "mi").agg(F.count("*").alias("n"))
    spine = keys.select(key).withColumn("mi", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    ym = F.date_format(F.add_months(F.lit(first).cast("date"), F.col("mi")), "yyyy-MM")
    return spine.join(counted, [key, "mi"], "left").select(key, ym.alias("ym"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(False).alias("partial"))


def strata(samples: DataFrame, bands: int, minimum: float) -> DataFrame:
    """``samples(id, km, risk)`` with ``band``, equal shares by km. Boundaries are exact percentiles of
    km, so no global sort or single-task window is needed."""
    kept = samples.where(F.col("km") >= minimum)
    cuts = ranks.percentiles(kept.select(F.lit(0).alias("band"), F.col("km").alias("v")), [k / bands for k in range(1, bands)])
    kept = kept.withColumn("__cuts", cuts.select("p").scalar())
    return kept.withColumn("band", F.size(F.filter("__cuts", lambda e: e <= F.col("km")))).drop("__cuts")


def with_band(rows: DataFrame, km: str, banded: DataFrame) -> DataFrame:
    """Adds ``band``: the last stratum of ``banded`` whose lower edge is not above ``km``; shorter networks
    count to the first."""
    low = banded.groupBy("band").agg(F.min("km").alias("lo"))
    rows = rows.withColumn("__low", low.agg(F.collect_list(F.struct("band", "lo"))).scalar())  # a row a stratum
    reached = F.transform(F.filter("__low", lambda e: e["lo"] <= F.col(km)), lambda e: e["band"])
    return rows.withColumn("band", F.coalesce(F.array_max(reached), F.lit(0))).drop("__low")


def band_median(banded: DataFrame) -> DataFrame:
    """(band, med, samples, lo, hi) of each stratum."""
    med = ranks.percentiles(banded.select("band", F.col("risk").alias("v")), [0.5]).select("band", F.col("p")[0].alias("med"))
    out = banded.groupBy("band").agg(F.count("*").alias("samples"), F.min("km").alias("lo"), F.max("km").alias("hi"))
    return out.join(med, "band", "left").select("band", "med", "samples", "lo", "hi")


def shrunk_risk(measured: DataFrame, medians: DataFrame, shrink_km: float) -> DataFrame:
    """Adds ``risk`` (raw) and ``shrunk`` to ``measured(wsum, km, band)``: the evidence of ``shrink_km``
    more of typical road pulls short networks to their stratum's median."""
    joined = measured.join(F.broadcast(medians.select("band", "med")), "band", "left")
    return joined.withColumn("risk", F.try_divide("wsum", "km")).withColumn("shrunk", (F.col("wsum") + shrink_km * F.coalesce("med", F.lit(0.0))) / (F.col("km") + shrink_km))


def percentile_score(values: DataFrame, key: str, banded: DataFrame) -> DataFrame:
    """(key, score): percent of the stratum's samples that are more dangerous than ``shrunk``.

    Asked values stand in the samples' histogram with no rows of their own; ``ranks`` counts in it, so no task
    holds a stratum, and pairs never form.
    """
    samples = ranks.histogram(banded.select("band", F.col("risk").alias("v")))
    placed = ranks.ranked(samples, values.select("band", F.col("shrunk").alias("v")).where("v is not null"))
    placed = placed.select("band", F.col("v").alias("shrunk"), (F.col("total") - F.col("upto")).alias("above"), "total")
    score = F.bround(100.0 * F.col("above") / F.nullif(F.col("total"), F.lit(0))).cast("int")
    return values.select(key, "band", "shrunk").join(placed, ["band", "shrunk"], "left").select(key, score.alias("score"))
