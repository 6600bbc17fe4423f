"""Rankings of crossings and their accident points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scalar as S
from .tiles import disc_sums, nearest_disc


def nearby(hits: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """The most frequent crossings of each key: rounded distance, hot mark, rank; ties by id."""
    w = Window.partitionBy(key).orderBy(F.desc("cnt"), "xid")
    dist = F.bround(F.sqrt("d2")).cast("int")
    rows = hits.withColumn("dist", dist).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= config.shown_crossings)
    return rows.select(key, "xid", "name", "cls", "cnt", "dist", is_hot(F.col("dist"), F.col("cnt"), config).alias("hot"), F.col("rn").cast("int").alias("rn"))


def is_hot(dist: Column, cnt: Column, config: Config = DEFAULT) -> Column:
    """The test uses the rounded distance, so that it agrees with the number shown."""
    return (dist <= config.near_hot) & (cnt >= config.high_count)


def hot_around(places: DataFrame, key: str, crossings: DataFrame, radius: float, config: Config = DEFAULT) -> DataFrame:
    """``hot_count`` of the crossings within ``radius``, without their pairs: distances that round to near_hot end half a
    metre beyond it, at an even number with it."""
    assert config.near_hot % 2 == 0 and config.near_hot + 0.5 <= radius
    some = disc_sums(places, key, crossings, radius).select(key)
    hot = disc_sums(places, key, crossings.where(F.col("cnt") >= config.high_count), config.near_hot + 0.5)
    return some.join(hot, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("hot"))


def hot_count(hits: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    return hits.groupBy(key).agg(F.count_if(is_hot(F.bround(F.sqrt("d2")).cast("int"), F.col("cnt"), config)).alias("hot"))


def points(accidents: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` accidents of each crossing in index order, as detail records. The planner
    limits each group before the shuffle."""
    w = Window.partitionBy("xid").orderBy("aid")
    rows = accidents.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    jx, jy = S.jitter(F.col("aid"), DEFAULT.jitter)
    return rows.select("xid", "aid", S.occurred_at(F.col("ymd"), F.col("hms")).alias("occurred_at"), F.col("category"), "parties", F.col("fat").alias("fatalities"), F.col("inj").alias("injuries"), F.bround(F.col("x") + jx, 3).alias("jx"), F.bround(F.col("y") + jy, 3).alias("jy"))


def busiest(hits: DataFrame, key: str) -> DataFrame:
    """(key, xid): the crossing with most accidents in reach; of equals the smaller id."""
    return hits.groupBy(key).agg(F.max_by("xid", F.struct("cnt", (-F.col("xid")).alias("neg"))).alias("xid"), F.max("cnt").alias("cnt"))


def assign(accidents: DataFrame, crossings: DataFrame, reach: float) -> DataFrame:
    """(aid, xid, dist): the nearest crossing of each accident within ``reach``, of equals the smaller id;
    nulls if there is none."""
    middles = crossings.select("xid", F.col("x").alias("px"), F.col("y").alias("py"))
    best = nearest_disc(middles, "xid", accidents, "aid", reach)
    return accidents.select("aid").join(best, "aid", "left").select("aid", "xid", F.sqrt("d2").alias("dist"))


def records(near: DataFrame, key: str, crossings: DataFrame) -> DataFrame:
    """``nearby`` with the rank within the class and a text."""
    text = F.format_string("%d accidents, distance %d m, %s", "cnt", "dist", "cls")
    return near.join(class_rank(crossings).select("xid", "rank"), "xid").select(key, "xid", "rn", "name", "cls", "cnt", "dist", "hot", "rank", text.alias("detail"))


def class_rank(crossings: DataFrame) -> DataFrame:
    """Percent rank of the count within the class, from counts of counts, so that a large class is not
    one task's sort."""
    counts = crossings.groupBy("cls", "cnt").agg(F.count("*").alias("m"))
    w = Window.partitionBy("cls").orderBy("cnt")
    below = F.sum("m").over(w) - F.col("m")
    total = F.sum("m").over(Window.partitionBy("cls"))
    ranked = counts.select("cls", "cnt", F.when(total > 1, below / (total - 1)).otherwise(0.0).alias("rank"))
    return crossings.select("xid", "cls", "cnt").join(ranked, ["cls", "cnt"]).select("xid", "cls", "cnt", F.bround("rank", 6).alias("rank"))
