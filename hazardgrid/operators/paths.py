"""Shortest paths on a directed network without places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, durable


def relaxed_lengths(queries: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(qid, found, length_m, nodes) for each row of ``queries(qid, src, dst)`` over
    ``edges(src, dst, len_m)``: relaxation until no distance gets smaller, then a walk back. It needs no
    places of nodes, but a round for every road of the longest path; see ``overlay`` for the others."""
    known = queries.select("qid", F.col("src").alias("node"), F.struct(F.lit(0.0).alias("d"), F.lit(-1.0).alias("from_d"), F.lit(0).alias("zeros"), F.lit(None).cast("long").alias("prev")).alias("s"), F.lit(True).alias("new"))
    known = durable(known)
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "len_m")
    # of equal lengths the nearer, then the smaller predecessor; edges of no length are counted, so none closes a circle
    reached = F.struct((F.col("s.d") + F.col("len_m")).alias("d"), F.col("s.d").alias("from_d"), F.when(F.col("len_m") > 0, 0).otherwise(F.col("s.zeros") + 1).alias("zeros"), F.col("node").cast("long").alias("prev"))
    while not known.where("new").isEmpty():
        step = known.where("new").join(e, "node").select("qid", F.col("next").alias("node"), reached.alias("s")).where(F.col("s.d") <= limit)
        tried = known.select("qid", "node", "s", F.lit(0).alias("late")).unionByName(step.withColumn("late", F.lit(1)))
        best = tried.groupBy("qid", "node").agg(F.min(F.struct("s", "late")).alias("b"))
        after = durable(best.select("qid", "node", "b.s", (F.col("b.late") == 1).alias("new")))
        discard(known)
        known = after
    end = known.select("qid", F.col("node").alias("dst"), F.col("s.d").alias("length_m"))
    out = queries.select("qid", "dst").join(end, ["qid", "dst"], "left")
    back = known.select("qid", F.col("node").cast("long").alias("head"), F.col("s.prev").alias("prev"))
    walk = out.where("length_m is not null").select("qid", F.col("dst").cast("long").alias("head"), F.array(F.col("dst").cast("long")).alias("nodes"))
    done = walk.limit(0).select("qid", "nodes")
    while not walk.isEmpty():
        walk = durable(walk.join(back, ["qid", "head"]))
        done = durable(done.unionByName(walk.where("prev is null").select("qid", "nodes")))
        walk = walk.where("prev is not null").select("qid", F.col("prev").alias("head"), F.concat(F.array("prev"), "nodes").alias("nodes"))
    return out.join(done, "qid", "left").select("qid", F.col("length_m").isNotNull().alias("found"), "length_m", "nodes")
