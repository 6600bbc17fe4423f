"""Alternatives to shortest paths: loopless deviations, searched for all trips at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, durable
from . import overlay

#: Deviations of one trip that its numbers leave room for, as a power of two.
ROOM = 20
#: Deviations of one trip whose nodes are found first; each round after that takes MORE times as many.
FIRST, MORE = 2, 4
#: Deviations up to so many times the best path and metres more are looked for first, longer ones for trips that lack some.
NEAR, NEAR_M = 1.1, 1000.0


def deviations(best: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, dst, so_far, pos, src) for each road that leaves a path of ``best(qid, length_m, nodes)`` towards a
    node that isn't on the path before: ``pos`` is the place on the path where it leaves, ``src`` is the road's end,
    ``so_far`` the metres up to there."""
    roads = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("len_m").alias("len_m"))
    on = best.select("qid", F.element_at("nodes", -1).alias("end"), "nodes", F.posexplode("nodes").alias("pos", "src"))
    on = on.select("qid", "end", "pos", "src", F.get("nodes", F.col("pos") + 1).alias("next"))
    along = on.where("next is not null").join(roads.withColumnRenamed("dst", "next"), ["src", "next"])
    before = F.coalesce(F.sum("len_m").over(Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    off = along.select("qid", "src", "next", "end", "pos", before.alias("before")).join(roads, "src").where("dst <> next")
    met = on.select("qid", F.col("src").alias("dst"), F.col("pos").alias("met"))
    off = off.join(met, ["qid", "dst"], "left").where("met is null or met > pos")
    return off.select("qid", F.col("end").alias("dst"), (F.col("before") + F.col("len_m")).alias("so_far"), "pos", F.col("dst").alias("src"))


def alternative_paths(best: DataFrame, over: overlay.Overlay, edges: DataFrame, most: int) -> DataFrame:
    """(qid, alt, length_m, nodes): of each path of ``best(qid, length_m, nodes)`` itself as number 0, then its
    shortest loopless deviations, ``most`` paths in all and none above the overlay's limit.

    A deviation leaves the best path at one of its nodes by another road, and follows the shortest path from
    that road's end. Deviations whose rest comes back to a node before are no alternatives. Of equally long
    ones the smaller nodes, from the start, come first; of equal ones one counts. Lengths of all trips' deviations
    are found backwards from the trips' ends. Nodes, which tell loops, are searched from the shortest ones on, those of
    equal length together, until a trip has enough alternatives or no more deviations.
    """
    off = deviations(best, edges).where(F.col("so_far") <= over.limit)
    number = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "src"))
    off = durable(off.withColumn("spur", F.shiftleft(F.col("qid"), ROOM) + number))
    asked = best.select("qid", F.col("nodes")[0].alias("src"), F.element_at("nodes", -1).alias("dst"), "length_m")
    turned, rounds, found, open_ = overlay.backward(over), [], None, asked
    near = F.least(F.lit(over.limit), F.col("length_m") * NEAR + NEAR_M)
    for low, high in ((F.lit(-1.0), near), (near, F.lit(over.limit))):
        trips = durable(open_.select("qid", "src", "dst", low.alias("low"), high.alias("most")).where("low < most"))
        if trips.isEmpty():
            continue
        own = off.join(trips.select("qid", "low", "most"), "qid")
        rests = overlay.rests(over, turned, trips, own.where("so_far <= most").select("qid", "src"))
        kept = own.join(rests, ["qid", "src"]).withColumn("length_m", F.col("so_far") + F.col("rest")).where("length_m > low and length_m <= most")
        place = F.rank().over(Window.partitionBy("qid").orderBy(F.bround("length_m", 6)))
        left, size = durable(kept.select("spur", "qid", "src", "dst", "pos", "rest", "length_m", place.alias("place"))), max(FIRST, most - 1)
        while not left.isEmpty():
            now = left.where(F.col("place") <= size)
            got = overlay.search(over, now.select(F.col("spur").alias("qid"), "src", "dst", (F.col("rest") * (1 + 1e-9)).alias("most")))
            rest = overlay.path_nodes(over, got).select(F.col("qid").alias("spur"), F.col("nodes").alias("rest"))
            root = best.select("qid", "nodes").join(now.select("spur", "qid", "pos", "length_m"), "qid").withColumn("root", F.slice("nodes", 1, F.col("pos") + 1))
            free = root.join(rest, "spur").where(~F.arrays_overlap("root", "rest")).select("qid", "length_m", F.concat("root", "rest").alias("nodes"))
            rounds.append(durable(free))
            found = reduce(DataFrame.unionByName, rounds)
            enough = found.groupBy("qid").agg(F.count_distinct("nodes").alias("n")).where(F.col("n") >= most - 1)
            after = durable(left.where(F.col("place") > size).join(enough, "qid", "left_anti"))
            discard(left)
            left, size = after, size * MORE
        if found is not None:
            open_ = asked.join(enough, "qid", "left_anti")
    if not rounds:
        return best.select("qid", F.lit(0).alias("alt"), "length_m", "nodes")
    ranked = found.groupBy("qid", "nodes").agg(F.min("length_m").alias("length_m"))
    alt = F.row_number().over(Window.partitionBy("qid").orderBy(F.bround("length_m", 6), "nodes"))
    others = ranked.withColumn("alt", alt).where(F.col("alt") < most).select("qid", F.col("alt").cast("int").alias("alt"), "length_m", "nodes")
    return best.select("qid", F.lit(0).alias("alt"), "length_m", "nodes").unionByName(others)
