"""Fuzzy place-name search by an inverted index of trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .spatial import squared_distance


def trigram_index(places: DataFrame) -> DataFrame:
    """(gram, pid) of ``places(pid, name)``."""
    return places.select("pid", F.explode(S.trigrams(S.normalise_name(F.col("name")))).alias("gram")).select("gram", "pid")


def search(places: DataFrame, queries: DataFrame, limit: int, near: bool = False) -> DataFrame:
    """(qid, pid, name, matched, rn): the best ``limit`` places of each row of ``queries(qid, q)``, by
    matched trigrams, then with ``near`` by distance to ``(qx, qy)``, then by name and id."""
    asked = queries.withColumn("gram", F.explode(S.trigrams(S.normalise_name(F.col("q")))))
    matched = asked.join(trigram_index(places), "gram").groupBy("qid", "pid").agg(F.count("*").alias("matched"))
    rows = matched.join(places, "pid")
    order = [F.desc("matched")]
    if near:
        rows = rows.join(queries.select("qid", "qx", "qy"), "qid").withColumn("d2", squared_distance(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")))
        order.append(F.asc("d2"))
    w = Window.partitionBy("qid").orderBy(*order, "name", "pid")
    return rows.withColumn("rn", F.row_number().over(w).cast("int")).where(F.col("rn") <= limit).select("qid", "pid", "name", "matched", "rn")
