"""Daily counts over a stream of accidents, with the month that each day adds to.

The analysis itself is batch; this is its trend for a feed that grows. State is one count a day and
leaves memory once the watermark passes the day; a month is the sum of its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_counts(events: DataFrame, time: str = "ts", late: str = "7 days") -> DataFrame:
    """(ym, day, n, deaths), a row a day, of a streaming ``events(ts, fat)``; rows later than ``late`` are left
    out."""
    stamped = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    daily = stamped.groupBy(F.window("__at", "1 day").alias("day")).agg(F.count("*").alias("n"), F.sum("fat").cast("long").alias("deaths"))
    return daily.select(F.date_format("day.start", "yyyy-MM").alias("ym"), F.to_date("day.start").alias("day"), "n", "deaths")
