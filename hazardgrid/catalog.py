"""Registered queries, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import scalar as S
from .operators import crossings as X
from .operators import measures as M
from .operators import boundary, places, spatial
from .operators.splits import split_by_date
from .oracle import oracle_sql as _oracle
from .plans import reports as R
from .plans import surrogate as sur

CUTOFF = date(1998, 1, 1)


def _orders(t: sur.Tables) -> DataFrame:
    return t.read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("occurred_on"))


def _rounded(df: DataFrame, places_: int, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.bround(n, places_))
    return df


def _shares(t: sur.Tables) -> DataFrame:
    return t.locations().select("lid").join(R.walk_shares(t), "lid", "left")


def _near(t: sur.Tables, radius: float = DEFAULT.walk_radius) -> DataFrame:
    return spatial.radius_join(t.locations(), t.crossings(), radius)


def _busiest_points(t: sur.Tables) -> DataFrame:
    best = X.busiest(_near(t, 300.0), "lid").select("lid", "xid")
    pts = X.points(t.accidents(), DEFAULT.points_per_crossing)
    return best.join(pts, "xid").select("lid", "xid", "aid", F.col("fatalities").alias("fat"), F.col("injuries").alias("inj"))


def _stars(t: sur.Tables) -> DataFrame:
    s = F.col("score")
    return R.scored(t).select("lid", S.star(s).alias("stars"), S.tone(s).alias("tone"), S.grade(s).alias("grade"), S.bars(s).alias("bars"))


def _names(t: sur.Tables) -> DataFrame:
    asked = t.place_queries().select(F.col("qid").alias("id"), F.col("q").alias("name"))
    return asked.unionByName(t.places().select(F.col("pid").alias("id"), "name")).select("id", S.normalise_name(F.col("name")).alias("name"))


def _jitter(t: sur.Tables) -> DataFrame:
    dx, dy = S.jitter(F.col("event_id"), DEFAULT.jitter)
    return t.read("events").select(F.col("event_id").alias("aid"), F.bround(dx, 6).alias("dx"), F.bround(dy, 6).alias("dy"))


def _meta(t: sur.Tables) -> DataFrame:
    one = t.accidents().agg(F.count("*").alias("accidents"))
    for df in (
        t.read("part").agg(F.count("*").alias("intersections")),
        t.edges().where("src < dst").agg(F.bround(F.sum("len_m") / 1000, 1).alias("walk_network_km")),
        R.baseline(t).agg(F.count("*").alias("baseline_cells")),
        t.places().agg(F.count("*").alias("places")),
    ):  # each side is one row
        one = one.join(F.broadcast(df), how="cross")
    return one.select("*", F.lit(DEFAULT.data_from).alias("range_from"), F.lit(DEFAULT.data_to).alias("range_to"))


def _worst(t: sur.Tables) -> DataFrame:
    names = ["accidents", "crossings", "large", "night", "pedestrian"]
    rows = R.walk_report(t).select("lid", F.posexplode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"f_{n}").alias("score")) for n in names])).alias("ord", "f"))
    rn = F.row_number().over(Window.partitionBy("lid").orderBy("f.score", "ord")).cast("int")
    return rows.withColumn("rn", rn).where("rn <= 2").select("lid", "f.factor", "f.score", "rn")


_QUERIES: dict[str, Callable[[sur.Tables], DataFrame]] = {
    "kernel_weight": lambda t: t.read("events").select("event_id", F.bround(S.kernel((F.col("event_id") % 700).cast("double"), 500.0), 9).alias("weight")),
    "severity": lambda t: t.accidents().select("aid", "sev"),
    "split_train": lambda t: split_by_date(_orders(t), CUTOFF)[0],
    "split_test": lambda t: split_by_date(_orders(t), CUTOFF)[1],
    "walk_density": R.walk_density,
    "walk_network_km": lambda t: _rounded(R.measured(t, t.locations(), "lid").select("lid", "km"), 9, "km"),
    "walk_risk": lambda t: R.measured(t, t.locations(), "lid").select("lid", "n", F.bround(F.try_divide("wsum", "km"), 6).alias("risk")),
    "walk_casualties": R.walk_casualties,
    "hour_shares": lambda t: _rounded(M.with_fallback(_shares(t), t.accidents()).select("lid", "night", "peak"), 9, "night", "peak"),
    "hour_shares_plain": lambda t: _shares(t).select("lid", *[F.bround(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("night", "peak")]),
    "involvement": R.walk_involvement,
    "monthly_trend": R.walk_trend,
    "order_trend": lambda t: t.read("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.count("*").alias("n")),
    "confidence_label": lambda t: R.walk_sums(t).select("lid", S.confidence(F.col("n")).alias("confidence")),
    "nearby_crossings": R.near_crossings,
    "hot_crossings": lambda t: X.hot_around(t.locations(), "lid", t.crossings(), DEFAULT.walk_radius),
    "crossing_points": lambda t: X.points(t.accidents(), DEFAULT.points_per_crossing),
    "busiest_crossing": lambda t: X.busiest(_near(t, 300.0), "lid"),
    "busiest_points": _busiest_points,
    "crossing_records": lambda t: X.records(R.near_crossings(t), "lid", t.crossings()),
    "accident_crossing": lambda t: _rounded(X.assign(t.accidents(), t.crossings(), DEFAULT.assign_max), 6, "dist"),
    "class_rank": lambda t: X.class_rank(t.crossings()),
    "strata": R.baseline,
    "baseline_refresh": R.refreshed_baseline,
    "ride_strata": R.ride_baseline,
    "band_median": lambda t: _rounded(M.band_median(R.baseline(t)), 6, "med"),
    "shrunk_risk": lambda t: R.scored(t).select("lid", "band", "shrunk"),
    "percentile_score": lambda t: R.scored(t).select("lid", "score"),
    "stars": _stars,
    "walk_report": R.walk_report,
    "snap_nearest": lambda t: _rounded(spatial.nearest(t.locations(), "lid", t.nodes(), "node", DEFAULT.snap_max), 6, "dist"),
    "route_error": R.route_errors,
    "request_results": R.request_results,
    "shortest_distance": R.shortest_lengths,
    "overlay_distance": R.way_back,
    "path_samples": lambda t: _rounded(R.samples(R.given_routes(t)), 6, "px", "py"),
    "route_accidents": lambda t: R.route_accidents(t, R.given_routes(t)),
    "route_crossings": lambda t: R.route_crossings(t, R.given_routes(t)),
    "route_best": lambda t: R.route_report(t).where("recommended").select("trip", "rid", "label", "score", "km"),
    "route_minutes": lambda t: R.given_routes(t).lengths.select("rid", S.minutes(F.col("km"), DEFAULT.ride_kmh).alias("min"), F.bround("km", 1).alias("km")),
    "route_report": R.route_report,
    "analyze_route": R.analyze_route,
    "route_alternatives": R.route_alternatives,
    "route_candidates": R.route_candidates,
    "route_trend": R.route_trend,
    "route_path": R.route_path,
    "name_normalise": _names,
    "name_search": lambda t: places.search(t.places(), t.place_queries(), 8),
    "name_search_near": lambda t: places.search(t.places(), t.place_queries(), 8, near=True),
    "jitter": _jitter,
    "dataset_meta": _meta,
    "inside_boundary": lambda t: spatial.inside(t.locations(), "lid", sur.BOUNDARY),
    "inside_rings": lambda t: boundary.inside_rings(t.accidents().select("aid", F.col("x").alias("px"), F.col("y").alias("py")), "aid", boundary.edges_of(t.ring_vertices(), "ring", "seq"), DEFAULT.ring_cell),
    "name_hash": lambda t: t.read("supplier").select("s_suppkey", S.text_hash(F.col("s_name")).alias("h")),
    "worst_factors": _worst,
    "path_documents": R.path_documents,
    # no SQL form: nested documents
    "walk_documents": R.walk_documents,
    "route_documents": R.route_documents,
}


def _runner(build: Callable[[sur.Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(sur.Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return _oracle()
