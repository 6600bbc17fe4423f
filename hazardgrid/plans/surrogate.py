"""The analysis' tables, derived from the driver's by integer formulas that every engine repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scalar as S
from ..operators import spatial
from ..scratch import durable, scratch_dir, written

PEDESTRIAN, LARGE = "signup", ("purchase", "error", "view")
SIDE, SPACING = 40, 250.0
FIRST_MONTH = "2024-07-01"
BOUNDARY = [(500.0, 500.0), (9000.0, 900.0), (9500.0, 6000.0), (5200.0, 9500.0), (4800.0, 5000.0), (700.0, 8200.0)]

#: Where the tables of ``Tables.stored`` are, and their schemas.
_STORED: dict[tuple[str, str, str], tuple[str, object]] = {}


def join_by_shuffle(spark: SparkSession) -> None:
    """Joins of this session go by shuffle unless a side has turned out small, or is marked as such. The planner
    takes a side to be as large as its compressed file, which exploded cells, samples and grams outgrow some
    thousandfold, and would build it on the driver."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "256k")


class Tables:
    """Lazily built views of one set of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        join_by_shuffle(spark)
        #: Tables that several parts of one query read, made once.
        self.made: dict[str, object] = {}

    def read(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        if path not in self.made:  # a footer is read once a query
            self.made[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.made[path]).parquet(path)

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table that ``build`` makes, written once a session and folder; queries that follow read it."""
        key = (scratch_dir(self.spark), self.dir, name)
        if key not in _STORED or not written(self.spark, _STORED[key][0]):
            made = durable(build())
            _STORED[key] = made._scratch_path, made.schema
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    def accidents(self) -> DataFrame:
        i = F.col("event_id")
        fat = F.when(F.col("event_type") == "error", i % 3).otherwise(0).cast("int")
        rows = self.read("events").select(
            i.alias("aid"), (i * 7919 % 10007).cast("double").alias("x"), (i * 104729 % 10009).cast("double").alias("y"), F.hour("ts").alias("hour"),
            fat.alias("fat"), F.floor(F.col("value") / 50).cast("int").alias("inj"), (i % 27 - 1).cast("int").alias("mi"), (i * 31 % 200).alias("xid"),
            F.when(i % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("parties"), F.col("event_type").alias("category"),
            F.date_format("ts", "yyyyMMdd").alias("ymd"), F.date_format("ts", "HHmmss").alias("hms"),
        )
        return rows.withColumn("sev", S.severity(F.col("fat"), DEFAULT.fatality_weight))

    def crossings(self) -> DataFrame:
        counted = self.read("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("cnt"))
        p = F.col("p_partkey")
        return self.read("part").join(counted, "p_partkey", "left").select(p.alias("xid"), (p * 3571 % 10007).cast("double").alias("x"), (p * 6547 % 10009).cast("double").alias("y"), F.col("p_name").alias("name"), F.col("p_type").alias("cls"), F.coalesce("cnt", F.lit(0)).alias("cnt"))

    def locations(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.read("supplier").select(s.alias("lid"), (s * 4871 % 10007).cast("double").alias("px"), (s * 6547 % 10009).cast("double").alias("py"))

    def baseline_points(self) -> DataFrame:
        """Sample points inside the boundary."""
        c = F.col("c_custkey")
        return self.read("customer").select(c.alias("bid"), (c * 5417 % 10007).cast("double").alias("px"), (c * 2221 % 10009).cast("double").alias("py")).where(spatial.is_inside(F.col("px"), F.col("py"), BOUNDARY))

    def ring_vertices(self) -> DataFrame:
        """(ring, seq, x, y): the boundary as ring 0, and a ring of eight vertices for each supplier; those inside
        are holes, those outside are islands, and where two of them overlap is inside again or not."""
        outer = self.spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate(BOUNDARY)], "ring long, seq long, x double, y double")
        s, k = F.col("s_suppkey"), F.col("k")
        size, far = 60 + s * 37 % 240, F.when(k % 2 == 0, 2).otherwise(1)
        east = F.when(k.isin(0, 1, 7), 1).when(k.isin(3, 4, 5), -1).otherwise(0)
        north = F.when(k.isin(1, 2, 3), 1).when(k.isin(5, 6, 7), -1).otherwise(0)
        rows = self.read("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
        x, y = s * 4871 % 10007 + east * size * far, s * 6547 % 10009 + north * size * far
        return outer.unionByName(rows.select((s + 1).alias("ring"), k.alias("seq"), x.cast("double").alias("x"), y.cast("double").alias("y")))

    def nodes(self) -> DataFrame:
        """A lattice SIDE nodes wide that grows north with the customers."""
        i = F.col("c_custkey")
        return self.read("customer").select(i.alias("node"), (i % SIDE * SPACING).alias("x"), (F.floor(i / SIDE) * SPACING).alias("y"))

    def edges(self) -> DataFrame:
        """Directed; some eastward roads are one-way."""
        n = self.read("customer")
        i = F.col("c_custkey")
        east = n.where(i % SIDE < SIDE - 1).select(i.alias("a"), (i + 1).alias("b"), (200 + i * 7919 % 101).cast("double").alias("len_m"), (i % 5 != 0).alias("both"), F.when(i % 23 == 7, "motorway").otherwise("street").alias("kind"))
        north = n.select(i.alias("a"), (i + SIDE).alias("b"), (200 + i * 104729 % 103).cast("double").alias("len_m"), F.lit(True).alias("both"), F.when(i % 29 == 3, "elevated").otherwise("street").alias("kind"))
        roads = east.unionByName(north).join(n.select(i.alias("b")), "b", "left_semi")
        one = roads.select(F.col("a").alias("src"), F.col("b").alias("dst"), "len_m", "kind")
        return one.unionByName(roads.where("both").select(F.col("b").alias("src"), F.col("a").alias("dst"), "len_m", "kind"))

    def ride_edges(self) -> DataFrame:
        """Edges that rides may use."""
        return self.edges().where(~F.col("kind").isin(*DEFAULT.no_rides))

    def segments(self, ride: bool = False) -> DataFrame:
        """Roads once, at their midpoints."""
        e = (self.ride_edges() if ride else self.edges()).where("src < dst")
        mid = lambda c: (c(F.col("src")) + c(F.col("dst"))) / 2
        x, y = lambda i: i % SIDE * SPACING, lambda i: F.floor(i / SIDE) * SPACING
        return e.select("len_m", mid(x).alias("x"), mid(y).alias("y"))

    def polylines(self) -> DataFrame:
        """A candidate route of seven vertices for each supplier, in pairs."""
        r, k = F.col("rid"), F.col("seq")
        rows = self.read("supplier").select(F.col("s_suppkey").alias("rid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("seq"))
        return rows.select("rid", "seq", (r * 431 % 5000 + k * (170 + r % 7 * 40)).cast("double").alias("x"), (r * 977 % 6000 + k * k * (20 + r % 3 * 9)).cast("double").alias("y"))

    def trips(self) -> DataFrame:
        """Start and end points of a trip for each supplier, near two nodes of the network up to 40 rows
        apart; some are far from any road, some share their node."""
        q = F.col("qid")
        size = self.read("customer").agg(F.count("*").alias("size"))
        rows = self.read("supplier").select(F.col("s_suppkey").alias("qid")).join(F.broadcast(size), how="cross")  # one row
        rows = rows.withColumn("a", q * 1637 % F.col("size")).withColumn("b", F.when(q % 8 == 5, F.col("a")).otherwise((F.col("a") + q * 3943 % 1700) % F.col("size")))
        at = lambda n, dx, dy: ((F.col(n) % SIDE * SPACING + dx).cast("double"), (F.floor(F.col(n) / SIDE) * SPACING + dy).cast("double"))
        (fx, fy), (tx, ty) = at("a", 30, -20), at("b", -25, 40)
        return rows.select("qid", F.when(q % 8 == 6, -900.0).otherwise(fx).alias("fx"), fy.alias("fy"), F.when(q % 8 == 7, 12000.0).otherwise(tx).alias("tx"), ty.alias("ty"))

    def requests(self) -> DataFrame:
        """(qid, mode, px, py, fx, fy, tx, ty): a request for each trip, walks at the supplier's location and
        routes; some have no known mode, some lack a coordinate."""
        q = F.col("qid")
        mode = F.when(q % 16 == 3, "fly").when(q % 4 == 1, "walk").otherwise("route")
        at = self.locations().withColumnRenamed("lid", "qid")
        rows = self.trips().join(at, "qid").withColumn("mode", mode)
        return rows.select("qid", "mode", F.when(q % 24 != 9, F.col("px")).alias("px"), "py", "fx", "fy", F.when(q % 16 != 4, F.col("tx")).alias("tx"), "ty")

    def places(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.read("part").select(p.alias("pid"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), (p * 3571 % 10007).cast("double").alias("x"), (p * 6547 % 10009).cast("double").alias("y"))

    def place_queries(self) -> DataFrame:
        rows = [(0, "widget Brand#1", 100.0, 200.0), (1, "small bolt", 5000.0, 5000.0), (2, "ＢＯＬＴ　Brand#２３", 9000.0, 10.0), (3, "gi", 1.0, 1.0), (4, "臺北", 0.0, 0.0), (5, "ｓｍａｌｌ 二十三號", 0.0, 0.0), (6, "一百零五巷 三百十二弄 十樓", 0.0, 0.0)]
        return self.spark.createDataFrame(rows, "qid long, q string, qx double, qy double")
