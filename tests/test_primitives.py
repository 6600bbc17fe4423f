from datetime import date

import pytest
from pyspark.sql import functions as F

from hazardgrid.errors import AnalysisError, validate_geocode, validate_radius, validate_request
from hazardgrid.functions import scalar as S
from hazardgrid.operators.splits import split_by_date


def column(spark, values, expression, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_date_split(spark):
    rows = spark.createDataFrame([(date(2025, 12, 31), "past"), (date(2026, 1, 1), "cutoff"), (date(2026, 1, 2), "future"), (None, "none")], "occurred_on date, id string")
    train, test = split_by_date(rows, date(2026, 1, 1))
    assert [r.id for r in train.collect()] == ["past"]
    assert [r.id for r in test.collect()] == ["cutoff", "future"]


def test_kernel(spark):
    assert column(spark, [500.0, 600.0, 0.0], lambda d: S.kernel(d, 500.0)) == [0.0, 0.0, 1.0]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            S.kernel(F.lit(1.0), bad)
        with pytest.raises(ValueError):
            S.kernel_squared(F.lit(1.0), bad)


def test_severity(spark):
    assert column(spark, [2], lambda n: S.severity(n, 20.0), "int") == [41.0]


def test_stars_and_scores(spark):
    assert column(spark, [-5.0, 5.0, 15.0, 72.5, 100.0, 130.0], S.star) == [0.5, 0.5, 1.0, 3.5, 5.0, 5.0]
    assert column(spark, [-3.0, 0.5, 1.5, 2.5, 99.5, 140.0], S.clamp_score) == [0, 0, 2, 2, 100, 100]
    assert column(spark, [11, 12, 29, 30], S.confidence, "int") == ["low", "mid", "mid", "high"]
    assert column(spark, [59, 60, 74, 75], S.tone, "int") == ["bad", "mid", "mid", "ok"]


def test_hours(spark):
    hours = [5, 6, 7, 9, 10, 17, 18, 20, 21]
    assert column(spark, hours, S.is_peak, "int") == [False, False, True, True, False, True, True, True, False]
    assert column(spark, hours, S.is_night, "int") == [True, False, False, False, False, False, True, True, True]


def test_mentions(spark):
    assert column(spark, [None, "", "a truck", "bus"], lambda p: S.mentions(p, "truck", "bus"), "string") == [False, False, True, True]


def test_texts(spark):
    assert column(spark, [0, 1, 2], S.route_label, "int") == ["shortest", "alternative A", "alternative B"]
    assert column(spark, ["臺北１２", " Ａb ", "三民"], S.normalise_name, "string") == ["台北12", "ab", "3民"]
    assert column(spark, ["二十三號", "十樓", "十五", "三十", "一百零五", "三百十二", "二百五十", "六百", "ａＢ"], S.normalise_name, "string") == ["23號", "10樓", "15", "30", "105", "312", "250", "600", "ab"]
    assert column(spark, ["abcd", "ab", ""], S.trigrams, "string") == [["abc", "bcd"], ["ab"], []]


def test_jitter_is_fixed_and_bounded(spark):
    dx, dy = S.jitter(F.col("id"), 25.0)
    rows = spark.range(500).select(dx.alias("dx"), dy.alias("dy"))
    first, second = rows.collect(), rows.collect()
    assert first == second
    assert all(abs(r.dx) <= 25 and abs(r.dy) <= 25 for r in first)
    assert len({r.dx for r in first}) > 490


def test_projection_round_trip(spark):
    x, y = S.project(F.lit(24.99), F.lit(121.3), 24.95, 121.25)
    lat, lon = S.unproject(x, y, 24.95, 121.25)
    row = spark.range(1).select(x, y, lat.alias("lat"), lon.alias("lon")).first()
    assert abs(row.lat - 24.99) < 1e-9 and abs(row.lon - 121.3) < 1e-9
    assert 4000 < row[0] < 6000 and 4000 < row[1] < 5000


def test_requests():
    assert validate_request({"mode": "walk", "lat": 1.0, "lon": 2.0})["mode"] == "walk"
    for request, status in (({"mode": "fly"}, 422), ({"mode": "walk", "lat": 1.0}, 400), ({"mode": "route", "from": [1.0]}, 422), ({"mode": "route", "from": [1.0, 2.0]}, 400), ({"mode": "walk", "lat": 1, "lon": 2, "vehicle": "car"}, 422)):
        with pytest.raises(AnalysisError) as e:
            validate_request(request)
        assert e.value.status == status and e.value.body()["error"]["code"] == "DATA_UNAVAILABLE"
    with pytest.raises(AnalysisError):
        validate_geocode("", 8)
    with pytest.raises(AnalysisError):
        validate_geocode("a", 21)
    with pytest.raises(AnalysisError):
        validate_radius(4)


def test_first_error_of_each_row(spark):
    from hazardgrid.errors import first_error

    rows = spark.createDataFrame([(0, "walk", 1.0), (1, "walk", None), (2, None, None), (3, "fly", None)], "id long, mode string, px double")
    error = first_error({"walk_point": (F.col("mode") == "walk") & F.col("px").isNull(), "mode": F.col("mode").isNull() | (F.col("mode") == "fly"), "walk_outside": F.col("px") > 5})
    got = {r.id: r.e for r in rows.select("id", error.alias("e")).collect()}
    assert got[0] is None and got[1].message == "walk needs lat and lon" and got[1].status == 400
    assert got[2] == got[3] and got[2].status == 422
    with pytest.raises(ValueError):
        first_error({"other": F.lit(True)})
