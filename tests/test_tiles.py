"""Sums over discs by tiles against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardgrid.operators import tiles


def made(spark, seed, whole, n=3000, m=60):
    rng = np.random.default_rng(seed)
    place = (lambda k: rng.integers(-900, 2100, (k, 2)).astype(float)) if whole else (lambda k: rng.uniform(-900, 2100, (k, 2)))
    p, d = place(n), place(m)
    v = rng.integers(0, 40, n)
    keys = rng.integers(0, 20, m)
    points = spark.createDataFrame([*((float(x), float(y), int(w)) for (x, y), w in zip(p, v, strict=True)), (None, 1.0, 5)], "x double, y double, w int")
    discs = spark.createDataFrame([*((int(k), float(x), float(y)) for k, (x, y) in zip(keys, d, strict=True)), (99, None, 0.0), (98, 1e6, 0.0)], "k long, px double, py double")
    d2 = ((d[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
    return points, discs, v, keys, d2


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("radius", [40.0, 300.0])
def test_disc_sums(spark, whole, radius, monkeypatch):
    points, discs, v, keys, d2 = made(spark, 5, whole)
    monkeypatch.setattr(tiles, "TASK_NUMBERS", 2000)  # several blocks of points and of discs
    monkeypatch.setattr(tiles, "TASK_DISCS", 20)
    inside = d2 <= radius**2
    got = {r.k: r for r in tiles.disc_sums(discs, "k", points, radius, {"w": F.col("w")}, F.col("w")).collect()}
    once = {r.k: r for r in tiles.disc_sums(discs, "k", points, radius, {"w": F.col("w")}, once=True).collect()}
    assert set(got) == set(once) == {k for k in keys.tolist() if inside[keys == k].any()}
    for k, r in got.items():
        own = inside[keys == k]
        assert (r.n, r.w) == (own.sum(), (own * v).sum())
        assert r.wsum == pytest.approx((own * v * (1 - d2[keys == k] / radius**2)).sum(), abs=1e-9)
        assert (once[k].n, once[k].w) == (own.any(axis=0).sum(), v[own.any(axis=0)].sum())


def test_a_session_of_tables_builds_no_large_table_on_the_driver(spark):
    """Exploded cells are many times what the planner takes them for; it must not broadcast them."""
    from hazardgrid.plans import reports, surrogate

    t = surrogate.Tables(spark, "/root/testdata/sf0.1")
    plan = reports.ride_samples(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == plan.count("BroadcastExchange") == 2  # the tiles of points and discs


#: Findings of large tables built on the driver, with the parts of the queries that hold the step.
SHUFFLED = {
    "F1 stars, F15 percentile_score, F18 shrunk_risk": lambda R, t: R.scored(t),
    "F3 ride_strata": lambda R, t: R.ride_samples(t),
    "F10 band_median, F12 dataset_meta, F19 strata": lambda R, t: R.walk_samples(t, t.baseline_points()),
    "F16 route_accidents": lambda R, t: R.route_accidents(t, R.given_routes(t)),
    "F20 walk_documents": lambda R, t: R.walk_documents(t),
}


@pytest.mark.parametrize("finding", sorted(SHUFFLED))
def test_what_is_built_on_the_driver_is_summed_up_before(spark, finding):
    """A side that is broadcast holds no exploded rows unless they were grouped: else it outgrows its file."""
    from hazardgrid.plans import reports, surrogate

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    plan = SHUFFLED[finding](reports, surrogate.Tables(spark, "/root/testdata/sf0.01"))._jdf.queryExecution().sparkPlan()

    def children(node):
        below = node.children()
        return [below.apply(i) for i in range(below.size())]

    def rows_exploded(node):
        name = node.nodeName()
        return name == "Generate" or ("Aggregate" not in name and "Groups" not in name and any(map(rows_exploded, children(node))))

    def check(node):
        if node.nodeName() == "BroadcastHashJoin":
            built = children(node)[0 if node.buildSide().toString() == "BuildLeft" else 1]
            assert not rows_exploded(built), built.toString()
        for c in children(node):
            check(c)

    check(plan)


def test_disc_leaders(spark, monkeypatch):
    points, discs, v, keys, d2 = made(spark, 7, True)
    monkeypatch.setattr(tiles, "TASK_NUMBERS", 2000)
    monkeypatch.setattr(tiles, "CHUNK", 1024)
    discs = discs.where("k < 90").select(F.monotonically_increasing_id().alias("k"), "px", "py").localCheckpoint()
    points = points.where("x is not null").select(F.monotonically_increasing_id().alias("id"), "x", "y", "w").localCheckpoint()
    rows, asked = points.collect(), discs.collect()
    got = {}
    for r in tiles.disc_leaders(discs, "k", points, "id", 300.0, F.col("w"), 5).collect():
        got.setdefault(r.k, []).append((r.id, r.d2))
    weight = {r.id: r.w for r in rows}
    for a in asked:
        near = [(r.id, (a.px - r.x) ** 2 + (a.py - r.y) ** 2) for r in rows]
        near = sorted((x for x in near if x[1] <= 90000), key=lambda x: (-weight[x[0]], x[0]))[:5]
        assert sorted(got.get(a.k, []), key=lambda x: (-weight[x[0]], x[0]))[:5] == near


def test_a_computed_text_is_computed_once(spark):
    from hazardgrid.functions.scalar import normalise_name, trigrams

    rows = spark.range(1).select(F.concat(F.lit("Ａ"), F.col("id").cast("string"), F.lit("bcd")).alias("name"))
    found = rows.select(trigrams(normalise_name(F.col("name"))).alias("g"))
    assert found.first().g == ["a0b", "0bc", "bcd"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(trim(") == 1


def test_rings_in_crowded_rows(spark, monkeypatch):
    """Blocks of points and edges add up; points on corners and edges are as in plain ray casting."""
    from hazardgrid.operators import boundary

    rng = np.random.default_rng(3)
    p = rng.integers(0, 120, (4000, 2)).astype(float)
    corners = rng.integers(0, 120, (150, 3, 2)).astype(float)
    edges = [(*t[k], *t[(k + 1) % 3]) for t in corners.tolist() for k in range(3)]
    for name, most in (("TASK_POINTS", 700), ("TASK_EDGES", 60), ("TESTS", 500)):
        monkeypatch.setattr(boundary, name, most)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "k long, px double, py double")
    got = {r.k: r.inside for r in boundary.inside_rings(points, "k", spark.createDataFrame([tuple(map(float, e)) for e in edges], "ax double, ay double, bx double, by double"), 50.0).collect()}
    for i, (x, y) in enumerate(p):
        assert got[i] == (sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in edges) % 2 == 1)


def test_nearest_disc_and_first_met(spark):
    """Against plain versions: places in crowds and far from any, equal places and equal distances."""
    r = np.random.default_rng(7)
    for blocks in (60_000, 25):
        old, tiles.TASK_DISCS = tiles.TASK_DISCS, blocks
        try:
            x, y = (np.concatenate([r.integers(0, 900, 300), r.integers(200, 230, 200)]).astype(float) for _ in range(2))
            px, py = (np.concatenate([r.integers(0, 900, 120), r.integers(205, 215, 80), [5000]]).astype(float) for _ in range(2))
            points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "aid long, x double, y double")
            discs = spark.createDataFrame([(i, i // 9, i % 9, float(a), float(b)) for i, (a, b) in enumerate(zip(px, py, strict=True))], "lid long, rid long, pos long, px double, py double")
            d2 = (x[:, None] - px) ** 2 + (y[:, None] - py) ** 2
            for radius in (15.0, 100.0):
                got = {t.aid: (t.d2, t.lid) for t in tiles.nearest_disc(discs, "lid", points, "aid", radius).collect()}
                assert got == {i: (row.min(), int(row.argmin())) for i, row in enumerate(d2) if row.min() <= radius * radius}
                want = {}
                for i, j in np.argwhere(d2 <= radius * radius).tolist():
                    want[j // 9, i] = min(want.get((j // 9, i), 9), j % 9)
                rows = [tuple(t) for t in tiles.first_met(discs, "rid", "pos", points, "aid", radius).collect()]
                assert len(rows) == len(want) and {(k, i): f for k, i, f in rows} == want
                led = {tuple(t) for t in tiles.first_met(discs, "rid", "pos", points, "aid", radius, F.col("aid") % 5, 3).collect()}
                assert led <= set(rows)
                for k in {k for k, _ in want}:
                    best = sorted((t for t in rows if t[0] == k), key=lambda t: (-(t[1] % 5), t[2], t[1]))[:3]
                    assert set(best) <= led
        finally:
            tiles.TASK_DISCS = old


def test_pairs_leave_their_tasks_ranked(spark, monkeypatch):
    """F3 route_crossings: every pair of a route and a crossing, ranked, in several blocks and batches; no pair is shuffled."""
    from hazardgrid.plans import reports as R
    from hazardgrid.plans import surrogate as sur

    r = np.random.default_rng(11)
    for name, value in (("BLOCK_KEYS", 2), ("BATCH", 7), ("HOME", 300.0), ("DEAL", 60.0)):
        monkeypatch.setattr(tiles, name, value)
    x, y, cnt = r.integers(-200, 700, 400), r.integers(-200, 300, 400), r.integers(0, 4, 400)
    px, py = np.cumsum(r.integers(-30, 40, (9, 20)), axis=1) + r.integers(0, 300, (9, 1)), np.cumsum(r.integers(-30, 40, (9, 20)), axis=1)
    points = [(i, float(x[i]), float(y[i]), int(cnt[i]), f"n{i}" if i % 5 else None) for i in range(400)] + [(900, None, 1.0, 5, "a"), (901, float("nan"), 1.0, 5, "b")]
    discs = [(k, p, float(px[k, p]), float(py[k, p]), k + 3) for k in range(9) for p in range(20)] + [(9, 0, None, None, 1), (10, 0, 1e6, 1e6, 1)]
    got = tiles.all_met(spark.createDataFrame(discs, "rid int, pos long, px double, py double, few long"), "rid", "pos", spark.createDataFrame(points, "xid long, x double, y double, cnt long, name string"), "xid", 45.0, "cnt", ["name"], "few")
    want = []
    for k in range(9):
        hit = (px[k][:, None] - x) ** 2 + (py[k][:, None] - y) ** 2 <= 45.0**2
        met = sorted((-cnt[i], int(hit[:, i].argmax()), i) for i in np.flatnonzero(hit.any(axis=0)).tolist())
        want += [(k, k + 3, i, int(-c), points[i][4], first, rn) for rn, (c, first, i) in enumerate(met, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    t = sur.Tables(spark, "/root/testdata/sf0.001")
    plan = R.route_crossings(t, R.given_routes(t))._jdf.queryExecution().sparkPlan()
    while plan.nodeName() != "MapInArrow":
        assert plan.nodeName() in ("Project", "Filter"), plan.nodeName()
        plan = plan.children().apply(0)


def test_crossings_shown_and_counted_as_ranked(spark):
    """What reports count and documents show are those of all crossings along the routes, ranked."""
    from hazardgrid.plans import reports as R
    from hazardgrid.plans import surrogate as sur

    t = sur.Tables(spark, "/root/testdata/sf0.001")
    r = R.given_routes(t)
    ranked = R.route_crossings(t, r)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.shown_crossings(t, r)) == rows(ranked.where("shown"))
    counted = ranked.groupBy("rid").agg(F.count_if("high"), F.count("*"), F.count_if("shown"))
    assert rows(R.crossing_numbers(t, r)) == rows(counted) != []
