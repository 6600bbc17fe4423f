import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from hazardgrid.errors import AnalysisError
from hazardgrid.operators import baseline, crossings, measures, overlay, paths, ranks, spatial
from hazardgrid.sources.index import Index, write_index
from hazardgrid.sources.police_csv import read_police_csv
from hazardgrid.sources.sinks import write_json_documents
from hazardgrid.streaming.trend import monthly_counts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grid_join_equals_plain_join(spark, seed):
    r = random.Random(seed)
    a = [(i, r.choice([r.uniform(-900, 900), 500.0, 0.0]), r.uniform(-900, 900)) for i in range(60)]
    b = [(i, r.choice([r.uniform(-900, 900), 0.0]), r.choice([r.uniform(-900, 900), 0.0])) for i in range(200)]
    probe = spark.createDataFrame(a, "lid int, px double, py double")
    points = spark.createDataFrame(b, "aid int, x double, y double")
    got = {(t.lid, t.aid) for t in spatial.radius_join(probe, points, 500.0).collect()}
    assert got == {(i, j) for i, px, py in a for j, x, y in b if (px - x) ** 2 + (py - y) ** 2 <= 250000}


def test_closed_ball(spark):
    probe = spark.createDataFrame([(1, 0.0, 0.0)], "lid int, px double, py double")
    points = spark.createDataFrame([(1, 500.0, 0.0), (2, 500.01, 0.0)], "aid int, x double, y double")
    assert [t.aid for t in spatial.radius_join(probe, points, 500.0).collect()] == [1]


def test_hot_uses_the_rounded_distance(spark):
    rows = spark.createDataFrame([(300.44, 15), (300.5, 15), (300.51, 15), (10.0, 14)], "d double, cnt int")
    got = [t[0] for t in rows.select(crossings.is_hot(F.bround("d").cast("int"), F.col("cnt"))).collect()]
    assert got == [True, True, False, False]


def test_share_fallback(spark):
    acc = spark.createDataFrame([(h,) for h in [3] * 10 + [12] * 30], "hour int")
    own = spark.createDataFrame([(1, 7, 1.0, 0.0), (2, 8, 1.0, 0.0), (3, None, None, None)], "k int, n_hours int, night double, peak double")
    got = {t.k: t.night for t in measures.with_fallback(own, acc).collect()}
    assert got == {1: 0.25, 2: 1.0, 3: 0.25}


def test_trend_drops_months_outside(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    hits = spark.createDataFrame([(1, -1), (1, 0), (1, 0), (1, 23), (1, 24)], "k int, mi int")
    got = {(t.k, t.ym): t.n for t in measures.monthly_trend(keys, hits, "k", 24, "2024-07-01").collect()}
    assert len(got) == 48 and got[(1, "2024-07")] == 2 and got[(1, "2026-06")] == 1 and sum(got.values()) == 3


def test_percentile_score_counts_strictly_more_dangerous(spark):
    base = spark.createDataFrame([(0, float(v)) for v in (1, 2, 2, 3)] + [(1, 9.0)], "band int, risk double")
    values = spark.createDataFrame([(1, 0, 2.0), (2, 0, 0.5), (3, 0, 3.0), (4, 1, 1.0)], "lid long, band int, shrunk double")
    got = {t.lid: t.score for t in measures.percentile_score(values, "lid", base).collect()}
    assert got == {1: 25, 2: 100, 3: 0, 4: 100}


def test_exact_percentiles(spark):
    """Against Spark's own, with ties, nulls, a band of one value and one of nulls alone."""
    r = random.Random(4)
    rows = [(0, r.random()) for _ in range(900)] + [(1, float(r.randrange(6))) for _ in range(400)] + [(2, 7.5), (3, None), (1, None)]
    rows += [(4, 1.0), (4, 2.0)]
    frame = spark.createDataFrame(rows, "band int, v double")
    shares = [0.0, 0.1, 0.125, 0.5, 0.77, 1.0]
    want = {t.band: t.p for t in frame.groupBy("band").agg(F.percentile("v", shares).alias("p")).collect() if t.p is not None}
    got = {t.band: t.p for t in ranks.percentiles(frame, shares).collect()}
    assert set(got) == set(want) == {0, 1, 2, 4}
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert ranks.percentiles(frame.limit(0), shares).count() == 0


def test_ranks_in_ranges(spark):
    """Counts against a plain sort: skewed values, negative ones, many ranges, any partitioning."""
    r = random.Random(9)
    rows = [(0, r.choice([-1.0, 1.0]) * r.random() ** 9) for _ in range(3000)] + [(0, 0.5)] * 2000 + [(1, float(r.randrange(40))) for _ in range(500)]
    frame = spark.createDataFrame(rows, "band int, v double")
    for parts in (1, 7):
        got = {(t.band, t.v): (t.n, t.upto, t.total) for t in ranks.ranked(ranks.histogram(frame.repartition(parts))).collect()}
        for band in (0, 1):
            own = sorted(v for b, v in rows if b == band)
            assert {v for b, v in got if b == band} == set(own)
            assert all(got[band, v] == (own.count(v), bisect.bisect_right(own, v), len(own)) for v in set(own))
    cuts = F.array(*[F.lit(x) for x in (1.0, 2.0, 2.5, 7.0)])
    probes = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.5, 6.0, 7.0, 9.0)], "v double")
    assert [t[0] for t in probes.select(ranks.range_of(cuts, F.col("v"))).collect()] == [0, 1, 1, 3, 3, 4, 4]


def test_defining_scores_runs_no_job(spark):
    base = spark.createDataFrame([(k, float(k % 7), float(k)) for k in range(50)], "id long, km double, risk double")
    acc = spark.createDataFrame([(3,), (12,)], "hour int")
    spark.sparkContext.setJobGroup("definition", "scores")
    try:
        banded = measures.strata(base, 4, 0.0)
        values = measures.with_band(base.withColumnRenamed("risk", "shrunk"), "km", banded)
        rows = measures.percentile_score(values, "id", banded)
        measures.band_median(banded)
        measures.with_fallback(base.selectExpr("id", "0L n_hours", "risk night", "risk peak"), acc)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("definition")
    finally:
        spark.sparkContext.setJobGroup("rest", "")
    assert rows.where("score between 0 and 100").count() == 50


def test_snap_and_ties(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 10.0, 0.0)], "node long, x double, y double")
    probe = spark.createDataFrame([(1, 9.0, 0.0), (2, 5000.0, 0.0)], "lid int, px double, py double")
    got = {t.lid: t.node for t in spatial.nearest(probe, "lid", nodes, "node", 400.0).collect()}
    assert got == {1: 2, 2: -1}


def test_accidents_get_the_nearest_crossing(spark):
    xs = spark.createDataFrame([(7, 10.0, 0.0), (3, -10.0, 0.0), (9, 200.0, 0.0)], "xid long, x double, y double")
    acc = spark.createDataFrame([(1, 0.0, 0.0), (2, 150.0, 0.0), (3, 900.0, 0.0), (4, 110.0, 0.0)], "aid long, x double, y double")
    got = {t.aid: (t.xid, t.dist) for t in crossings.assign(acc, xs, 100.0).collect()}
    assert got == {1: (3, 10.0), 2: (9, 50.0), 3: (None, None), 4: (9, 90.0)}


def test_sampled_line(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 50.0, 0.0), (1, 2, 50.0, 20.0)], "rid int, seq int, x double, y double")
    got = [(t.pos, t.px, t.py) for t in spatial.sample_line(line, "rid", 20.0).orderBy("pos").collect()]
    assert got == [(0, 0.0, 0.0), (1, 20.0, 0.0), (2, 40.0, 0.0), (3, 50.0, 0.0), (4, 50.0, 20.0)]


def network(spark, side, seed, spread=100.0):
    """A crooked lattice with one-way and diagonal roads and lengths that often tie."""
    r = random.Random(seed)
    nodes = [(i, i % side * spread + r.random(), i // side * spread + r.random()) for i in range(side * side)]
    edges = [(i, j, float(r.randint(1, 4) * 60)) for i in range(side * side) for j in (i + 1, i - 1, i + side, i - side, i + side + 1) if 0 <= j < side * side and abs(i % side - j % side) < 2 and r.random() < 0.8]
    edges += [(edges[0][0], edges[0][1], 999.0), (3, 3, 1.0), (5, 10_000, 1.0)]  # parallel, a loop, an unknown end
    return spark.createDataFrame(nodes, "node long, x double, y double"), spark.createDataFrame(edges, "src long, dst long, len_m double")


def plain_path(edges, src, dst, limit):
    """(found, length, nodes) by trying all roads again and again; walked back to the nearest, then smallest."""
    best = {src: 0.0}
    while True:
        better = {}
        for a, b, w in edges:
            if a in best and best[a] + w < min(best.get(b, 1e18), better.get(b, 1e18)) and best[a] + w <= limit:
                better[b] = best[a] + w
        if not better:
            break
        best |= better
    if dst not in best:
        return False, None, None
    nodes = [dst]
    while nodes[-1] != src:
        nodes.append(min((best[a], a) for a, b, w in edges if b == nodes[-1] and a in best and best[a] + w == best[b] and a != b)[1])
    return True, best[dst], nodes[::-1]


def test_overlay_paths_equal_plain_paths(spark, monkeypatch):
    """Lengths and, with ties, nodes; cells and blocks of trips are small, half of the trips start at one node."""
    monkeypatch.setattr(overlay, "BLOCK_TRIPS", 3)
    nodes, edges = network(spark, 9, 5)
    r = random.Random(1)
    asked = [(i, r.choice([40, r.randrange(81)]), r.randrange(81)) for i in range(40)] + [(100, 7, 7), (101, 8, 10_001), (102, 77, 78)]
    queries = spark.createDataFrame(asked, "qid long, src long, dst long")
    over = overlay.build(nodes, edges, 800.0, most=16)
    assert over.cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 16 and over.cells.select("cell").distinct().count() > 5
    got = {t.qid: (t.found, t.length_m, t.nodes) for t in overlay.shortest_paths(queries, over).collect()}
    known = [tuple(e) for e in edges.where("dst < 81").collect()]
    want = {q: plain_path(known, a, b, 800.0) if b < 81 else (False, None, None) for q, a, b in asked}
    assert got == want and 15 < sum(f for f, _, _ in got.values()) < 40


def test_jumps_leave_a_cell_once_a_trip_and_entry(spark, monkeypatch):
    """Labels that one cell's jumps make: of each trip and entry the best only, of equal ones the nearer, then the
    smaller last node; as joined rows and their minimum. Ways out beyond the way inside the first cell are no labels."""
    r = random.Random(4)
    side = 9
    nodes = spark.createDataFrame([(k, 100.0 * (k % side), 100.0 * (k // side)) for k in range(side * side)], "node long, x double, y double")
    roads = [(k, k + o, float(r.choice([100, 110, 120]))) for k in range(side * side) for o, ok in ((1, k % side < side - 1), (side, k < side * (side - 1))) if ok]
    edges = spark.createDataFrame(roads + [(b, a, w) for a, b, w in roads], "src long, dst long, len_m double")
    over = overlay.build(nodes, edges, 900.0, most=20)
    jumps = over.jumps.collect()
    entries = {(j.at, j.src) for j in jumps}
    asked = [(q, at, v, float(r.choice([0, 100, 110])), 400.0, 300.0, 700.0) for q in range(6) for at, v in sorted(entries) if r.random() < 0.7]
    want = {}
    for q, at, v, d, bx, by, most in asked:
        for j in jumps:
            if (j.at, j.src) == (at, v) and d + j.len_m + over.pace * math.hypot(j.x - bx, j.y - by) * (1 - 1e-9) <= most * (1 + 1e-12):
                key, way = (at, q, j.node, j.cell), (d + j.len_m, d + j.via_m, j.via)
                want[key] = min(want.get(key, way), way)
    rows = spark.createDataFrame(asked, "qid long, cell long, node long, so_far double, b_x double, b_y double, most double")
    got = overlay._jumped(over, rows).collect()
    assert sorted((x.qid, x.node, x.cell, *x.s) for x in got) == sorted((q, v, c, *s) for (_, q, v, c), s in want.items())
    monkeypatch.setattr(overlay, "AT_ONCE", 7)  # a trip in several parts: the same minimum
    least = {}
    for x in overlay._jumped(over, rows).collect():
        least[x.qid, x.node, x.cell] = min(least.get((x.qid, x.node, x.cell), tuple(x.s)), tuple(x.s))
    assert least == {k[1:]: min(s for o, s in want.items() if o[1:] == k[1:]) for k in want}
    cell = {x.node: x.cell for x in over.cells.collect()}
    trips = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in cell for b in cell if a < b and cell[a] == cell[b])]
    found = overlay.search(over, spark.createDataFrame(trips, "qid long, src long, dst long"))
    length = {x.qid: x.length_m for x in found.trips.collect()}
    assert len(length) == len(trips) and all(x.s.d <= length[x.qid] + 200 for x in found.labels.collect())


def test_overlay_of_one_cell_or_no_roads(spark):
    nodes, edges = network(spark, 4, 2)
    asked = [(1, 0, 15), (2, 15, 0), (3, 4, 4)]
    queries = spark.createDataFrame(asked, "qid long, src long, dst long")
    known = [tuple(e) for e in edges.where("dst < 16").collect()]
    assert {t.qid: (t.found, t.length_m, t.nodes) for t in overlay.shortest_paths(queries, overlay.build(nodes, edges, 1e9)).collect()} == {q: plain_path(known, a, b, 1e9) for q, a, b in asked}
    none = overlay.build(nodes, edges.limit(0), 1e9)
    assert [(t.qid, t.length_m) for t in overlay.search(none, queries).trips.collect()] == [(3, 0.0)]
    assert overlay.search(none, queries.limit(0)).trips.isEmpty()
    with pytest.raises(ValueError):
        overlay.build(nodes, edges.withColumn("len_m", F.lit(0.0)), 1e9)


def test_quadtree_cells_bound_crowds(spark):
    """Half of all points in one small square: its cells are small ones, the others large."""
    r = random.Random(4)
    rows = [(i, r.random() * 400 - 100, r.random() * 400) for i in range(400)] + [(1000 + i, r.random() * 1e6 - 5e5, r.random() * 1e6) for i in range(400)]
    points = spark.createDataFrame(rows, "node long, x double, y double")
    got = overlay.quad_cells(points, 40)
    sizes = [c["count"] for c in got.groupBy("cell").count().collect()]
    assert got.count() == 800 and max(sizes) <= 40 and len(sizes) < 120


def test_relaxation_has_no_round_limit(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "src long, dst long, len_m double")
    row = paths.relaxed_lengths(spark.createDataFrame([(0, 0, 6)], "qid long, src long, dst long"), chain, 100.0).first()
    assert row.found and row.length_m == 6 and row.nodes == list(range(7))


def test_boundary(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, -1.0, 11.0)], "k int, px double, py double")
    assert {t.k: t.inside for t in spatial.inside(p, "k", square).collect()} == {1: True, 2: False, 3: False}


def test_police_csv(spark, tmp_path):
    text = "year,case,party,city\n2025,7,1,A\n2025,7,2,A\n2025,8,1,B\nnote: provisional\nnote: two,kinds\n"
    for name in ("a1.csv", "a2.csv"):
        (tmp_path / name).write_text(text)
    columns = [("year", "int"), ("case", "int"), ("party", "int"), ("city", "string")]
    rows = read_police_csv(spark, str(tmp_path), columns, "year", party="party")
    assert sorted((t.case, t.city) for t in rows.collect()) == [(7, "A"), (7, "A"), (8, "B"), (8, "B")]
    assert read_police_csv(spark, str(tmp_path), columns, "year", "party", ("city", "B")).count() == 2


def test_index(spark, tmp_path):
    one = spark.createDataFrame([(1, 0.0, 0.0)], "aid long, x double, y double")
    tables = dict.fromkeys(("accidents", "crossings", "nodes", "edges"), one)
    write_index(tables, str(tmp_path / "i"))
    with pytest.raises(RuntimeError):
        Index(spark, str(tmp_path / "i"))
    write_index(tables | {"baseline": one}, str(tmp_path / "i"))
    index = Index(spark, str(tmp_path / "i"))
    assert index.accidents.count() == 1
    with pytest.raises(AnalysisError) as e:
        index.places  # noqa: B018
    assert e.value.status == 503
    write_json_documents(one, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_stream(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz '2024-01-02 03:00:00' ts, 1 fat union all select timestamp_ntz '2024-01-02 05:00:00', 0 union all select timestamp_ntz '2024-03-01 00:00:00', 2")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = monthly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("trend").start()
    query.processAllAvailable()
    query.stop()
    assert {(t.ym, t.n, t.deaths) for t in spark.table("trend").collect()} == {("2024-01", 2, 1), ("2024-03", 1, 2)}


def test_alternatives_equal_plain_deviations(spark):
    """On a network with one-way and parallel roads, dead ends and ties: every loopless deviation, by length."""
    from hazardgrid.operators import overlay
    from hazardgrid.operators.alternatives import alternative_paths

    r = random.Random(4)
    width, limit = 5, 3000.0
    nodes = [(i, i % width * 100.0, i // width * 100.0) for i in range(25)]
    edges = []
    for i in range(25):
        for j in ([i + 1] if i % width < width - 1 else []) + ([i + width] if i + width < 25 else []):
            edges += [(i, j, float(r.choice([100, 110, 150])))] + ([(j, i, float(r.choice([100, 120])))] if r.random() < 0.8 else [])
    edges += [(0, 1, 400.0), (3, 3, 100.0), (24, 99, 100.0)]
    roads = {}
    for a, b, w in edges:
        if a != b and b < 25:
            roads[a, b] = min(w, roads.get((a, b), w))

    def best(a, b):
        dist, done = {a: 0.0}, set()
        while len(done) < len(dist):
            u = min((d, v) for v, d in dist.items() if v not in done)[1]
            done.add(u)
            for (x, y), w in roads.items():
                if x == u and dist[u] + w < dist.get(y, 1e9):
                    dist[y] = dist[u] + w
        if b not in dist:
            return None
        path = [b]
        while path[-1] != a:
            path.append(min((dist[x], x) for (x, y), w in roads.items() if y == path[-1] and dist.get(x, 1e9) + w == dist[y])[1])
        return dist[b], path[::-1]

    def length(path):
        return sum(roads[e] for e in zip(path, path[1:], strict=False))

    trips = [(q, *r.sample(range(25), 2)) for q in range(12)]
    want = []
    for q, a, b in trips:
        first = best(a, b)
        if first is None:
            continue
        others = set()
        for k, u in enumerate(first[1][:-1]):
            for (x, w), _ in roads.items():
                rest = best(w, b) if x == u and w != first[1][k + 1] and w not in first[1][: k + 1] else None
                if rest and not set(rest[1]) & set(first[1][: k + 1]):
                    others.add((*first[1][: k + 1], *rest[1]))
        ranked = [tuple(first[1]), *sorted((p for p in others if length(p) <= limit), key=lambda p: (length(p), p))[:3]]
        want += [(q, k, length(p), list(p)) for k, p in enumerate(ranked)]
    network = overlay.build(spark.createDataFrame(nodes, "node long, x double, y double"), spark.createDataFrame(edges, "src long, dst long, len_m double"), limit, most=6)
    got = overlay.shortest_paths(spark.createDataFrame(trips, "qid long, src long, dst long"), network).where("found").drop("found")
    rows = alternative_paths(got, network, spark.createDataFrame(edges, "src long, dst long, len_m double").where("dst < 25"), 4).collect()
    assert sorted((x.qid, x.alt, x.length_m, x.nodes) for x in rows) == sorted(want)
    assert {x.alt for x in rows} == {0, 1, 2, 3}


def test_deviations_share_ends_and_only_the_shortest_are_walked(spark, monkeypatch):
    """Searches from the end are one a node, not one a deviation; nodes are found in rounds, with the same results."""
    from hazardgrid.operators import alternatives, overlay

    r = random.Random(12)
    width = 7
    nodes = [(i, i % width * 100.0, i // width * 100.0) for i in range(width * width)]
    pairs = [(i, j) for i in range(width * width) for j in ([i + 1] if i % width < width - 1 else []) + ([i + width] if i + width < width * width else [])]
    edges = spark.createDataFrame([(*e, float(r.choice([100, 110, 130]))) for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long, len_m double")
    network = overlay.build(spark.createDataFrame(nodes, "node long, x double, y double"), edges, 3000.0, most=12)
    trips = spark.createDataFrame([(q, *r.sample(range(width * width), 2)) for q in range(6)], "qid long, src long, dst long")
    best = overlay.shortest_paths(trips, network).where("found").drop("found").localCheckpoint()
    walked, asked, path_nodes, in_cells = [], [], overlay.path_nodes, overlay._in_cells
    monkeypatch.setattr(overlay, "path_nodes", lambda over, got: walked.append(got.trips.count()) or path_nodes(over, got))
    monkeypatch.setattr(overlay, "_in_cells", lambda over, rows, *more: asked.append(rows.count()) or in_cells(over, rows, *more))

    def run(first, more):
        walked.clear()
        asked.clear()
        monkeypatch.setattr(alternatives, "FIRST", first)
        monkeypatch.setattr(alternatives, "MORE", more)
        rows = alternatives.alternative_paths(best, network, edges, 3).collect()
        return sorted((x.qid, x.alt, x.length_m, x.nodes) for x in rows), sum(walked)

    few, some = run(1, 2)
    assert asked[0] > 6 and asked[1] == trips.select("dst").distinct().count()
    every, all_ = run(1 << 20, 2)
    assert few == every and {x[1] for x in few} == {0, 1, 2} and some < all_ / 2
    assert run(8, 4)[0] == every
    assert alternatives.alternative_paths(best.where("false"), network, edges, 3).collect() == []


def test_only_the_shortest_deviations_are_searched_from_their_start(spark, monkeypatch):
    """F1 route_candidates: a trip's deviations get their lengths backwards from its end, as plain searches tell them; a few of
    them are searched on their own. Results are the same when all are, and when the near ones don't suffice."""
    from hazardgrid.operators import alternatives, overlay

    nodes, edges = network(spark, 7, 3)
    known = [tuple(e) for e in edges.where("dst < 49").collect()]
    over = overlay.build(nodes, edges, 1500.0, most=12)
    r = random.Random(6)
    trips = [(q, *r.sample(range(49), 2), r.choice([600.0, 1500.0])) for q in range(5)]
    plain = {(a, b): plain_path(known, a, b, 1500.0)[1] for _, s, b, _ in trips for a in [s, *range(0, 49, 3)]}
    starts = spark.createDataFrame([(q, a) for q, *_ in trips for a in range(0, 49, 3)], "qid long, src long")
    got = {(x.qid, x.src): x.rest for x in overlay.rests(over, overlay.backward(over), spark.createDataFrame(trips, "qid long, src long, dst long, most double"), starts).collect()}
    needed = 0
    for q, s, b, most in trips:
        for a in range(0, 49, 3):
            there, rest = plain_path(known, s, a, 1500.0)[1], plain[a, b]
            assert (q, a) not in got or (rest is not None and got[q, a] >= rest)
            if there is not None and rest is not None and there + rest <= most:
                assert got[q, a] == rest
                needed += 1
    assert needed > 20
    best = overlay.shortest_paths(spark.createDataFrame([t[:3] for t in trips], "qid long, src long, dst long"), over).where("found").drop("found").localCheckpoint()
    asked, search = [], overlay.search
    monkeypatch.setattr(overlay, "search", lambda over, rows: asked.append(rows.count()) or search(over, rows))

    def run():
        asked.clear()
        return sorted((x.qid, x.alt, x.length_m, x.nodes) for x in alternatives.alternative_paths(best, over, edges.where("dst < 49"), 3).collect()), sum(asked)

    rows, few = run()
    monkeypatch.setattr(alternatives, "NEAR_M", -1e9)  # all by the second pass
    monkeypatch.setattr(alternatives, "FIRST", 1 << 20)
    every, all_ = run()
    assert rows == every and {x[1] for x in rows} == {0, 1, 2} and few < all_


def test_kernel_sums_equal_rows_in_the_circle(spark):
    """Rims, centres, cells with many points, negative and missing coordinates, and any number of cells."""
    from hazardgrid.operators.moments import kernel_sums

    r = random.Random(8)
    points = [(float(r.randint(-900, 900)), float(r.randint(-900, 900)), r.randint(0, 20), k) for k in range(800)]
    points += [(10.5, -20.25, 3, k) for k in range(200)] + [(None, 1.0, 1, 1), (300.0, 400.0, 7, 1), (-500.0, 0.0, 7, 1), (500.0000001, 0.0, 7, 1)]
    probes = [(k, r.uniform(-1000, 1000), r.uniform(-1000, 1000)) for k in range(30)] + [(100, 0.0, 0.0), (101, None, 0.0), (102, 5000.0, 0.0), (103, 125.0, -250.0)]
    p = spark.createDataFrame(probes, "lid long, px double, py double")
    a = spark.createDataFrame(points, "x double, y double, v int, more int")
    for fine in (1, 2, 4, 7):
        got = {x.lid: x for x in kernel_sums(p, "lid", a, F.col("v"), 500.0, {"more": F.col("more")}, fine).collect()}
        for lid, px, py in probes:
            near = [] if px is None else [(v, more, (x - px) ** 2 + (y - py) ** 2) for x, y, v, more in points if x is not None and (x - px) ** 2 + (y - py) ** 2 <= 250000]
            assert (lid in got) == bool(near)
            if near:
                assert (got[lid].n, got[lid].more) == (len(near), sum(m for _, m, _ in near))
                assert abs(got[lid].wsum - sum(v * (1 - d / 250000) for v, _, d in near)) < 1e-8


def test_inside_rings_equals_ray_casting(spark):
    """Rings with holes, flat and long edges, points on edges and vertices, without coordinates, and cells of
    any size."""
    from hazardgrid.operators import boundary

    r = random.Random(6)
    rings = [[(-50, -40), (90, -40), (95, 70), (30, 70), (20, 10), (-50, 60)], [(0, 0), (10, 0), (10, 10), (0, 10)]]
    rings += [[(cx + r.randint(-9, 9), cy + r.randint(-9, 9)) for _ in range(r.randint(3, 7))] for cx, cy in [(r.randint(-60, 100), r.randint(-60, 80)) for _ in range(25)]]
    vertices = [(i, k, float(x), float(y)) for i, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
    points = [(float(r.randint(-70, 110)), float(r.randint(-70, 90))) for _ in range(400)] + [(r.uniform(-70, 110), r.uniform(-70, 90)) for _ in range(200)]
    points += [(x, y) for _, _, x, y in vertices] + [(None, 1.0), (1.0, None), (1e9, 0.0)]
    edges = [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    want = {k: x is not None and y is not None and sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in edges) % 2 == 1 for k, (x, y) in enumerate(points)}
    v = spark.createDataFrame(vertices, "ring long, seq long, x double, y double")
    p = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "id long, px double, py double")
    for side in (3.0, 10.0, 1000.0):
        assert {x.id: x.inside for x in boundary.inside_rings(p, "id", boundary.edges_of(v, "ring", "seq"), side).collect()} == want
    assert boundary.inside_rings(p, "id", boundary.edges_of(v, "ring", "seq").limit(0), 10.0).where("inside").count() == 0


def test_refresh_measures_touched_samples_only(spark):
    """Equal to a rebuild where measures are local; samples on the rim are touched, others never measured."""
    samples = spark.createDataFrame([(k, 100.0 * k, 0.0) for k in range(20)], "bid long, px double, py double")
    old = spark.createDataFrame([(50.0 * k, 30.0) for k in range(10)], "x double, y double")
    new = spark.createDataFrame([(500.0, 0.0), (500.0, 0.0), (1900.0, 100.0)], "x double, y double")

    def measure(points, some):
        hits = spatial.radius_join(points, some, 100.0).groupBy("bid").agg(F.count("*").alias("n"))
        return points.select("bid").join(hits, "bid", "left").fillna(0, ["n"])

    stored = measure(samples, old)
    asked = baseline.touched(samples, "bid", new, 100.0)
    assert sorted(r.bid for r in asked.collect()) == [4, 5, 6, 19]
    got = baseline.refreshed(stored, samples, "bid", new, 100.0, lambda some: measure(some, old.unionByName(new)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, measure(samples, old.unionByName(new)).collect()))
    none = baseline.refreshed(stored, samples, "bid", new.limit(0), 100.0, lambda some: measure(some, old))
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, stored.collect()))
