"""Shortest paths over a stored road network of any size, by a partition overlay.

The network is cut into cells of a bounded number of nodes. In each cell, in parallel, searches from the
nodes where roads enter find the distances to all roads that leave; these jumps, from entry to entry of
the next cell, are the overlay. A trip is then searched in its two end cells, and between them by
jumps, a cell a round: a task applies a cell's jumps to all that its trips have reached there at once, so
of many ways to an entry only the best leaves it. Only the cells on a found path are opened again for its nodes.

No task or driver holds more than a cell, a block of trips and, for each, the entries of one cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, durable
from ..shipping import ship_package

#: Nodes of a cell at most, unless more lie in one square of UNIT metres; trips of a block, and labels of one.
CELL_NODES, BLOCK_TRIPS, BLOCK_LABELS, UNIT, LEVELS = 2500, 500, 40_000, 50.0, 24
#: Sums of labels and jumps that are held at once.
AT_ONCE = 1_000_000
INNER, LEAVES, ENTERS = 0, 1, 2
SEEDS = "array<struct<node:bigint,d:double,from_d:double,via:bigint>>"


def quad_cells(points: DataFrame, most: int = CELL_NODES, at: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``points`` with ``cell``: the largest square of a quadtree around each that holds ``most`` points at
    most. Points are counted once, in the smallest squares; all levels follow from these counts."""
    fine = points.withColumn("qx", F.floor(F.col(at[0]) / UNIT)).withColumn("qy", F.floor(F.col(at[1]) / UNIT))
    own = fine.groupBy("qx", "qy").agg(F.count("*").alias("n"))
    up = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    high = lambda c: F.expr(f"shiftright({c}, level)")
    up = up.select("qx", "qy", "n", "level", high("qx").alias("hx"), high("qy").alias("hy"))
    full = durable(up.groupBy("level", "hx", "hy").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("level", "hx", "hy"))
    # the level below the highest crowded one is the cell's; crowded squares nest
    deepest = up.join(full, ["level", "hx", "hy"], "left_semi").groupBy("qx", "qy").agg(F.min("level").alias("crowded"))
    level = F.when(F.col("crowded").isNull(), LEVELS).otherwise(F.greatest(F.col("crowded") - 1, F.lit(0)))
    named = own.join(deepest, ["qx", "qy"], "left").withColumn("level", level)
    cell = F.expr("(cast(level as bigint) << 58) | ((shiftright(qx, level) & 536870911) << 29) | (shiftright(qy, level) & 536870911)")
    return fine.join(named.select("qx", "qy", cell.alias("cell")), ["qx", "qy"]).drop("qx", "qy")


def reach(graph: dict[int, list[tuple[int, float]]], seeds: dict[int, float], limit: float, wanted: Iterable[int] = ()) -> dict[int, float]:
    """Distances up to ``limit`` from seeds that have distances already. With nodes that are ``wanted`` the search
    ends at the last of them: distances below its own are final, others may be too large."""
    best, open_ = dict(seeds), set(wanted)
    heap = [(d, v) for v, d in seeds.items()]
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        if u in open_:
            open_.discard(u)
            if not open_:
                break
        for v, w in graph.get(u, ()):
            if d + w <= limit and d + w < best.get(v, float("inf")):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


def adjacency(rows: pd.DataFrame, reverse: bool = False) -> dict[int, list[tuple[int, float]]]:
    graph: dict[int, list[tuple[int, float]]] = {}
    inner = rows[rows["kind"] == INNER]
    a, b = ("dst", "src") if reverse else ("src", "dst")
    for u, v, w in zip(inner[a].tolist(), inner[b].tolist(), inner["len_m"].tolist(), strict=True):
        graph.setdefault(u, []).append((v, w))
    return graph


def roads_out(rows: pd.DataFrame) -> list[tuple[int, int, float, int]]:
    """(src, dst, len_m, to_cell) of the roads that leave a cell; as lists, since a common type of the
    columns would round the cells."""
    out = rows[rows["kind"] == LEAVES]
    return list(zip(*[out[c].tolist() for c in ("src", "dst", "len_m", "to_cell")], strict=True))


@dataclass(frozen=True)
class Overlay:
    """cells(node, x, y, cell); roads(cell, kind, src, dst, len_m, to_cell): of each cell its inner roads,
    those that leave it, and the nodes where roads enter; jumps(at, src, node, cell, x, y, len_m, via, via_m): in
    cell at from entry src to the next cell's entry node, the last node before being via after via_m; pace: least
    metres of road a metre of straight line."""

    cells: DataFrame
    roads: DataFrame
    jumps: DataFrame
    pace: float
    limit: float


def build(nodes: DataFrame, edges: DataFrame, limit: float, most: int = CELL_NODES) -> Overlay:
    """The overlay of ``nodes(node, x, y)`` and directed ``edges(src, dst, len_m)``, for paths up to
    ``limit``. Of parallel edges the shortest counts; edges to unknown nodes are no part of the network;
    lengths must be positive."""
    ship_package(nodes.sparkSession)
    cells = durable(quad_cells(nodes.select(F.col("node").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")), most).select("node", "x", "y", "cell"))
    end = lambda a, n: cells.select(F.col("node").alias(a), *[F.col(c).alias(f"{n}_{c}") for c in ("x", "y", "cell")])
    one = edges.where("src <> dst").groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.min("len_m").cast("double").alias("len_m"))
    placed = durable(one.join(end("src", "a"), "src").join(end("dst", "b"), "dst"))
    straight = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    row = placed.agg(F.min(F.try_divide("len_m", straight)).alias("pace"), F.min("len_m").alias("least")).first()
    if row["least"] is not None and not row["least"] > 0:
        raise ValueError("lengths of roads must be positive")
    crosses = placed.where("a_cell <> b_cell")
    inner = placed.where("a_cell = b_cell").select(F.col("a_cell").alias("cell"), F.lit(INNER).alias("kind"), "src", "dst", "len_m", F.col("b_cell").alias("to_cell"))
    leaves = crosses.select(F.col("a_cell").alias("cell"), F.lit(LEAVES).alias("kind"), "src", "dst", "len_m", F.col("b_cell").alias("to_cell"))
    enters = crosses.select(F.col("b_cell").alias("cell"), F.lit(ENTERS).alias("kind"), F.col("dst").alias("src"), "dst", F.lit(0.0).alias("len_m"), F.col("b_cell").alias("to_cell")).distinct()
    roads = durable(inner.unionByName(leaves).unionByName(enters))

    def jump(rows: pd.DataFrame) -> pd.DataFrame:
        graph = adjacency(rows)
        leaving, at, out = roads_out(rows), int(rows["cell"].iloc[0]), []
        for u in rows["src"][rows["kind"] == ENTERS].tolist():
            out += [(at, u, *t) for t in ways_out(reach(graph, {u: 0.0}, limit), leaving, limit)]
        return pd.DataFrame(out, columns=["at", "src", "node", "cell", "len_m", "via_m", "via"])

    found = _dealt_out(roads, "cell").groupBy("cell").applyInPandas(jump, "at long, src long, node long, cell long, len_m double, via_m double, via long")
    jumps = durable(found.join(cells.select("node", "x", "y"), "node").select("at", "src", "node", "cell", "x", "y", "len_m", "via_m", "via"))
    return Overlay(cells, roads, jumps, row["pace"] or 0.0, limit)


def ways_out(best: dict[int, float], leaving: list[tuple], limit: float) -> list[tuple]:
    """(entry, its cell, length, length before the last road, node before it) for the entries reached; of
    equally long ways the nearer, then the smaller last node."""
    out: dict[int, tuple] = {}
    for w, v, length, cell in leaving:
        d = best.get(w)
        if d is not None and d + length <= limit:
            way = (d + length, d, w, cell)
            if v not in out or way < out[v]:
                out[v] = way
    return [(v, c, d, before, w) for v, (d, before, w, c) in out.items()]


def _dealt_out(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in as many parts as a shuffle has: searches take long over few bytes, by which parts would be joined."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _in_blocks(over: Overlay, asked: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], list], columns: str) -> DataFrame:
    """``run`` over each cell's roads with ``asked(cell, qid, ...)``, in blocks of trips: a cell that
    many trips are in is dealt out with a copy of its roads a block."""
    spread = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_TRIPS).cast("int").alias("blocks"))
    roads = over.roads.join(spread, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "kind", "src", "dst", "len_m", "to_cell")
    dealt = asked.join(spread, "cell").select("cell", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block"), *[c for c in asked.columns if c != "cell"])
    names = [c.split()[0] for c in columns.split(", ")]

    def work(roads: pd.DataFrame, trips: pd.DataFrame) -> pd.DataFrame:
        # as objects, since whole numbers beside nulls would become doubles
        return pd.DataFrame(run(roads, trips) if len(trips) else [], columns=names, dtype=object)

    roads, dealt = _dealt_out(roads, "cell", "block"), _dealt_out(dealt, "cell", "block")
    return roads.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInPandas(work, columns)


def _in_cells(over: Overlay, asked: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], list], columns: str) -> DataFrame:
    """``_in_blocks`` of searches from a trip's start on, as ``asked(cell, qid, head, ...)``."""
    return _in_blocks(over, asked, run, columns)


def _starts(roads: pd.DataFrame, trips: pd.DataFrame) -> list:
    """Of each trip its ways out of the first cell, and its length if it ends there (cell is null)."""
    graph, leaving, out = adjacency(roads), roads_out(roads), []
    for q, head, src, most in zip(*(trips[c].tolist() for c in ("qid", "head", "src", "most")), strict=True):
        best = reach(graph, {src: 0.0}, most)
        # ways out that are longer than the way inside lead to no shorter one
        out += [(q, v, c, d, before, w) for v, c, d, before, w in ways_out(best, leaving, best.get(head, most))]
        if head in best:
            out.append((q, head, None, best[head], None, None))
    return out


def _ends(roads: pd.DataFrame, trips: pd.DataFrame) -> list:
    """Of each end the distances to it from its cell's entries."""
    graph, entries = adjacency(roads, reverse=True), set(roads["src"][roads["kind"] == ENTERS].tolist())
    return [(q, v, d) for q, head, most in zip(*(trips[c].tolist() for c in ("qid", "head", "most")), strict=True) for v, d in reach(graph, {head: 0.0}, most).items() if v in entries]


def _to_ends(roads: pd.DataFrame, trips: pd.DataFrame) -> list:
    """Of each trip the metres from the nodes ``starts`` of this cell to its end, by ``nodes`` from where they are ``rests``."""
    graph, out = adjacency(roads, reverse=True), []
    for q, most, starts, nodes, rests in zip(trips["qid"].tolist(), trips["most"].tolist(), trips["starts"], trips["nodes"], trips["rests"], strict=True):
        seeds: dict[int, float] = {}
        for v, d in zip(nodes.tolist(), rests.tolist(), strict=True):
            seeds[v] = min(d, seeds.get(v, d))
        starts = set(starts.tolist())
        best = reach(graph, seeds, most, starts)
        out += [(q, v, best[v]) for v in starts if v in best]
    return out


def _back(limit: float) -> Callable:
    """Of each trip the nodes from where its path enters this cell up to ``head``, and the node before
    these in another cell, if the path doesn't start here. Of equally short ways the nearer, then the
    smaller node before."""

    def run(roads: pd.DataFrame, trips: pd.DataFrame) -> list:
        graph, before, out = adjacency(roads), adjacency(roads, reverse=True), []
        for q, head, seeds in zip(trips["qid"], trips["head"], trips["seeds"], strict=True):
            # a node may be the start and be entered again on a detour: the smaller distance counts
            entered = {s["node"]: s for s in sorted(seeds, key=lambda s: -s["d"])}
            best = reach(graph, {v: s["d"] for v, s in entered.items()}, limit, [head])
            nodes, v, far = [head], head, None
            while best[v] > 0:
                ways = [(best[p], p, False) for p, w in before.get(v, ()) if p in best and best[p] + w == best[v]]
                s = entered.get(v)
                if s is not None and s["d"] == best[v]:
                    ways.append((s["from_d"], s["via"], True))
                _, v, outside = min(ways)
                if outside:
                    far = v
                    break
                nodes.append(v)
            out.append((q, nodes[::-1], far))
        return out

    return run


def _seeds(*fields: str):
    return F.array(F.struct(*[F.expr(f"{f} as {n}") for f, n in zip(fields, ("node", "d", "from_d", "via"), strict=True)])).cast(SEEDS)


def _jumped(over: Overlay, ahead: DataFrame) -> DataFrame:
    """The best label (qid, node, cell, s) of each trip and entry that jumps reach from one cell's labels
    ``ahead(qid, cell, node, so_far, b_x, b_y, most)``, of equally long ones the nearer, then the smaller last node; those
    only that with the straight line to the end, at the least pace, are not above ``most``."""
    spread = ahead.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_LABELS).cast("int").alias("blocks"))
    jumps = over.jumps.join(spread.withColumnRenamed("cell", "at"), "at").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dealt = ahead.join(spread, "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).drop("blocks")
    pace, names = over.pace, ["qid", "node", "cell", "d", "from_d", "via"]

    def work(jumps: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=names, dtype=np.int64)
        if not len(jumps) or not len(labels):
            return none
        src, i = np.unique(jumps["src"].to_numpy(), return_inverse=True)
        to, first, j = np.unique(jumps["node"].to_numpy(), return_index=True, return_inverse=True)
        cell, x, y = (jumps[c].to_numpy()[first] for c in ("cell", "x", "y"))
        length, before, via = np.full((len(src), len(to)), np.inf), np.full((len(src), len(to)), np.inf), np.full((len(src), len(to)), np.iinfo(np.int64).max)
        length[i, j], before[i, j], via[i, j] = jumps["len_m"], jumps["via_m"], jumps["via"]
        labels = labels[np.isin(labels["node"].to_numpy(), src)].sort_values("qid", kind="stable")
        parts, step = [none], max(1, AT_ONCE // len(to))
        for part in (labels.iloc[k : k + step] for k in range(0, len(labels), step)):
            at, so_far, qid = np.searchsorted(src, part["node"].to_numpy()), part["so_far"].to_numpy()[:, None], part["qid"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], qid[1:] != qid[:-1]]))
            trip = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(qid))))
            d = so_far + length[at]
            least = np.minimum.reduceat(d, start, axis=0)
            tie = d == least[trip]
            from_d = np.where(tie, so_far + before[at], np.inf)
            nearest = np.minimum.reduceat(from_d, start, axis=0)
            last = np.minimum.reduceat(np.where(tie & (from_d == nearest[trip]), via[at], np.iinfo(np.int64).max), start, axis=0)
            b_x, b_y, most = (part[c].to_numpy()[start][:, None] for c in ("b_x", "b_y", "most"))
            line = pace * np.hypot(x - b_x, y - b_y)
            g, t = np.nonzero(np.isfinite(least) & (least + line * (1 - 1e-9) <= most * (1 + 1e-12)))
            parts.append(pd.DataFrame({"qid": qid[start][g], "node": to[t], "cell": cell[t], "d": least[g, t], "from_d": nearest[g, t], "via": last[g, t]}))
        return pd.concat(parts[1:] or parts)

    got = jumps.groupBy("at", "block").cogroup(dealt.groupBy("cell", "block")).applyInPandas(work, "qid long, node long, cell long, d double, from_d double, via long")
    return got.select("qid", "node", "cell", F.struct("d", "from_d", "via").alias("s"))


@dataclass(frozen=True)
class Searched:
    """trips(qid, src, a_cell, dst, b_cell, length_m) of the trips with a path; labels(qid, node, cell, s): the
    entries met on the way, s being the distance, that of the node before, and this node."""

    trips: DataFrame
    labels: DataFrame


def _placed(over: Overlay, queries: DataFrame) -> DataFrame:
    """``queries(qid, src, dst, most)`` with cells and places of both nodes; without ``most`` it is the overlay's limit."""
    most = F.least(F.lit(over.limit), "most") if "most" in queries.columns else F.lit(over.limit)
    a, b = (over.cells.select(F.col("node").alias(n), F.col("cell").alias(f"{p}_cell"), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y")) for n, p in (("src", "a"), ("dst", "b")))
    return queries.select("qid", F.col("src").cast("long"), F.col("dst").cast("long"), most.alias("most")).join(a, "src").join(b, "dst")


def _asked_ends(trips: DataFrame) -> DataFrame:
    """The ends of trips, to be searched from: trips to one node, as deviations of one trip are, share the search."""
    return trips.groupBy(F.col("b_cell").alias("cell"), F.col("dst").alias("qid")).agg(F.max("most").alias("most")).withColumn("head", F.col("qid"))


def search(over: Overlay, queries: DataFrame) -> Searched:
    """Searches ``queries(qid, src, dst)``, qid unique. Rounds go on until no entry gets a smaller distance; an
    entry is followed only if its distance and the straight line from it, at the least pace, can beat both the
    limit and the trip's best length so far. Queries may have a limit of their own, ``most``."""
    trips = durable(_placed(over, queries).drop("a_x", "a_y"))
    first = durable(_in_cells(over, trips.select(F.col("a_cell").alias("cell"), "qid", F.col("dst").alias("head"), "src", "most"), _starts, "qid long, node long, cell long, d double, from_d double, via long"))
    rests = _in_cells(over, _asked_ends(trips), _ends, "dst long, node long, rest double")
    ends = durable(trips.select("qid", "dst", "most").join(rests, "dst").where("rest <= most").select("qid", "node", "rest"))
    best = durable(first.where("cell is null").select("qid", F.col("d").alias("best")))
    label = F.struct("d", "from_d", "via").alias("s")
    known = durable(first.where("cell is not null").select("qid", "node", "cell", label, F.lit(True).alias("new")))
    while not known.where("new").isEmpty():
        fresh = known.where("new")
        met = fresh.join(ends, ["qid", "node"]).select("qid", (F.col("s.d") + F.col("rest")).alias("best"))
        shorter = durable(best.unionByName(met).groupBy("qid").agg(F.min("best").alias("best")))
        discard(best)
        best = shorter
        goal = trips.select("qid", "b_x", "b_y", "most").join(best, "qid", "left").select("qid", "b_x", "b_y", F.least("most", F.coalesce("best", "most")).alias("most"))
        ahead = fresh.select("qid", "node", "cell", F.col("s.d").alias("so_far")).join(goal, "qid").where(F.col("so_far") < F.col("most"))
        step = _jumped(over, durable(ahead))
        tried = known.select("qid", "node", "cell", "s", F.lit(0).alias("late")).unionByName(step.withColumn("late", F.lit(1)))
        least = tried.groupBy("qid", "node", "cell").agg(F.min(F.struct("s", "late")).alias("b"))
        after = durable(least.select("qid", "node", "cell", "b.s", (F.col("b.late") == 1).alias("new")))
        discard(known)
        known = after
    found = trips.join(best, "qid").where("best <= most")
    return Searched(durable(found.select("qid", "src", "a_cell", "dst", "b_cell", F.col("best").alias("length_m"))), known)


def backward(over: Overlay) -> Overlay:
    """The overlay with its jumps turned round: from a cell's entry to those of the cells before."""
    at = over.cells.select(F.col("node").alias("src"), "x", "y")
    turned = over.jumps.select(F.col("cell").alias("at"), F.col("node").alias("src"), F.col("src").alias("node"), F.col("at").alias("cell"), "len_m")
    turned = turned.join(at.withColumnRenamed("src", "node"), "node")
    return replace(over, jumps=durable(turned.select("at", "src", "node", "cell", "x", "y", "len_m", F.lit(0.0).alias("via_m"), F.lit(0).cast("long").alias("via"))))


def rests(over: Overlay, turned: Overlay, queries: DataFrame, starts: DataFrame) -> DataFrame:
    """(qid, src, rest): the metres from each node of ``starts(qid, src)`` to the end of its trip of ``queries(qid, src,
    dst, most)``, where a way of ``most`` metres from the trip's start to its end can lead through the node; others may
    be missing. Entries get their rests from the end on, a cell a round; then one search backwards, a trip and cell,
    serves all nodes there."""
    trips = durable(_placed(over, queries).select("qid", "dst", "b_cell", "a_x", "a_y", "most"))
    line = F.lit(over.pace * (1 - 1e-9)) * F.hypot(F.col("x") - F.col("a_x"), F.col("y") - F.col("a_y"))
    to = _in_blocks(over, _asked_ends(trips), _ends, "dst long, node long, rest double").join(over.cells, "node")
    on_way = F.col("rest") + line <= F.col("most") * (1 + 1e-12)
    known = durable(trips.join(to, "dst").where(on_way).select("qid", "node", "cell", "rest", F.lit(True).alias("new")))
    goal = trips.select("qid", F.col("a_x").alias("b_x"), F.col("a_y").alias("b_y"), "most")
    while not known.where("new").isEmpty():
        ahead = durable(known.where("new").select("qid", "node", "cell", F.col("rest").alias("so_far")).join(goal, "qid"))
        step = _jumped(turned, ahead).select("qid", "node", "cell", F.col("s.d").alias("rest"), F.lit(1).alias("late"))
        tried = known.select("qid", "node", "cell", "rest", F.lit(0).alias("late")).unionByName(step)
        least = tried.groupBy("qid", "node", "cell").agg(F.min(F.struct("rest", "late")).alias("b"))
        after = durable(least.select("qid", "node", "cell", "b.rest", (F.col("b.late") == 1).alias("new")))
        discard(known)
        discard(ahead)
        known = after
    leaves = over.roads.where(F.col("kind") == LEAVES).select("cell", F.col("dst").alias("node"), F.col("src").alias("out"), "len_m")
    seeds = known.select("qid", "node", "rest").join(leaves, "node").select("qid", "cell", F.col("out").alias("node"), (F.col("rest") + F.col("len_m")).alias("rest"))
    seeds = seeds.unionByName(trips.select("qid", F.col("b_cell").alias("cell"), F.col("dst").alias("node"), F.lit(0.0).alias("rest")))
    of = lambda s, f: F.transform(s, lambda e: e[f])
    seeds = seeds.groupBy("qid", "cell").agg(F.collect_list(F.struct("node", "rest")).alias("s")).select("qid", "cell", of("s", "node").alias("nodes"), of("s", "rest").alias("rests"))
    at = starts.join(over.cells.select(F.col("node").alias("src"), "cell"), "src").groupBy("qid", "cell").agg(F.collect_set("src").alias("starts"))
    asked = at.join(seeds, ["qid", "cell"]).join(trips.select("qid", "most"), "qid")
    return durable(_in_blocks(over, asked, _to_ends, "qid long, src long, rest double"))


def path_nodes(over: Overlay, got: Searched) -> DataFrame:
    """(qid, nodes) of the searched trips: their paths are walked back from the end, a cell a round."""
    # only labels nearer than the end can lie on a path
    near = got.labels.join(got.trips.select("qid", "length_m"), "qid").where(F.col("s.d") <= F.col("length_m"))
    labels = durable(near.select("qid", "cell", F.struct("node", "s.d", "s.from_d", "s.via").alias("l")))
    starts = got.trips.select("qid", F.col("a_cell").alias("cell"), F.expr("struct(src as node, 0d as d, 0d as from_d, src as via)").alias("l"))
    labels = labels.unionByName(starts)
    heads = got.trips.select("qid", F.col("dst").alias("head"), F.col("b_cell").alias("cell"))
    pieces, turn = [], 0
    while True:
        met = heads.join(labels, ["qid", "cell"]).groupBy("qid", "cell", "head").agg(F.collect_list("l").cast(SEEDS).alias("seeds"))
        piece = durable(_in_cells(over, met, _back(over.limit), "qid long, nodes array<long>, far long"))
        pieces.append(piece.select("qid", F.lit(-turn).alias("turn"), "nodes"))
        heads = piece.where("far is not null").select("qid", F.col("far").alias("head")).join(over.cells.select(F.col("node").alias("head"), "cell"), "head")
        turn += 1
        if heads.isEmpty():
            break
    while len(pieces) > 1:  # as a tree, so that the plan stays flat
        pieces = [pieces[i].unionByName(pieces[i + 1]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0].groupBy("qid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "nodes"))), lambda p: p["nodes"])).alias("nodes"))


def shortest_paths(queries: DataFrame, over: Overlay) -> DataFrame:
    """(qid, found, length_m, nodes) for each row of ``queries(qid, src, dst)``."""
    got = search(over, queries)
    found = got.trips.select("qid", "length_m").join(path_nodes(over, got), "qid")
    return queries.select("qid").join(found, "qid", "left").select("qid", F.col("length_m").isNotNull().alias("found"), "length_m", "nodes")
