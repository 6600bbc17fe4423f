"""The registered queries as SQL for an independent engine, by plain joins and no grid."""

from __future__ import annotations

import math

from .config import DEFAULT, NIGHT_HOURS, PEAK_HOURS
from .errors import REQUEST_ERRORS
from .functions.scalar import DIGITS_FROM, DIGITS_TO, NAME_FROM, NAME_TO, NUMERALS
from .plans.surrogate import BOUNDARY, LARGE, PEDESTRIAN

NIGHT, PEAK = str(tuple(NIGHT_HOURS)), str(tuple(PEAK_HOURS))


def _mentions(*words: str) -> str:
    return "(" + " or ".join(f"contains(coalesce(parties, ''), '{w}')" for w in words) + ")"


def _k(d2: str, r: float = 500.0) -> str:
    return f"(case when {d2} >= {r * r} then 0.0 else greatest(0.0, 1.0 - {d2} / {r * r}) end)"


def _clamp(v: str) -> str:
    return f"cast(round_even(greatest(0.0, least(100.0, cast({v} as double))), 0) as int)"


def _star(v: str) -> str:
    return f"greatest(0.5, least(5.0, round_even(({v}) / 20.0 * 2, 0) / 2))"


def _tone(v: str) -> str:
    return f"(case when {v} < 60 then 'bad' when {v} < 75 then 'mid' else 'ok' end)"


def _within(boundary: list[tuple[float, float]]) -> str:
    edges = list(zip(boundary, boundary[1:] + boundary[:1], strict=True))
    one = " + ".join(f"(case when ({a[1]} > py) <> ({b[1]} > py) and px < ({b[0]} - {a[0]}) * (py - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} then 1 else 0 end)" for a, b in edges)
    return f"({one}) % 2 = 1"


def _recursion(name: str, start: str, table: str = "snap") -> str:
    """Distances up to the route limit from the nodes ``start`` of ``table``, relaxed road by road."""
    return f"""{name}(s, v, d) using key (s, v) as (select distinct {start}, {start}, 0.0::double from {table} where {start} >= 0 union select {name}.s, dst, min({name}.d + len_m) from {name} join edges on src = {name}.v
        left join recurring.{name} known on known.s = {name}.s and known.v = dst where {name}.d + len_m <= {DEFAULT.route_limit} and (known.d is null or {name}.d + len_m < known.d) group by {name}.s, dst)"""


def _predecessors(name: str, dist: str) -> str:
    """Of predecessors on a shortest path the nearest, then the smallest."""
    return f"{name} as (select m.s, m.v, arg_min(e.src, {{'d': p.d, 'n': e.src}}) as p from {dist} m join edges e on e.dst = m.v join {dist} p on p.s = m.s and p.v = e.src where p.d + e.len_m = m.d and m.v <> m.s group by m.s, m.v)"


CONFIDENCE = "(case when n >= 30 then 'high' when n >= 12 then 'mid' else 'low' end)"

CTE = {
    "acc": """acc as (select event_id as aid, cast(event_id * 7919 % 10007 as double) as x, cast(event_id * 104729 % 10009 as double) as y,
        cast(hour(ts) as int) as hour, cast(case when event_type = 'error' then event_id % 3 else 0 end as int) as fat, cast(floor(value / 50) as int) as inj,
        cast(event_id % 27 - 1 as int) as mi, event_id * 31 % 200 as xid, case when event_id % 11 = 0 then null else event_type end as parties, event_type as category,
        strftime(ts, '%Y%m%d') as ymd, strftime(ts, '%H%M%S') as hms,
        1.0 + 20.0 * (case when event_type = 'error' then event_id % 3 else 0 end) as sev from events)""",
    "xing": """xing as (select p_partkey as xid, cast(p_partkey * 3571 % 10007 as double) as x, cast(p_partkey * 6547 % 10009 as double) as y, p_name as name, p_type as cls,
        coalesce(cnt, 0) as cnt from part left join (select l_partkey, count(*) as cnt from lineitem group by 1) on l_partkey = p_partkey)""",
    "loc": "loc as (select s_suppkey as lid, cast(s_suppkey * 4871 % 10007 as double) as px, cast(s_suppkey * 6547 % 10009 as double) as py from supplier)",
    "basepts": f"basepts as (select * from (select c_custkey as bid, cast(c_custkey * 5417 % 10007 as double) as px, cast(c_custkey * 2221 % 10009 as double) as py from customer) where {_within(BOUNDARY)})",
    "nodes": "nodes as (select c_custkey as node, c_custkey % 40 * 250.0 as x, c_custkey // 40 * 250.0 as y from customer)",
    "roads": """roads as (select * from (select c_custkey as a, c_custkey + 1 as b, cast(200 + c_custkey * 7919 % 101 as double) as len_m, c_custkey % 5 <> 0 as both_ways, case when c_custkey % 23 = 7 then 'motorway' else 'street' end as kind from customer where c_custkey % 40 < 39
        union all select c_custkey, c_custkey + 40, cast(200 + c_custkey * 104729 % 103 as double), true, case when c_custkey % 29 = 3 then 'elevated' else 'street' end from customer) where b in (select c_custkey from customer))""",
    "edges": "edges as (select a as src, b as dst, len_m from roads where kind = 'street' union all select b, a, len_m from roads where both_ways and kind = 'street')",
    "seg": "seg as (select len_m, (a % 40 * 250.0 + b % 40 * 250.0) / 2 as x, (a // 40 * 250.0 + b // 40 * 250.0) / 2 as y from roads)",
    "rseg": "rseg as (select len_m, (a % 40 * 250.0 + b % 40 * 250.0) / 2 as x, (a // 40 * 250.0 + b // 40 * 250.0) / 2 as y from roads where kind = 'street')",
    "hits": "hits as (select lid, acc.*, (px - x) * (px - x) + (py - y) * (py - y) as d2 from loc join acc on (px - x) * (px - x) + (py - y) * (py - y) <= 250000)",
    "xhits": "xhits as (select lid, xing.*, (px - x) * (px - x) + (py - y) * (py - y) as d2 from loc join xing on (px - x) * (px - x) + (py - y) * (py - y) <= 250000)",
    "loc_m": f"""loc_m as (select lid, coalesce(n, 0) as n, coalesce(wsum, 0.0) as wsum, coalesce(km, 0.0) as km from loc
        left join (select lid, count(*) as n, sum(sev * {_k("d2")}) as wsum from hits group by lid) using (lid)
        left join (select lid, sum(len_m * {_k("d2")}) / 1000.0 as km from (select lid, len_m, (px - x) * (px - x) + (py - y) * (py - y) as d2 from loc, seg where (px - x) * (px - x) + (py - y) * (py - y) <= 250000) group by lid) using (lid))""",
    "base0": f"""base0 as (select bid, round_even(km, 9) as km, round_even(coalesce(wsum, 0.0) / km, 6) as risk from
        (select bid, sum(len_m * {_k("d2")}) / 1000.0 as km from (select bid, len_m, (px - x) * (px - x) + (py - y) * (py - y) as d2 from basepts, seg where (px - x) * (px - x) + (py - y) * (py - y) <= 250000) group by bid)
        left join (select bid, sum(sev * {_k("d2")}) as wsum from (select bid, sev, (px - x) * (px - x) + (py - y) * (py - y) as d2 from basepts, acc where (px - x) * (px - x) + (py - y) * (py - y) <= 250000) group by bid) using (bid)
        where km >= 0.8)""",
    "cuts": "cuts as (select unnest(quantile_cont(km, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) as e from base0)",
    "base": "base as (select bid, km, risk, cast((select count(*) from cuts where base0.km >= e) as int) as band from base0)",
    "rpts": "rpts as (select bid, pos, px + pos * 20.0 as px, py from basepts, (select unnest(range(26)) as pos))",
    "rbase0": f"""rbase0 as (select bid, dens as km, round_even(coalesce(wsum, 0.0) / 0.5, 6) as risk from
        (select bid, round_even(avg(coalesce(km, 0.0)), 9) as dens from (select bid, pos, sum(len_m * {_k("d2")}) / 1000.0 as km from
            (select r.bid, r.pos, len_m, (px - x) * (px - x) + (py - y) * (py - y) as d2 from (select * from rpts where pos % 10 = 0) r left join rseg on (px - x) * (px - x) + (py - y) * (py - y) <= 250000) group by bid, pos) group by bid)
        left join (select bid, sum(sev) as wsum from (select distinct bid, aid, sev from rpts join acc on x between px - 40 and px + 40 and y between py - 40 and py + 40 and (px - x) * (px - x) + (py - y) * (py - y) <= 1600) group by bid) using (bid))""",
    "rcuts": "rcuts as (select unnest(quantile_cont(km, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) as e from rbase0)",
    "rbase": "rbase as (select bid, km, risk, cast((select count(*) from rcuts where rbase0.km >= e) as int) as band from rbase0)",
    "rinfo": "rinfo as (select band, quantile_cont(risk, 0.5) as med, count(*) as samples, min(km) as lo, max(km) as hi from rbase group by band)",
    "bandinfo": "bandinfo as (select band, quantile_cont(risk, 0.5) as med, count(*) as samples, min(km) as lo, max(km) as hi from base group by band)",
    "banded": "banded as (select lid, n, wsum, round_even(km, 9) as km, cast(coalesce((select max(band) from bandinfo where band > 0 and round_even(loc_m.km, 9) >= lo), 0) as int) as band from loc_m)",
    "shr": "shr as (select lid, n, wsum, km, banded.band, case when km = 0 then null else wsum / km end as risk, round_even((wsum + 1.0 * coalesce(med, 0.0)) / (km + 1.0), 6) as shrunk from banded left join bandinfo using (band))",
    "score": "score as (select lid, n, km, shr.band, shr.risk, shrunk, cast(round_even(100.0 * (select count(*) from base where base.band = shr.band and base.risk > shr.shrunk) / nullif((select count(*) from base where base.band = shr.band), 0), 0) as int) as score from shr)",
    "everywhere": f"everywhere as (select avg(case when hour in {NIGHT} then 1.0 else 0.0 end) as gn, avg(case when hour in {PEAK} then 1.0 else 0.0 end) as gp from acc)",
    "lines": """lines as (select s_suppkey as rid, k.range as seq, cast(s_suppkey * 431 % 5000 + k.range * (170 + s_suppkey % 7 * 40) as double) as x,
        cast(s_suppkey * 977 % 6000 + k.range * k.range * (20 + s_suppkey % 3 * 9) as double) as y from supplier, range(7) k)""",
    "segs": "segs as (select *, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) as len from (select *, lead(x) over w as nx, lead(y) over w as ny from lines window w as (partition by rid order by seq)))",
    "samples": """samples as (select rid, row_number() over (partition by rid order by seq, k) - 1 as pos,
        x + coalesce((nx - x) * (k * 20.0 / len), 0.0) as px, y + coalesce((ny - y) * (k * 20.0 / len), 0.0) as py
        from (select *, unnest(range(case when len is null then 1 else cast(ceil(len / 20.0) as bigint) end)) as k from segs))""",
    "lens": "lens as (select rid, greatest(round_even(sum(len), 6) / 1000.0, 0.1) as km from segs group by rid)",
    "rhits": "rhits as (select distinct rid, acc.* from samples join acc on (px - x) * (px - x) + (py - y) * (py - y) <= 1600)",
    "racc": "racc as (select rid, lens.km, coalesce(n, 0) as n, coalesce(wsum, 0.0) as wsum, coalesce(fat, 0) as fat, coalesce(inj, 0) as inj from lens left join (select rid, count(*) as n, sum(sev) as wsum, sum(fat) as fat, sum(inj) as inj from rhits group by rid) using (rid))",
    "rx": """rx as (select *, row_number() over (partition by rid order by cnt desc, first, xid) as rn, least(12, greatest(5, cast(round_even(km, 0) as int))) as shown_n from
        (select rid, xid, any_value(name) as name, any_value(cls) as cls, any_value(cnt) as cnt, min(pos) as first from samples join xing on (px - x) * (px - x) + (py - y) * (py - y) <= 2025 group by rid, xid) join lens using (rid))""",
    "trips": """trips as (select qid, case when qid % 8 = 6 then -900.0 else cast(a % 40 * 250.0 + 30 as double) end as fx, cast(a // 40 * 250.0 - 20 as double) as fy,
        case when qid % 8 = 7 then 12000.0 else cast(b % 40 * 250.0 - 25 as double) end as tx, cast(b // 40 * 250.0 + 40 as double) as ty
        from (select qid, a, case when qid % 8 = 5 then a else (a + qid * 3943 % 1700) % size end as b from (select s_suppkey as qid, s_suppkey * 1637 % size as a, size from supplier, (select count(*) as size from customer))))""",
    "snap": """snap as (select qid, coalesce(a, -1) as a, coalesce(b, -1) as b from trips
        left join (select qid, arg_min(node, {'d': (fx - x) * (fx - x) + (fy - y) * (fy - y), 'n': node}) as a from trips, nodes where (fx - x) * (fx - x) + (fy - y) * (fy - y) <= 160000 group by qid) using (qid)
        left join (select qid, arg_min(node, {'d': (tx - x) * (tx - x) + (ty - y) * (ty - y), 'n': node}) as b from trips, nodes where (tx - x) * (tx - x) + (ty - y) * (ty - y) <= 160000 group by qid) using (qid))""",
    "dist": _recursion("dist", "a"),
    "rdist": _recursion("rdist", "b"),
    "got": "got as (select qid, a, b, d from snap join dist on dist.s = a and dist.v = b where a >= 0 and b >= 0 and a <> b and d <= 30000)",
    "pred": _predecessors("pred", "dist"),
    "back": "back(qid, s, node, n) as (select qid, a, b, 0 from got union all select qid, back.s, pred.p, n + 1 from back join pred on pred.s = back.s and pred.v = back.node)",
    "path": "path as (select qid, row_number() over (partition by qid order by n desc) - 1 as seq, back.node, cast(x as double) as x, cast(y as double) as y from back join nodes on nodes.node = back.node)",
    "pathlines": "lines as (select qid as rid, seq, x, y from path)",
    "pathlens": "lens as (select qid as rid, greatest(d / 1000.0, 0.1) as km from got)",
    "rings": "rings as (select 0 as ring, seq, x, y from (values " + ", ".join(f"({k}, {x}::double, {y}::double)" for k, (x, y) in enumerate(BOUNDARY)) + """) v(seq, x, y)
        union all select s_suppkey + 1, k, cast(s_suppkey * 4871 % 10007 + size * far * (case when k in (0, 1, 7) then 1 when k in (3, 4, 5) then -1 else 0 end) as double), cast(s_suppkey * 6547 % 10009 + size * far * (case when k in (1, 2, 3) then 1 when k in (5, 6, 7) then -1 else 0 end) as double)
        from (select s_suppkey, r.range as k, 60 + s_suppkey * 37 % 240 as size, case when r.range % 2 = 0 then 2 else 1 end as far from supplier, range(8) r))""",
    "redges": "redges as (select a.x as ax, a.y as ay, b.x as bx, b.y as b_y from rings a join rings b on a.ring = b.ring and b.seq = (a.seq + 1) % (case when a.ring = 0 then " + str(len(BOUNDARY)) + " else 8 end))",
    # roads that leave a path, the shortest rides from their ends, and those without loops
    "along": "along as (select a.qid, a.seq as pos, a.node, z.node as next, sum(e.len_m) over (partition by a.qid order by a.seq) - e.len_m as before from path a join path z on z.qid = a.qid and z.seq = a.seq + 1 join edges e on e.src = a.node and e.dst = z.node)",
    "spurs": "spurs as (select l.qid, pos, e.dst as w, before + e.len_m as so_far from along l join edges e on e.src = l.node where e.dst <> next and not exists (select 1 from path p where p.qid = l.qid and p.seq <= l.pos and p.node = e.dst))",
    "sdist": _recursion("sdist", "w", "spurs"),
    "spred": _predecessors("spred", "sdist"),
    "sgot": "sgot as (select spurs.qid, pos, w, got.b, so_far + sdist.d as d from spurs join got on got.qid = spurs.qid join sdist on sdist.s = w and sdist.v = got.b where so_far + sdist.d <= 30000)",
    "sback": "sback(qid, pos, w, node, n) as (select qid, pos, w, b, 0 from sgot union all select qid, pos, w, spred.p, n + 1 from sback join spred on spred.s = sback.w and spred.v = sback.node)",
    "deviations": """deviations as (select g.qid, min(g.d) as d, g.nodes from (select sgot.*, (select list(node order by seq) from path p where p.qid = sgot.qid and p.seq <= sgot.pos) || r.nodes as nodes
        from sgot join (select qid, pos, w, list(node order by n desc) as nodes from sback group by all) r on r.qid = sgot.qid and r.pos = sgot.pos and r.w = sgot.w) g
        where len(list_distinct(g.nodes)) = len(g.nodes) group by g.qid, g.nodes)""",
    "alts": "alts as (select qid, 0 as alt, got.d, (select list(node order by seq) from path p where p.qid = got.qid) as nodes from got union all select qid, cast(rn as int), d, nodes from (select *, row_number() over (partition by qid order by round_even(d, 6), nodes) as rn from deviations) where rn < 3)",
    "altlines": "lines as (select rid, seq, cast(x as double) as x, cast(y as double) as y from (select qid * 3 + alt as rid, unnest(nodes) as node, generate_subscripts(nodes, 1) - 1 as seq from alts) join nodes using (node))",
    "altlens": "lens as (select qid * 3 + alt as rid, greatest(d / 1000.0, 0.1) as km from alts)",
    "places": "places as (select p_partkey as pid, concat_ws(' ', p_name, p_brand) as name, cast(p_partkey * 3571 % 10007 as double) as x, cast(p_partkey * 6547 % 10009 as double) as y from part)",
    "asked": "asked as (select * from (values (0, 'widget Brand#1', 100.0, 200.0), (1, 'small bolt', 5000.0, 5000.0), (2, 'ＢＯＬＴ　Brand#２３', 9000.0, 10.0), (3, 'gi', 1.0, 1.0), (4, '臺北', 0.0, 0.0), (5, 'ｓｍａｌｌ 二十三號', 0.0, 0.0), (6, '一百零五巷 三百十二弄 十樓', 0.0, 0.0)) v(qid, q, qx, qy))",
}


def norm(text: str) -> str:
    out = f"translate(translate({text}, '{NAME_FROM}', '{NAME_TO}'), '{DIGITS_FROM}', '{DIGITS_TO}')"
    for pattern, pieces in NUMERALS:
        new = "".join(f"\\{p}" if isinstance(p, int) else p for p in pieces)
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"lower(trim({out}))"


def grams(text: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({text}) - 2, 1) + 1), lambda i: substr({text}, i, 3)))"


def q(names: str, body: str) -> str:
    return "with recursive " + ", ".join(CTE[n] for n in names.split()) + " " + body


_FACTORS = {"accidents": "score", "crossings": "90 - hot * 14", "large": "82 - large_n / greatest(n, 1) * 230", "night": "84 - night0 * 70", "pedestrian": "88 - ped / greatest(n, 1) * 260"}
_BASE = "acc seg basepts base0 cuts base bandinfo "
_RIDE = "acc rseg basepts rpts rbase0 rcuts rbase rinfo "
_SEARCHED = "nodes roads edges trips snap dist got pred back path "
_ALTERNATIVES = "along spurs sdist spred sgot sback deviations alts "
_METRE = math.pi / 180 * 6371008.8
_LOC = "loc hits loc_m banded shr score "


def _walk() -> str:
    parts = ", ".join(f"{_clamp(v)} as f_{k}, {_tone(_clamp(v))} as t_{k}" for k, v in _FACTORS.items())
    stars = {"walker": "score + (case when ped_fat = 0 then 10 else -18 end)", "motorcycle": "score + (0.42::double - peak) * 95", "family": "score + (case when fat = 0 then 6 else -16 end) + (case when hot > 0 then -7 * hot else 10 end)", "night": "score + (0.32::double - night) * 165", "outdoor": "score + (0.32::double - night) * 75 + 6"}
    star = ", ".join(f"{_star(v)} as star_{k}" for k, v in stars.items())
    return f"""select lid, score, {CONFIDENCE} as confidence, n as accidents, cast(fat as bigint) as fat, cast(inj as bigint) as inj, hot, round_even(km, 1) as exposure_km, round_even(risk, 2) as risk, band + 1 as band, {parts}, {star}
        from (select lid, score, score.n, km, risk, band, coalesce(fat, 0) as fat, coalesce(inj, 0) as inj, coalesce(ped_fat, 0) as ped_fat, coalesce(ped, 0)::double as ped, coalesce(large_n, 0)::double as large_n, coalesce(hot, 0) as hot, coalesce(night1, 0.0) as night0,
            case when coalesce(h.n, 0) < 8 then gn else night1 end as night, case when coalesce(h.n, 0) < 8 then gp else peak1 end as peak
            from score left join (select lid, count(*) as n, sum(fat) as fat, sum(inj) as inj, sum(case when fat > 0 and {_mentions(PEDESTRIAN)} then fat else 0 end) as ped_fat, count(*) filter ({_mentions(PEDESTRIAN)}) as ped, count(*) filter ({_mentions(*LARGE)}) as large_n,
                avg(case when hour in {NIGHT} then 1.0 else 0.0 end) as night1, avg(case when hour in {PEAK} then 1.0 else 0.0 end) as peak1 from hits group by lid) h using (lid)
            left join (select lid, count(*) filter (round_even(sqrt(d2), 0) <= 300 and cnt >= 15) as hot from xhits group by lid) using (lid), everywhere)"""


_PAIRS = "rid, rid // 2 as trip, case when rid % 2 = 0 then 'shortest' else 'alternative A' end as label, row_number() over (partition by rid // 2 order by score desc, round_even(km, 1), rid) = 1 as recommended"


def _requests() -> str:
    outside = lambda x, y: f"not ({_within(BOUNDARY).replace('px', x).replace('py', y)})"
    failing = {
        "mode": "mode not in ('walk', 'route')", "walk_point": "mode = 'walk' and (px is null or py is null)", "walk_outside": f"mode = 'walk' and {outside('px', 'py')}",
        "route_points": "mode = 'route' and (fx is null or tx is null)", "route_outside": f"mode = 'route' and ({outside('fx', 'fy')} or {outside('tx', 'ty')})",
        "start_far": "mode = 'route' and a < 0", "end_far": "mode = 'route' and b < 0", "same_node": "mode = 'route' and a = b", "no_path": "mode = 'route' and d is null",
    }
    wrong = "case " + " ".join(f"when {failing[name]} then {k}" for k, (name, *_) in enumerate(REQUEST_ERRORS)) + " end"
    table = ", ".join(f"({k}, '{code}', {status}, '{message}')" for k, (_, code, status, message) in enumerate(REQUEST_ERRORS))
    return q("acc nodes roads edges trips snap dist loc", f"""select qid, mode, code, cast(status as int) as status, message, case when wrong is null and mode = 'walk' then (select count(*) from acc where (px - x) * (px - x) + (py - y) * (py - y) <= 250000) end as accidents,
        case when wrong is null and mode = 'route' then round_even(d, 3) end as length_m from (select *, {wrong} as wrong from (select qid, case when qid % 16 = 3 then 'fly' when qid % 4 = 1 then 'walk' else 'route' end as mode,
        case when qid % 24 <> 9 then px end as px, py, fx, fy, case when qid % 16 <> 4 then tx end as tx, ty, a, b, case when a <> b then d end as d from trips join loc on lid = qid join snap using (qid) left join dist on dist.s = a and dist.v = b))
        left join (values {table}) errors(wrong, code, status, message) using (wrong)""")


def _route(head: str = _PAIRS) -> str:
    return f"""select {head}, score, {CONFIDENCE} as confidence, n as accidents, cast(fat as bigint) as fat, cast(inj as bigint) as inj,
        round_even(km, 1) as km, greatest(2, cast(round_even(km / 24.0 * 60, 0) as int)) as min, round_even(risk, 2) as risk, round_even(dens, 1) as corridor_km, band + 1 as band, hi, total, n_shown, round_even(hi / greatest(km, 0.5) * 10, 0) / 10 as hi_per_km,
        {_star("score + (0.42::double - peak) * 80")} as star_motorcycle, {_star("score + 12 - least(16.0::double, hi / greatest(km, 0.5) * 14)")} as star_car, {_star("score + (0.32::double - night) * 165")} as star_night, {_star("score + 10 - least(30.0::double, hi / greatest(km, 0.5) * 28)")} as star_novice, {_star("score + (case when fat = 0 then 8 else -20 end)")} as star_passenger
        from (select s.*, coalesce(hi, 0) as hi, coalesce(total, 0) as total, coalesce(n_shown, 0) as n_shown, case when coalesce(hn, 0) < 8 then gn else night1 end as night, case when coalesce(hn, 0) < 8 then gp else peak1 end as peak,
            cast(round_even(100.0 * (select count(*) from rbase where rbase.band = s.band and rbase.risk > s.shrunk) / nullif((select count(*) from rbase where rbase.band = s.band), 0), 0) as int) as score
            from (select rid, round_even(km, 6) as km, n, fat, inj, round_even(wsum / km, 6) as risk, dens, b.band, round_even((wsum + 0.5 * coalesce(med, 0.0)) / (round_even(km, 6) + 0.5), 6) as shrunk
                from (select racc.*, dens, cast(coalesce((select max(band) from rinfo where band > 0 and dens >= lo), 0) as int) as band from racc join
                    (select rid, round_even(avg(coalesce(km, 0.0)), 6) as dens from (select rid, pos, sum(len_m * {_k("d2")}) / 1000.0 as km from (select p.rid, p.pos, len_m, (px - x) * (px - x) + (py - y) * (py - y) as d2 from (select * from samples join (select rid, max(pos) as last from samples group by rid) using (rid) where last < 10 or pos % 10 = 0) p left join rseg on (px - x) * (px - x) + (py - y) * (py - y) <= 250000) group by rid, pos) group by rid) using (rid)) b
                left join rinfo on rinfo.band = b.band) s
            left join (select rid, count(*) filter (cnt >= 15) as hi, count(*) as total, count(*) filter (rn <= shown_n) as n_shown from rx group by rid) using (rid)
            left join (select rid, count(*) as hn, avg(case when hour in {NIGHT} then 1.0 else 0.0 end) as night1, avg(case when hour in {PEAK} then 1.0 else 0.0 end) as peak1 from rhits group by rid) using (rid), everywhere)"""


_SHARES = f"select lid, count(*) as n, avg(case when hour in {NIGHT} then 1.0 else 0.0 end) as night, avg(case when hour in {PEAK} then 1.0 else 0.0 end) as peak from hits group by lid"
_SEARCH = f"""from (select qid, pid, count(*) as matched from (select qid, unnest({grams(norm("q"))}) as g from asked) join (select pid, unnest({grams(norm("name"))}) as g from places) using (g) group by qid, pid) join places using (pid)"""


def oracle_sql() -> dict[str, str]:
    c = DEFAULT
    return {
        "kernel_weight": f"select event_id, case when event_id % 700 >= 500 then 0.0 else round_even(greatest(0.0, 1.0 - pow(event_id % 700 / 500.0::double, 2)), 9) end as weight from events",
        "severity": q("acc", "select aid, sev from acc"),
        "split_train": "select o_orderkey, cast(o_orderdate as date) as occurred_on from orders where cast(o_orderdate as date) < date '1998-01-01'",
        "split_test": "select o_orderkey, cast(o_orderdate as date) as occurred_on from orders where cast(o_orderdate as date) >= date '1998-01-01'",
        "walk_density": q("acc loc hits", f"select lid, coalesce(n, 0) as n, round_even(coalesce(wsum, 0.0), 6) as wsum, cast(coalesce(fat, 0) as bigint) as fat, cast(coalesce(inj, 0) as bigint) as inj from loc left join (select lid, count(*) as n, sum(sev * {_k('d2')}) as wsum, sum(fat) as fat, sum(inj) as inj from hits group by lid) using (lid)"),
        "walk_network_km": q("acc roads seg loc hits loc_m", "select lid, round_even(km, 9) as km from loc_m"),
        "walk_risk": q("acc roads seg loc hits loc_m", "select lid, n, round_even(case when km = 0 then null else wsum / km end, 6) as risk from loc_m"),
        "walk_casualties": q("acc loc hits", f"select lid, count(*) as n, cast(sum(fat) as bigint) as fat, cast(sum(inj) as bigint) as inj, cast(sum(case when fat > 0 and {_mentions(PEDESTRIAN)} then fat else 0 end) as bigint) as ped_fat from hits group by lid"),
        "hour_shares": q("acc loc hits everywhere", f"select lid, round_even(case when coalesce(n, 0) < 8 then gn else night end, 9) as night, round_even(case when coalesce(n, 0) < 8 then gp else peak end, 9) as peak from loc left join ({_SHARES}) using (lid), everywhere"),
        "hour_shares_plain": q("acc loc hits", f"select lid, round_even(coalesce(night, 0.0), 9) as night, round_even(coalesce(peak, 0.0), 9) as peak from loc left join ({_SHARES}) using (lid)"),
        "involvement": q("acc loc hits", f"select lid, count(*) filter ({_mentions(PEDESTRIAN)}) as ped, count(*) filter ({_mentions(*LARGE)}) as large from hits group by lid"),
        "monthly_trend": q("acc loc hits", "select loc.lid, strftime(date '2024-07-01' + to_months(cast(m.range as int)), '%Y-%m') as ym, coalesce(h.n, 0) as n, false as partial from loc cross join range(24) m left join (select lid, mi, count(*) as n from hits where mi between 0 and 23 group by all) h on h.lid = loc.lid and h.mi = m.range"),
        "order_trend": "select strftime(o_orderdate, '%Y-%m') as ym, count(*) as n from orders group by 1",
        "confidence_label": q("acc loc hits", f"select lid, {CONFIDENCE} as confidence from (select lid, count(*) as n from hits group by lid)"),
        "nearby_crossings": q("xing loc xhits", "select lid, xid, name, cls, cnt, cast(round_even(sqrt(d2), 0) as int) as dist, round_even(sqrt(d2), 0) <= 300 and cnt >= 15 as hot, cast(rn as int) as rn from (select *, row_number() over (partition by lid order by cnt desc, xid) as rn from xhits) where rn <= 12"),
        "hot_crossings": q("xing loc xhits", "select lid, count(*) filter (round_even(sqrt(d2), 0) <= 300 and cnt >= 15) as hot from xhits group by lid"),
        "crossing_points": q("acc", f"select xid, aid, substr(ymd, 1, 4) || '-' || substr(ymd, 5, 2) || '-' || substr(ymd, 7, 2) || ' ' || substr(hms, 1, 2) || ':' || substr(hms, 3, 2) as occurred_at, category, parties, fat as fatalities, inj as injuries, round_even(x + (cast('0x' || substr(md5(cast(aid as varchar)), 1, 8) as bigint)::double / 4294967295.0 * 2 * {c.jitter} - {c.jitter}), 3) as jx, round_even(y + (cast('0x' || substr(md5(cast(aid as varchar)), 9, 8) as bigint)::double / 4294967295.0 * 2 * {c.jitter} - {c.jitter}), 3) as jy from (select *, row_number() over (partition by xid order by aid) as rn from acc) where rn <= 400"),
        "busiest_crossing": q("xing loc", "select lid, xid, cnt from (select lid, xid, cnt, row_number() over (partition by lid order by cnt desc, xid) as rn from loc join xing on (px - x) * (px - x) + (py - y) * (py - y) <= 90000) where rn = 1"),
        "busiest_points": q("acc xing loc", "select lid, b.xid, aid, fat, inj from (select lid, xid, row_number() over (partition by lid order by cnt desc, xid) as rn from loc join xing on (px - x) * (px - x) + (py - y) * (py - y) <= 90000) b join (select *, row_number() over (partition by xid order by aid) as pn from acc) a on a.xid = b.xid where rn = 1 and pn <= 400"),
        "class_rank": q("xing", "select xid, cls, cnt, round_even(percent_rank() over (partition by cls order by cnt), 6) as rank from xing"),
        "strata": q("roads " + _BASE, "select bid, km, risk, band from base"),
        "baseline_refresh": q("roads " + _BASE, "select bid, km, risk, band from base"),
        "band_median": q("roads " + _BASE, "select band, round_even(med, 6) as med, samples, lo, hi from bandinfo"),
        "shrunk_risk": q("roads " + _BASE + "loc hits loc_m banded shr", "select lid, band, shrunk from shr"),
        "percentile_score": q("roads " + _BASE + _LOC, "select lid, score from score"),
        "stars": q("roads " + _BASE + _LOC, f"select lid, {_star('score')} as stars, {_tone('score')} as tone, case when score < 45 then 'higher risk' when score < 60 then 'medium risk' when score < 80 then 'fairly safe' else 'very safe' end as grade, cast(round(score / 10.0) as int) as bars from score"),
        "walk_report": q("roads " + _BASE + _LOC + "xing xhits everywhere", _walk()),
        "inside_rings": q("acc rings redges", "select aid, coalesce(n, 0) % 2 = 1 as inside from acc left join (select aid, count(*) as n from acc join redges on (ay > y) <> (b_y > y) and x < (bx - ax) * (y - ay) / (b_y - ay) + ax group by aid) using (aid)"),
        "request_results": _requests(),
        "snap_nearest": q("nodes loc", "select lid, coalesce(node, -1) as node, round_even(dist, 6) as dist from loc left join (select lid, arg_min(node, {'d': d2, 'n': node}) as node, sqrt(min(d2)) as dist from (select lid, node, (px - x) * (px - x) + (py - y) * (py - y) as d2 from loc, nodes where (px - x) * (px - x) + (py - y) * (py - y) <= 160000) group by lid) using (lid)"),
        "route_error": q("nodes trips snap", "select qid, case when a < 0 or b < 0 then 'OUT_OF_COVERAGE' when a = b then 'NO_ROUTE' end as code, cast(case when a < 0 or b < 0 then 400 when a = b then 422 end as int) as status, case when a < 0 then 'start' when b < 0 then 'end' when a = b then 'both' end as which from snap"),
        "shortest_distance": q("nodes roads edges trips snap dist", "select qid, d is not null and d <= 30000 as found, round_even(case when d <= 30000 then d end, 3) as length_m from snap left join dist on dist.s = a and dist.v = b where a >= 0 and b >= 0 and a <> b"),
        "overlay_distance": q("nodes roads edges trips snap rdist", "select qid, b as src, a as dst, round_even(d, 3) as length_m from snap join rdist on rdist.s = b and rdist.v = a where a >= 0 and b >= 0 and a <> b"),
        "path_documents": q(_SEARCHED, "select qid, seq, node, x, y from path"),
        "route_path": q(_SEARCHED, f"select qid, seq, round_even({c.origin[0]}::double + y / {_METRE!r}::double, 6) as lat, round_even({c.origin[1]}::double + x / {_METRE * math.cos(math.radians(c.origin[0]))!r}::double, 6) as lon from path"),
        "route_alternatives": q(_SEARCHED + _ALTERNATIVES, "select qid, alt, round_even(d, 3) as length_m, cast(len(nodes) as int) as n_nodes, array_to_string(nodes, ' ') as path from alts"),
        "route_candidates": q(_SEARCHED + _ALTERNATIVES + _RIDE + "xing everywhere altlines segs samples altlens rhits racc rx", "select *, row_number() over (partition by qid order by score desc, km, alt) = 1 as recommended from (" + _route("rid // 3 as qid, cast(rid % 3 as int) as alt, case when rid % 3 = 0 then 'shortest' else 'alternative ' || chr(cast(64 + rid % 3 as int)) end as label") + ")"),
        "route_trend": q("acc " + _SEARCHED + "pathlines segs samples pathlens rhits", "select lens.rid as qid, strftime(date '2024-07-01' + to_months(cast(m.range as int)), '%Y-%m') as ym, coalesce(h.n, 0) as n, false as partial from lens cross join range(24) m left join (select rid, mi, count(*) as n from rhits where mi between 0 and 23 group by all) h on h.rid = lens.rid and h.mi = m.range"),
        "analyze_route": q(_SEARCHED + _RIDE + "xing everywhere pathlines segs samples pathlens rhits racc rx", "select *, printf('%d accidents within 40 m over %.1f km, %d dead, %d injured', accidents, km, fat, inj) as plain, printf('%d of %d crossings on the way had 15 accidents or more', hi, total) as reason, printf('%s confidence from %d accidents', confidence, accidents) as confidence_reason from (" + _route("rid as qid, 'shortest' as label, true as recommended") + ")"),
        "crossing_records": q("xing loc xhits", "select lid, xid, name, cls, cnt, dist, dist <= 300 and cnt >= 15 as hot, cast(rn as int) as rn, rank, printf('%d accidents, distance %d m, %s', cnt, dist, cls) as detail from (select xhits.*, cast(round_even(sqrt(d2), 0) as int) as dist, row_number() over (partition by lid order by cnt desc, xid) as rn from xhits) join (select xid, round_even(percent_rank() over (partition by cls order by cnt), 6) as rank from xing) using (xid) where rn <= 12"),
        "accident_crossing": q("acc xing", f"select aid, b.xid, round_even(dist, 6) as dist from acc left join (select aid, arg_min(xid, {{'d': d2, 'n': xid}}) as xid, sqrt(min(d2)) as dist from (select a.aid, x.xid, (a.x - x.x) * (a.x - x.x) + (a.y - x.y) * (a.y - x.y) as d2 from acc a join xing x on abs(a.x - x.x) <= {c.assign_max} and abs(a.y - x.y) <= {c.assign_max}) where d2 <= {c.assign_max**2} group by aid) b using (aid)"),
        "path_samples": q("lines segs samples", "select rid, pos, round_even(px, 6) as px, round_even(py, 6) as py from samples"),
        "route_accidents": q("acc lines segs samples lens rhits racc", "select rid, round_even(km, 6) as km, n, wsum, cast(fat as bigint) as fat, cast(inj as bigint) as inj, round_even(wsum / km, 6) as risk from racc"),
        "route_crossings": q("xing lines segs samples lens rx", "select rid, xid, name, cls, cnt, first, cast(rn as int) as rn, rn <= shown_n as shown, cnt >= 15 as high, printf('%d accidents, %s', cnt, cls) as detail from rx"),
        "route_best": q("roads " + _RIDE + "xing everywhere lines segs samples lens rhits racc rx", "select trip, rid, label, score, km from (" + _route() + ") where recommended"),
        "route_minutes": q("lines segs lens", "select rid, greatest(2, cast(round_even(km / 24.0 * 60, 0) as int)) as min, round_even(km, 1) as km from lens"),
        "ride_strata": q("roads " + _RIDE, "select bid, km, risk, band from rbase"),
        "route_report": q("roads " + _RIDE + "xing everywhere lines segs samples lens rhits racc rx", _route()),
        "name_normalise": q("places asked", f"select cast(qid as bigint) as id, {norm('q')} as name from asked union all select pid, {norm('name')} from places"),
        "name_search": q("places asked", f"select cast(qid as bigint) as qid, pid, name, matched, cast(rn as int) as rn from (select qid, pid, name, matched, row_number() over (partition by qid order by matched desc, name, pid) as rn {_SEARCH}) where rn <= 8"),
        "name_search_near": q("places asked", f"select cast(qid as bigint) as qid, pid, name, matched, cast(rn as int) as rn from (select qid, pid, name, matched, row_number() over (partition by qid order by matched desc, (x - qx) * (x - qx) + (y - qy) * (y - qy), name, pid) as rn {_SEARCH} join asked using (qid)) where rn <= 8"),
        "jitter": f"select event_id as aid, round_even(cast('0x' || substr(md5(cast(event_id as varchar)), 1, 8) as bigint)::double / 4294967295.0 * 2 * {c.jitter} - {c.jitter}, 6) as dx, round_even(cast('0x' || substr(md5(cast(event_id as varchar)), 9, 8) as bigint)::double / 4294967295.0 * 2 * {c.jitter} - {c.jitter}, 6) as dy from events",
        "dataset_meta": q("roads " + _BASE, "select (select count(*) from acc) as accidents, (select count(*) from part) as intersections, (select round_even(sum(len_m) / 1000, 1) from roads) as walk_network_km, (select count(*) from base) as baseline_cells, (select count(*) from part) as places, '2024-07-01' as range_from, '2026-06-30' as range_to"),
        "inside_boundary": q("loc", f"select lid, {_within(BOUNDARY)} as inside from loc"),
        "name_hash": "select s_suppkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(s_name, ''), lambda ch: cast(ascii(ch) as bigint))), lambda n, ch: (n * 31 + ch) % 997) as h from supplier",
        "worst_factors": q("roads " + _BASE + _LOC + "xing xhits everywhere", "select lid, factor, score, cast(rn as int) as rn from (select *, row_number() over (partition by lid order by score, ord) as rn from (select lid, unnest(['accidents', 'crossings', 'large', 'night', 'pedestrian']) as factor, unnest([f_accidents, f_crossings, f_large, f_night, f_pedestrian]) as score, unnest([0, 1, 2, 3, 4]) as ord from (" + _walk() + "))) where rn <= 2"),
    }
