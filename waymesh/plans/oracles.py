"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .queries import CONFIG, OVERLAP_PAD, PAIR_METERS, PAIR_SLACK_MS

_W = "partition by stream_id, day order by seq"
_SEG = "partition by stream_id, day, seg order by seq"
_SIDE = CONFIG.clustering_threshold / 1.5

POINTS = """with recursive raw as (
  select event_id, user_id % 8 as stream_id, cast(ts as date) as day, event_id + case when event_id % 5 = 0 then 40 else 0 end as seq,
    (epoch_us(ts) % 86400000000) // 1000 as t_ms, value, cast(json_extract(props, '$.k') as int) as k from events),
geo as (select event_id, stream_id, day, seq, t_ms, 55 + floor(value / 25) * 0.02 + (value - floor(value / 25) * 25) / 100000 as lat,
    10 + (k % 4) * 0.02 + floor(k / 4) / 100000 as lon from raw),
points as (select *, 6378137.0 * radians(lon) as x, 6378137.0 * ln(abs(tan(pi() / 4 + radians(lat) / 2))) as y from geo)"""

CLEAN = POINTS + f""",
guarded as (select *, max(t_ms) over ({_W} rows between unbounded preceding and 1 preceding) as latest from points),
clean as (select * from guarded where latest is null or t_ms >= latest)"""

SEGS = CLEAN + f""",
gaps as (select *, t_ms - lag(t_ms) over ({_W}) as gap from clean),
segs as (select event_id, stream_id, day, seq, t_ms, x, y, cast(sum(case when gap > {CONFIG.connection_timeout} then 1 else 0 end)
  over ({_W} rows between unbounded preceding and current row) as bigint) as seg from gaps)"""

TRIPS = SEGS + f""",
trips as (select stream_id, day, seg, min(event_id) as trj_id, count(*) as n, arg_min(x, seq) as xs, arg_min(y, seq) as ys,
  arg_max(x, seq) as xe, arg_max(y, seq) as ye, min(t_ms) as ts, max(t_ms) as te from segs group by all having count(*) >= {CONFIG.min_points}),
eps as (select 2 * trj_id as ep_id, trj_id, xs as x, ys as y, ts as t from trips union all select 2 * trj_id + 1, trj_id, xe, ye, te from trips)"""

PLACES = TRIPS + f""",
cells as (select *, cast(floor(x / {_SIDE!r}) as bigint) as cx, cast(floor(y / {_SIDE!r}) as bigint) as cy from eps),
links as (select distinct a.cx as ax, a.cy as ay, b.cx as bx, b.cy as yb from cells a join cells b
  on abs(a.cx - b.cx) <= 2 and abs(a.cy - b.cy) <= 2 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < {CONFIG.clustering_threshold}),
reach as (select distinct cx as ax, cy as ay, cx as bx, cy as yb from cells
  union select r.ax, r.ay, l.bx, l.yb from reach r join links l on r.bx = l.ax and r.yb = l.ay),
least as (select cx, cy, min(ep_id) as m from cells group by all),
clusters as (select c.ep_id, min(l.m) as cluster_id from cells c join reach r on c.cx = r.ax and c.cy = r.ay
  join least l on r.bx = l.cx and r.yb = l.cy group by all),
nodes as (select cluster_id as node_id, cast(count(*) as int) as weight, min(x) as x1, max(x) as x2, min(y) as y1, max(y) as y2,
  cast(min(t) as double) as t1, cast(max(t) as double) as t2 from eps join clusters using (ep_id) group by all),
edges as (select trj_id as edge_id, s.cluster_id as src, d.cluster_id as dst, cast(n as int) as n, cast(ts as double) as ts, cast(te as double) as te
  from trips join clusters s on s.ep_id = 2 * trj_id join clusters d on d.ep_id = 2 * trj_id + 1)"""

SPLIT = PLACES + """,
lasting as (select * from edges where te > ts),
incident as (select dst as node_id, edge_id, ts, te from lasting union select src, edge_id, ts, te from lasting),
events_of as (select *, row_number() over (partition by node_id order by t, edge_id, is_end) as rn from (
  select node_id, edge_id, ts as t, 0 as is_end, ts as start from incident union all select node_id, edge_id, te, 1, ts from incident)),
fold as (select distinct node_id, 0::bigint as rn, '-infinity'::double as since, null::double as cut from incident
  union all select e.node_id, e.rn, case when e.is_end = 1 and e.start >= f.since then e.t else f.since end,
    case when e.is_end = 1 and e.start >= f.since then e.t end from fold f join events_of e on e.node_id = f.node_id and e.rn = f.rn + 1),
cuts as (select node_id, cut, row_number() over (partition by node_id order by rn) - 1 as cut_no from fold where cut is not null),
moved as (select edge_id, src, (select count(*) from cuts c where c.node_id = l.src and c.cut <= l.ts) as src_slice,
  dst, (select count(*) from cuts c where c.node_id = l.dst and c.cut <= l.te) as dst_slice, ts, te from lasting l)"""

SLICES = SPLIT + """,
ends as (select src || ':' || src_slice as node_id, src as place, src_slice as slice from moved union all
  select dst || ':' || dst_slice, dst, dst_slice from moved),
used as (select node_id, place, slice, count(*) as slice_weight from ends group by all),
opens as (select u.*, coalesce(a.cut, n.t1) as a, coalesce(b.cut, n.t2) as b, n.weight, n.x1, n.x2, n.y1, n.y2 from used u join nodes n on n.node_id = u.place
  left join cuts a on a.node_id = u.place and a.cut_no = u.slice - 1 left join cuts b on b.node_id = u.place and b.cut_no = u.slice)"""

MOTION = SEGS + f""",
steps as (select *, sqrt(power(x - lag(x) over ({_SEG}), 2) + power(y - lag(y) over ({_SEG}), 2)) as step from segs),
ways as (select *, sum(coalesce(step, 0)) over ({_SEG} rows between unbounded preceding and current row) as way from steps),
froms as (select *, max(t_ms) over (partition by stream_id, day, seg order by t_ms range between unbounded preceding and {CONFIG.motion_detector_timespan + 1} preceding) as pt,
  max(way) over (partition by stream_id, day, seg order by t_ms range between unbounded preceding and {CONFIG.motion_detector_timespan + 1} preceding) as pw,
  min(t_ms) over (partition by stream_id, day, seg) as t0 from ways),
spans as (select *, way - coalesce(pw, 0) as dw, t_ms - coalesce(pt, t0) as dt from froms),
moved as (select *, case when dt > 0 then dw / dt * 3600 when dw > 0 then 'infinity'::double end as kmh from spans)"""

STOPS = MOTION + f""",
pushes as (select *, case when coalesce(kmh > {CONFIG.minimum_velocity + CONFIG.epsilon_velocity}, false) then 1 else -1 end as push, row_number() over ({_SEG}) as rn from moved),
fixes as (select *, case when rn = 1 or push = lag(push) over ({_SEG}) then rn end as fix from pushes),
lasts as (select *, max(fix) over ({_SEG} rows between unbounded preceding and current row) as since from fixes),
motions as (select *, case when (rn - since) % 2 = 0 then push else 0 end as motion from lasts),
epochs as (select *, cast(sum(case when motion = -1 then 1 else 0 end) over ({_SEG} rows between unbounded preceding and current row) as bigint) as epoch from motions),
boxes as (select *, greatest(max(x) over w - min(x) over w, max(y) over w - min(y) over w) as side, (max(t_ms) over w - min(t_ms) over w) / 60000.0 as mins, row_number() over w as er
  from epochs window w as (partition by stream_id, day, seg, epoch order by seq rows between unbounded preceding and current row))"""

HAUSDORFF = PLACES + """,
pts as (select e.edge_id, e.src, e.dst, s.x, s.y, s.seq, cast(s.t_ms as double) as t from segs s join trips t using (stream_id, day, seg) join edges e on e.edge_id = t.trj_id),
gaps2 as (select p.edge_id as a, q.edge_id as b, p.seq as ps, q.seq as qs, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d
  from pts p join pts q on p.src = q.src and p.dst = q.dst and p.edge_id < q.edge_id),
there as (select a, b, max(m) as d from (select a, b, ps, min(d) as m from gaps2 group by all) group by all),
back as (select a, b, max(m) as d from (select a, b, qs, min(d) as m from gaps2 group by all) group by all),
hausdorff as (select a, b, greatest(t.d, k.d) as dist from there t join back k using (a, b))"""

#: Both curves of each pair at all times of either in their common span.
CURVES = HAUSDORFF + """,
legs as (select edge_id, x, y, t, lead(x) over w as nx, lead(y) over w as ny, lead(t) over w as nt from pts window w as (partition by edge_id order by seq)),
common as (select a.edge_id as a, b.edge_id as b, greatest(a.ts, b.ts) as s, least(a.te, b.te) as e from edges a join edges b on a.src = b.src and a.dst = b.dst and a.edge_id < b.edge_id),
times as (select a, b, p.t from common join pts p on p.edge_id = a or p.edge_id = b where p.t between s and e union select a, b, s from common where s <= e
  union select a, b, e from common where s <= e),
placed as (select c.a, c.b, c.t, p.x + coalesce((p.nx - p.x) * (c.t - p.t) / (p.nt - p.t), 0) - q.x - coalesce((q.nx - q.x) * (c.t - q.t) / (q.nt - q.t), 0) as dx,
  p.y + coalesce((p.ny - p.y) * (c.t - p.t) / (p.nt - p.t), 0) - q.y - coalesce((q.ny - q.y) * (c.t - q.t) / (q.nt - q.t), 0) as dy from times c
  join legs p on p.edge_id = c.a and p.t <= c.t and (p.nt > c.t or p.nt is null) join legs q on q.edge_id = c.b and q.t <= c.t and (q.nt > c.t or q.nt is null)),
strips as (select a, b, dx as u, dy as v, lead(dx) over w as u2, lead(dy) over w as v2, lead(t) over w - t as dt from placed window w as (partition by a, b order by t)),
dissim as (select c.a, c.b, coalesce(sum((sqrt(u * u + v * v) + sqrt(u2 * u2 + v2 * v2)) / 2 * dt), 0) as dissim from common c left join strips using (a, b) group by all)"""


def _strip(u: str, v: str) -> str:
    return f"case when {u} * {v} < 0 then ({u} * {u} + {v} * {v}) / (2 * (abs({u}) + abs({v}))) else (abs({u}) + abs({v})) / 2 end"


SHAPES = CURVES + f""",
alike as (select a, b from hausdorff where dist < {CONFIG.max_hausdorff_meters}),
both_ways as (select a, b from alike union all select b, a from alike),
same_shape as (select edge_id as a, edge_id as b from edges union select s.a, w.b from same_shape s join both_ways w on w.a = s.b),
shapes as (select a as edge_id, min(b) as cluster_id from same_shape group by a)"""

#: Rounds of the merge of boxes that SQL spells out: more than the data of the tests need.
ROUNDS = 5


def _merge_round(k: int) -> str:
    return f""",
pair{k} as (select a.node_id as a, b.node_id as b from hull{k} a join hull{k} b on a.node_id <> b.node_id where greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))
  * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= 0.5 * least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1))),
met{k} as (select node_id as a, node_id as b from hull{k} union select m.a, p.b from met{k} m join pair{k} p on p.a = m.b),
member{k + 1} as (select m.node_id, least.to_id as cluster_id from member{k} m join (select a, min(b) as to_id from met{k} group by a) least on least.a = m.cluster_id),
hull{k + 1} as (select cluster_id as node_id, min(x1) as x1, max(x2) as x2, min(y1) as y1, max(y2) as y2, min(t1) as t1, max(t2) as t2
  from member{k + 1} join hull0 using (node_id) group by cluster_id)"""


MERGED = PLACES + f""",
hull0 as (select node_id, x1 - {OVERLAP_PAD / 2} as x1, x2 + {OVERLAP_PAD / 2} as x2, y1 - {OVERLAP_PAD / 2} as y1, y2 + {OVERLAP_PAD / 2} as y2, t1, t2 from nodes),
member0 as (select node_id, node_id as cluster_id from nodes)""" + "".join(_merge_round(k) for k in range(ROUNDS))

_SIDES = ", ".join(f"round({s}, 3) as {s}" for s in ("x1", "x2", "y1", "y2"))
_WEIGHT = (86_400_000 - PAIR_SLACK_MS) / 1000.0
_READ = "round(lat, 8) as lat, round(lon, 8) as lon"


def _read(first: int, t: str = "t_ms") -> str:
    return POINTS + f"""
select stream_id || '/' || day as source, day, row_number() over (partition by stream_id, day order by seq) - 1 + {first} as seq, {_READ}, {t} as t_ms from points"""


ORACLES: dict[str, str] = {
    "project_points": POINTS + " select event_id, round(x, 3) as x, round(y, 3) as y, t_ms from points",
    "unproject_points": POINTS + f" select event_id, {_READ} from points",
    "time_guard": CLEAN + " select event_id, stream_id, t_ms from clean",
    "day_runs": POINTS + """,
flags as (select *, case when day <> lag(day) over (partition by stream_id order by seq) then 1 else 0 end as new from points)
select event_id, stream_id, cast(sum(new) over (partition by stream_id order by seq rows between unbounded preceding and current row) as bigint) as run from flags""",
    "timeout_segments": SEGS + " select event_id, stream_id, seg, t_ms from segs",
    "alive_flags": CLEAN + f" select event_id, coalesce(t_ms - lag(t_ms) over ({_W}) < {CONFIG.connection_timeout}, true) as is_alive from clean",
    "segment_summary": SEGS + f"""
select stream_id, day, seg, n, start_t, end_t, {_SIDES}, t1, t2 from (
  select stream_id, day, seg, count(*) as n, cast(arg_min(t_ms, seq) as double) as start_t, cast(arg_max(t_ms, seq) as double) as end_t, min(x) as x1, max(x) as x2,
    min(y) as y1, max(y) as y2, cast(min(t_ms) as double) as t1, cast(max(t_ms) as double) as t2 from segs group by all)""",
    "path_stats": TRIPS + """
select count(*) as trips, cast(min(n) as int) as shortest, cast(list_sort(list(n))[count(*) // 2 + 1] as int) as median, cast(max(n) as int) as longest from trips""",
    "endpoint_pairs": TRIPS + f"""
select i, j, round(dist, 3) as dist from (select a.ep_id as i, b.ep_id as j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
  + {_WEIGHT!r} * cast(a.t - b.t as double) * (a.t - b.t)) as dist from eps a join eps b on a.ep_id < b.ep_id and abs(a.x - b.x) < {PAIR_METERS}) where dist < {PAIR_METERS}""",
    "endpoint_clusters": PLACES + " select ep_id, cluster_id from clusters",
    "node_table": PLACES + f" select node_id, weight, {_SIDES}, t1, t2 from nodes",
    "edge_table": PLACES + " select edge_id, src, dst, n from edges",
    "edge_groups": PLACES + " select src, dst, count(*) as n, count(*) as weight from edges group by all",
    "temporal_splits": SPLIT + " select node_id, cast(cut_no as int) as cut_no, cut from cuts",
    "split_edges": SPLIT + " select edge_id, src, cast(src_slice as int) as src_slice, dst, cast(dst_slice as int) as dst_slice from moved",
    "split_nodes": SLICES + f" select node_id, weight, slice_weight, {_SIDES}, least(a, b) as t1, greatest(a, b) as t2 from opens",
    "roots": SLICES + " select node_id from used where node_id not in (select dst || ':' || dst_slice from moved where (src, src_slice) <> (dst, dst_slice))",
    "isolated_nodes": SPLIT + """ select node_id, weight from nodes where node_id not in (select src from lasting where dst < src union select dst from lasting where dst < src)""",
    "loops": PLACES + " select edge_id, src from edges where src = dst",
    "monotonicity_violations": PLACES + " select edge_id, src, dst, ts as starts, t1 as opens from edges join nodes on node_id = dst where ts >= t1",
    "split_violations": SPLIT + """
select 'slices' as graph, edge_id from (select distinct a.edge_id from moved a join moved b on b.src = a.dst and b.src_slice = a.dst_slice
  where b.ts <= a.ts or (a.src = a.dst and a.src_slice = a.dst_slice))
union all select 'places', edge_id from (select distinct a.edge_id from lasting a join lasting b on b.src = a.dst where b.ts <= a.ts or a.src = a.dst)""",
    "reachability_in_time": PLACES + """,
walk as (select min(src) as node_id, '-infinity'::double as opens from edges
  union select e.dst, greatest(w.opens, n.t1) from walk w join edges e on e.src = w.node_id and e.src <> e.dst join nodes n on n.node_id = e.dst)
select node_id, opens from (select node_id, min(opens) as opens from walk group by 1) join nodes using (node_id) where opens <= t2""",
    "constraint_report": PLACES + """,
ways as (select distinct src, dst from edges where src < dst),
firsts as (select node_id from nodes order by node_id limit 2),
walk as (select node_id, '-infinity'::double as opens from firsts
  union select e.dst, greatest(w.opens, n.t1) from walk w join ways e on e.src = w.node_id join nodes n on n.node_id = e.dst),
met as (select node_id from (select node_id, min(opens) as opens from walk group by 1) join nodes using (node_id) where opens <= t2),
flags as (select node_id, node_id in (select node_id from firsts) as is_root, node_id not in (select dst from ways) as is_orphan, node_id in (select node_id from met) as is_reachable from nodes)
select *, is_root = is_orphan and is_reachable as is_valid from flags""",
    "pruned_graph": PLACES + """
select node_id, weight, node_id not in (select dst from edges e join nodes a on a.node_id = e.src and a.weight >= 40 join nodes b on b.node_id = e.dst and b.weight >= 40
  where src < dst) as is_root from nodes where weight >= 40""",
    "minimal_boxes": PLACES + f""",
ends as (select e.src as node_id, t.xs as x, t.ys as y from edges e join trips t on t.trj_id = e.edge_id union all select e.dst, t.xe, t.ye from edges e join trips t on t.trj_id = e.edge_id),
tight as (select node_id, min(x) - 1 as x1, max(x) + 1 as x2, min(y) - 1 as y1, max(y) + 1 as y2 from ends group by 1)
select m.node_id, {", ".join(f"round(m.{c}, 3) as {c}" for c in ("x1", "x2", "y1", "y2"))}, n.t1, n.t2 from tight m join nodes n using (node_id)""",
    "edge_boxes": PLACES + """,
own as (select trj_id, count(*) = 1 or bool_and(coalesce(t_ms > before, true)) as monotone, min(x) as x1, max(x) as x2, min(y) as y1, max(y) as y2
  from (select t.trj_id, s.*, lag(t_ms) over (partition by t.trj_id order by s.seq) as before from segs s join trips t using (stream_id, day, seg)) group by 1),
pairs as (select e.edge_id, a.x1 as ax1, a.x2 as ax2, a.y1 as ay1, a.y2 as ay2, a.t1 as at1, a.t2 as at2, b.x1 as bx1, b.x2 as bx2, b.y1 as by1, b.y2 as by2, b.t1 as bt1, b.t2 as bt2,
  t.xe as x, t.ye as y, cast(t.te as double) as t, o.x1 as ox1, o.x2 as ox2, o.y1 as oy1, o.y2 as oy2, o.monotone, least(a.x1, b.x1) as ux1, greatest(a.x2, b.x2) as ux2, least(a.y1, b.y1) as uy1,
  greatest(a.y2, b.y2) as uy2 from edges e join nodes a on a.node_id = e.src join nodes b on b.node_id = e.dst join trips t on t.trj_id = e.edge_id join own o on o.trj_id = e.edge_id)
select edge_id, x between ax1 and ax2 and y between ay1 and ay2 and t between at1 and at2 as contains, t between at1 and at2 as in_time, x between ax1 and ax2 and y between ay1 and ay2 as in_space,
  at2 < bt1 as before, at1 = at2 as single, greatest(ux2 - ux1, uy2 - uy1) < 5000 as fits_space, (at2 - at1) / 60000 > 600 as fits_time,
  greatest(greatest(ax2, ox2) - least(ax1, ox1), greatest(ay2, oy2) - least(ay1, oy1)) < 5000 as can_contain, at1 < bt1 or at1 = bt1 and at2 < bt2 as sooner,
  round(ux1, 3) as union_x1, greatest(at2, bt2) as union_t2, round(greatest(ax2, x), 3) as grown_x2, round(least(ay1, y), 3) as grown_y1, round(greatest(ux2 - ux1, uy2 - uy1), 3) as longest,
  round(-least(ux2 - ux1, uy2 - uy1), 3) as shortest, round((ux2 - ux1) * (uy2 - uy1), 3) as area, greatest(at1, t) as first_t2, least(t + 1, at2) as second_t1, monotone,
  printf('%02d:%02d:%02d', t::bigint // 3600000, t::bigint // 60000 % 60, t::bigint // 1000 % 60) as clock from pairs""",
    "graph_dot": PLACES + """
select 0 as part, 'digraph {' as value union all select 3, '}' union all select 1, '    "' || node_id || '"' from nodes
union all select 2, '    "' || src || '" -> "' || dst || '" [ label = "' || edge_id || '" ]' from edges""",
    "graph_json": PLACES + """
select 'node' as kind, node_id::varchar as id, '' as src, '' as dst, weight, round(x1, 3) as x1, -1 as n from nodes
union all select 'edge', edge_id::varchar, src::varchar, dst::varchar, 1, 0.0, n from edges""",
    "nodes_csv": PLACES + f" select node_id::varchar as label, weight, {_SIDES}, t1, t2, false as has_exponent from nodes",
    "edges_csv": PLACES + """
select e.edge_id, e.src::varchar as src, e.dst::varchar as dst, 1 as weight, cast(row_number() over (partition by e.edge_id order by s.seq) - 1 as int) as pos, round(s.x, 3) as x,
  round(s.y, 3) as y, cast(s.t_ms as double) as t from segs s join trips t using (stream_id, day, seg) join edges e on e.edge_id = t.trj_id""",
    "run_counters": SHAPES + SPLIT.removeprefix(PLACES) + """,
used_slices as (select src as place, src_slice as slice from moved union select dst, dst_slice from moved)
select (select count(*) from nodes) as spatial_clusters, 2 * (select count(*) from edges) - (select count(*) from nodes) as node_merges,
  (select count(*) from used_slices) - (select count(*) from nodes) as node_splits, (select count(*) from edges) - (select count(distinct cluster_id) from shapes) as edge_merges""",
    "read_gpx_strict": _read(0),
    "reachability": PLACES + """,
walk as (select min(src) as node_id, 0 as steps from edges union select e.dst, w.steps + 1 from walk w join edges e on e.src = w.node_id where w.steps < 60)
select node_id, min(steps) as steps from walk group by node_id""",
    "motion_velocity": MOTION + " select event_id, round(kmh, 3) as kmh from moved",
    "stop_epochs": STOPS + f"""
select event_id, motion, epoch, case when er = 1 then -1 when side < {CONFIG.bbox_max_meters} and mins > {CONFIG.bbox_min_minutes} then 1
  when side < {CONFIG.bbox_max_meters} then 0 else -1 end as stop from boxes""",
    "hausdorff_pairs": HAUSDORFF + " select a, b, round(dist, 3) as dist from hausdorff",
    "dissim_pairs": CURVES + " select a, b, round(dissim / 1e6, 3) as dissim from dissim",
    "area_pairs": CURVES + f"""
select c.a, c.b, round(coalesce(sum(({_strip("u", "u2")} + {_strip("v", "v2")}) * dt), 0) / 1e6, 3) as area from common c left join strips using (a, b) group by all""",
    "shape_clusters": SHAPES + " select edge_id, cluster_id from shapes",
    "medoid_edges": SHAPES + """,
totals as (select edge_id, sum(dissim) as total from (select a as edge_id, a, b, dissim from dissim union all select b, a, b, dissim from dissim) d
  join shapes s using (edge_id) where (select cluster_id from shapes where edge_id = a) = (select cluster_id from shapes where edge_id = b) group by 1),
ranked as (select edge_id, src, dst, count(*) over w as weight, row_number() over (w order by round(coalesce(total, 0)), edge_id) as rn
  from edges join shapes using (edge_id) left join totals using (edge_id) window w as (partition by src, dst, cluster_id))
select edge_id, src, dst, cast(weight as int) as weight from ranked where rn = 1""",
    "merged_boxes": MERGED + f""" select m.node_id, m.cluster_id, {_SIDES}, h.t1, h.t2 from member{ROUNDS} m join hull{ROUNDS} h on h.node_id = m.cluster_id""",
    "bbox_overlap": PLACES + f""",
wide as (select node_id, x1 - {OVERLAP_PAD} as x1, x2 + {OVERLAP_PAD} as x2, y1 - {OVERLAP_PAD} as y1, y2 + {OVERLAP_PAD} as y2 from nodes)
select i, j, round(share, 6) as share from (select a.node_id as i, b.node_id as j, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
  / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) as share from wide a join wide b on a.node_id < b.node_id) where share >= 0.5""",
    "read_gpx": _read(0),
    "read_plt": _read(3),
    "read_ais": _read(1, "t_ms // 1000 * 1000"),
    "read_synthetic": _read(1),
}
