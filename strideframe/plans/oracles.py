"""DuckDB SQL for the queries of the catalogue, written against the raw tables."""

from __future__ import annotations

import numpy as np

from strideframe.functions import skeleton as sk
from strideframe.functions.signal import PAD, butterworth
from strideframe.operators.calibration import LANDMARKS
from strideframe.plans.catalogue import H

SQL: dict[str, str] = {}


def r(value: str, name: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0.0e0 AS {name}"


POSE = "SELECT 0::BIGINT AS clip_id, vec_id // 50 AS track_id, vec_id % 50 + 1 AS frame_index, vec_id AS det_id, " + ", ".join(f"640 + 600 * embedding[{2 * j + 1}]::DOUBLE AS x{j}, 360 + 600 * embedding[{2 * j + 2}]::DOUBLE AS y{j}, least(1.0e0, 6 * abs(embedding[{35 + j}]::DOUBLE)) AS c{j}" for j in range(17)) + " FROM embeddings"


def dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(power({ax} - {bx}, 2) + power({ay} - {by}, 2))"


def mid(a: str, b: str) -> str:
    return f"coalesce(({a} + {b}) / 2, {a}, {b})"


def _angle(a: int, b: int, c: int) -> str:
    sides = f"({dist(f'x{a}', f'y{a}', f'x{b}', f'y{b}')} * {dist(f'x{c}', f'y{c}', f'x{b}', f'y{b}')})"
    dot = f"((x{a} - x{b}) * (x{c} - x{b}) + (y{a} - y{b}) * (y{c} - y{b}))"
    return f"CASE WHEN {sides} > 0 THEN degrees(acos(greatest(-1.0e0, least(1.0e0, {dot} / {sides})))) END"


#: Joints that are sure enough, then the features of a frame.
SURE = "SELECT clip_id, track_id, frame_index, det_id, " + ", ".join(f"CASE WHEN c{j} >= 0.2 THEN {a}{j} END AS {a}{j}" for j in range(17) for a in "xy") + ", " + ", ".join(f"c{j}" for j in range(17)) + " FROM pose"
_W = {5: "0.15e0", 6: "0.15e0", 11: "0.35e0", 12: "0.35e0"}
_SUM = " + ".join(f"CASE WHEN x{j} IS NOT NULL THEN {w} ELSE 0.0e0 END" for j, w in _W.items())
CHAIN = "SELECT *, " + ", ".join(f"{mid(f'{a}{p}', f'{a}{q}')} AS m{a}{n}" for n, (p, q) in {"s": (5, 6), "h": (11, 12), "k": (13, 14), "a": (15, 16)}.items() for a in "xy") + " FROM sure"
_SEG = (("x0", "y0", "mxs", "mys", "0.12e0"), ("mxs", "mys", "mxh", "myh", "0.29e0"), ("mxh", "myh", "mxk", "myk", "0.245e0"), ("mxk", "myk", "mxa", "mya", "0.246e0"))
SEGMENTS = "SELECT *, " + ", ".join(f"{dist(*s[:4])} AS d{i}" for i, s in enumerate(_SEG)) + " FROM chain"
_LEN, _SHARE = " + ".join(f"coalesce(d{i}, 0)" for i in range(4)), " + ".join(f"CASE WHEN d{i} IS NOT NULL THEN {s[4]} ELSE 0.0e0 END" for i, s in enumerate(_SEG))
_TRUNK = "x5 IS NOT NULL AND x6 IS NOT NULL AND x11 IS NOT NULL AND x12 IS NOT NULL"
_DX, _DY = "((x5 + x6) / 2 - (x11 + x12) / 2)", "((y11 + y12) / 2 - (y5 + y6) / 2)"
FEATURES = f"""SELECT clip_id, track_id, frame_index, det_id,
  ({" + ".join(f"coalesce(x{j} * {w}, 0)" for j, w in _W.items())}) / nullif({_SUM}, 0) AS com_x, ({" + ".join(f"coalesce(y{j} * {w}, 0)" for j, w in _W.items())}) / nullif({_SUM}, 0) AS com_y,
  CASE WHEN ({_LEN}) / nullif({_SHARE}, 0) >= 20 THEN ({_LEN}) / nullif({_SHARE}, 0) END AS height_px,
  CASE WHEN {_TRUNK} AND ({_DX} <> 0 OR {_DY} <> 0) THEN degrees(atan2({_DX}, CASE WHEN {_DY} = 0 THEN 1e-9 ELSE abs({_DY}) END)) END AS lean_deg,
  CASE WHEN {_TRUNK} THEN (y11 + y12) / 2 END AS midhip_y, least(y9, y10) AS min_wrist_y, {mid("y9", "y10")} AS mean_wrist_y, mya AS ankle_y, mxa AS feet_x, mya AS feet_y,
  ({" + ".join(f"c{j}" for j in range(17))}) / 17 AS mean_conf, {dist("x5", "y5", "x6", "y6")} AS shoulder_px, {dist("x15", "y15", "x16", "y16")} AS ankle_gap_px, CASE WHEN {_TRUNK} THEN {dist("x9", "y9", "x10", "y10")} END AS wrist_gap_px,
  {_angle(11, 13, 15)} AS left_knee_deg, {_angle(12, 14, 16)} AS right_knee_deg, {_angle(5, 11, 13)} AS left_hip_deg, {_angle(6, 12, 14)} AS right_hip_deg,
  x15, y15, c15, x16, y16, c16
  FROM segments"""
BASE = f"pose AS ({POSE}), sure AS ({SURE}), chain AS ({CHAIN}), segments AS ({SEGMENTS}), features AS ({FEATURES})"

# Dives: the same closed form as the adapter's, then the same features.
_STEPS = (
    ("side", "CASE WHEN k % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END AS side, greatest(0.0e0, least(1.0e0, (f - (40.0e0 + k % 7)) / 20.0e0)) AS u, 300.0e0 + k % 5 AS h"),
    ("p", "u * u * (3 - 2 * u) AS p"),
    ("hip", "320.0e0 + 10 * (k % 20) + side * (220 + 5.0e0 * (k % 9)) * p + 1.5e0 * sin(0.9e0 * f + k) AS hx, 340.0e0 - 40 * sin(pi() * p) + 0.35e0 * h * p * p + 0.06e0 * h AS hy, radians(55.0e0 * side * p) AS tilt, radians(12.5e0 * (1 - p)) AS bend, least(1.0e0, 1.4e0 * p) AS arm"),
    ("knee", "hx + 0.35e0 * h * sin(tilt) AS sx, hy - 0.35e0 * h * cos(tilt) AS sy, hx + 0.47e0 * h * sin(tilt) AS nx, hy - 0.47e0 * h * cos(tilt) AS ny, hx - 0.22e0 * h * sin(tilt - bend) AS kx, hy + 0.22e0 * h * cos(tilt - bend) AS ky"),
    ("ankle", "kx - 0.22e0 * h * sin(tilt + bend) AS ax, ky + 0.22e0 * h * cos(tilt + bend) AS ay, sy + 0.31e0 * h * (1 - 2 * arm) AS wy"),
)
_JOINTS = {j: ("nx", "ny") for j in range(5)} | {a + s: (f"{x} {'-+'[s]} {w}e0 * h", y) for a, x, y, w in ((5, "sx", "sy", 0.1), (7, "sx", "(sy + wy) / 2", 0.12), (9, "sx", "wy", 0.14), (11, "hx", "hy", 0.06), (13, "kx", "ky", 0.07), (15, "ax", "ay", 0.12)) for s in (0, 1)}
_inner = "SELECT s_suppkey::BIGINT AS k, f FROM supplier, range(120) t(f)"
for _name, _sql in _STEPS:
    _inner = f"SELECT *, {_sql} FROM ({_inner})"
DIVE_POSE = "SELECT k AS clip_id, 0::BIGINT AS track_id, f AS frame_index, 0::BIGINT AS det_id, " + ", ".join(f"{_JOINTS[j][0]} AS x{j}, {_JOINTS[j][1]} AS y{j}, 0.95e0 - 0.001e0 * (f % 7) AS c{j}" for j in range(17)) + f" FROM ({_inner})"
DIVE_BASE = BASE.replace(POSE, DIVE_POSE)

USABLE = "usable AS (SELECT * FROM features WHERE com_x IS NOT NULL AND height_px > 0)"
SIGNAL = "sig AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) / 1000000 - 1.7e9 AS t, value AS v FROM events)"
GOAL = "(com_x - 486) / 100.0e0 AS lateral_m, (com_y - 300) / 100.0e0 AS depth_m, 0.5e0 + (com_x - 486) / 100.0e0 / 7.32e0 AS coverage, abs((com_x - 486) / 100.0e0) <= 3.66e0 + 5.5e0 AND (com_y - 300) / 100.0e0 BETWEEN 0 AND 5.5e0 AS in_area, abs((com_x - 486) / 100.0e0) <= 3.66e0 + 5.5e0 AS in_mouth"


def simple(name: str, columns: str, source: str = "features", base: str = BASE, where: str = "") -> None:
    SQL[name] = f"WITH {base} SELECT {columns} FROM {source} {where}"


def step(w: str) -> str:
    return f"coalesce({dist('com_x', 'com_y', f'lag(com_x) OVER {w}', f'lag(com_y) OVER {w}')}, 0)"


def uneven(v: str, at: str, w: str) -> str:
    hs, hd = f"({at} - lag({at}) OVER {w})", f"(lead({at}) OVER {w} - {at})"
    f, b = f"lead({v}) OVER {w}", f"lag({v}) OVER {w}"
    return f"CASE WHEN {hs} IS NULL THEN ({f} - {v}) / {hd} WHEN {hd} IS NULL THEN ({v} - {b}) / {hs} ELSE ({hs} * {hs} * {f} + ({hd} * {hd} - {hs} * {hs}) * {v} - {hd} * {hd} * {b}) / ({hs} * {hd} * ({hd} + {hs})) END"


def even(v: str, h: str, w: str) -> str:
    return f"coalesce((lead({v}) OVER {w} - lag({v}) OVER {w}) / (2 * {h}), (lead({v}) OVER {w} - {v}) / {h}, ({v} - lag({v}) OVER {w}) / {h}, 0)"


# Boxes.
_BOX = "SELECT l_orderkey::BIGINT AS frame_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det_id, (l_partkey % 97)::DOUBLE AS x1, (l_suppkey % 53)::DOUBLE AS y1, (l_partkey % 97 + l_quantity * 2)::DOUBLE AS x2, (l_suppkey % 53 + l_extendedprice % 100)::DOUBLE AS y2, 1 - l_discount AS mean_conf FROM lineitem"
BOXES = f"box AS (SELECT *, greatest(0, x2 - x1) AS w, greatest(0, y2 - y1) AS h FROM ({_BOX})), pairs AS (SELECT a.frame_index, a.det_id AS a_id, b.det_id AS b_id, a.w * a.h AS aa, b.w * b.h AS ba, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, {dist('(a.x1 + a.x2) / 2', '(a.y1 + a.y2) / 2', '(b.x1 + b.x2) / 2', '(b.y1 + b.y2) / 2')} AS gap, (sqrt(a.w * a.w + a.h * a.h) + sqrt(b.w * b.w + b.h * b.h)) / 2 AS scale FROM box a JOIN box b ON a.frame_index = b.frame_index AND a.det_id < b.det_id)"
simple("bbox_props", f"frame_index, det_id, {r('w', 'width')}, {r('h', 'height')}, {r('w * h', 'area')}, {r('(x1 + x2) / 2', 'cx')}, {r('(y1 + y2) / 2', 'cy')}", "box", BOXES)
simple("bbox_iou", f"frame_index, a_id, b_id, {r('CASE WHEN aa + ba - i > 0 THEN i / (aa + ba - i) ELSE 0 END', 'iou')}", "pairs", BOXES)
simple("bbox_containment", f"frame_index, a_id, b_id, {r('CASE WHEN least(aa, ba) > 0 THEN i / least(aa, ba) ELSE 0 END', 'containment')}, {r('coalesce(CASE WHEN gap / nullif(scale, 0) < 1.5 THEN 1 - gap / nullif(scale, 0) / 1.5 END, 0)', 'affinity')}", "pairs", BOXES)
# Duplicates by recursion over the rank of confidence: a box stays unless a kept one of its frame covers it.
SQL["dedup_detections"] = f"""WITH RECURSIVE {BOXES}, ordered AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY mean_conf DESC, det_id) AS n FROM box),
  kept AS (SELECT frame_index, 1::BIGINT AS n, [n] AS ids FROM ordered WHERE n = 1
    UNION ALL SELECT k.frame_index, o.n, CASE WHEN EXISTS (SELECT 1 FROM ordered q WHERE q.frame_index = o.frame_index AND list_contains(k.ids, q.n) AND (
        (SELECT greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1))) / nullif(q.w * q.h + o.w * o.h - greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1)), 0) > 0.6
        OR greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1)) / nullif(least(q.w * q.h, o.w * o.h), 0) > 0.8)) THEN k.ids ELSE list_append(k.ids, o.n) END
      FROM kept k JOIN ordered o ON o.frame_index = k.frame_index AND o.n = k.n + 1),
  last AS (SELECT frame_index, arg_max(ids, n) AS ids FROM kept GROUP BY frame_index)
  SELECT o.frame_index, o.det_id, list_position(l.ids, o.n)::BIGINT - 1 AS rank, {r('o.mean_conf', 'mean_conf')} FROM ordered o JOIN last l USING (frame_index) WHERE list_contains(l.ids, o.n)"""

# Single frames.
_GATHER = sk.layout("mediapipe33").gather()
SQL["canonical_remap"] = " UNION ALL ".join(f"SELECT vec_id, {j}::BIGINT AS joint, {r(f'embedding[{i + 1}]::DOUBLE', 'x')}, {r(f'embedding[{i + 32}]::DOUBLE', 'y')}, {r(f'abs(embedding[{i + 1}]::DOUBLE)', 'conf')} FROM embeddings" for j, i in enumerate(_GATHER))
simple("visible_joints", f"det_id, ({' + '.join(f'(c{j} >= 0.3)::BIGINT' for j in range(17))})::BIGINT AS n_visible, {' || '.join(f'(c{j} >= 0.3)::INT::VARCHAR' for j in range(17))} AS mask", "pose")
_MEAN = f"({' + '.join(f'c{j}' for j in range(17))}) / 17"
simple("mean_conf_filter", f"det_id, {r(_MEAN, 'mean_conf')}", "pose", where=f"WHERE {_MEAN} >= 0.4")
simple("joint_projection", f"det_id, {r('CASE WHEN c0 >= 0.3 THEN x0 END', 'nose_x')}, {r('CASE WHEN c0 >= 0.3 THEN y0 END', 'nose_y')}, NULL::DOUBLE AS absent_x", "pose")
_LOW, _HIGH = ({a: f"{f}({', '.join(f'{a}{j}' for j in range(17))})" for a in "xy"} for f in ("least", "greatest"))
simple("keypoint_box", "det_id, " + ", ".join(r(f"{e[a]} {s} 0.1e0 * ({_HIGH[a]} - {_LOW[a]})", f"{a}{n}") for n, e, s in ((1, _LOW, "-"), (2, _HIGH, "+")) for a in "xy") + ", 1.0e0 AS score", "pose")
_PAD = {a: f"0.15e0 * ({_HIGH[a]} - {_LOW[a]})" for a in "xy"}
_EDGE = {"x1": f"greatest(0, trunc({_LOW['x']} - {_PAD['x']}))", "y1": f"greatest(0, trunc({_LOW['y']} - {_PAD['y']}))", "x2": f"least(1280, trunc({_HIGH['x']} + {_PAD['x']}))", "y2": f"least(720, trunc({_HIGH['y']} + {_PAD['y']}))"}
simple("crop_rectangle", "det_id, " + ", ".join(f"(CASE WHEN {_EDGE['x2']} > {_EDGE['x1']} AND {_EDGE['y2']} > {_EDGE['y1']} THEN {v} ELSE 0 END)::BIGINT AS {n}" for n, v in _EDGE.items()), "pose")
simple("com_per_frame", f"track_id, frame_index, {r('com_x', 'com_x')}, {r('com_y', 'com_y')}")
simple("body_height", f"track_id, frame_index, {r('height_px', 'height_px')}, {r('CASE WHEN height_px > 0 THEN 1.8e0 / height_px END', 'm_per_px')}")
simple("feet_position", f"track_id, frame_index, {r('feet_x', 'feet_x')}, {r('feet_y', 'feet_y')}")
_E = lambda i: f"embedding[{i + 1}]::DOUBLE"
SQL["root_relative"] = " UNION ALL ".join(f"SELECT vec_id, {j}::BIGINT AS joint, " + ", ".join(r(f"{_E(3 * j + n)} - ({_E(33 + n)} + {_E(36 + n)}) / 2", a) for n, a in enumerate("xyz")) + " FROM embeddings" for j in range(17))
simple("joint_angles", "track_id, frame_index, " + ", ".join(r(c, c) for c in ("left_knee_deg", "right_knee_deg", "left_hip_deg", "right_hip_deg")))
simple("trunk_lean", f"track_id, frame_index, {r('lean_deg', 'lean_deg')}")
STANCE = f"""stance AS (SELECT track_id, frame_index, height_px, CASE WHEN shoulder_px > 0 AND height_px > 0 THEN ankle_gap_px / shoulder_px END AS stance_width_ratio, CASE WHEN shoulder_px > 0 AND height_px > 0 THEN wrist_gap_px / shoulder_px END AS hand_width_ratio,
  CASE WHEN height_px > 0 THEN {mid('left_knee_deg', 'right_knee_deg')} END AS mean_knee_deg, CASE WHEN height_px > 0 THEN abs(lean_deg) END AS trunk_flexion_deg, CASE WHEN height_px > 0 THEN (midhip_y - mean_wrist_y) / height_px END AS hand_height_ratio, CASE WHEN height_px > 0 THEN (ankle_y - com_y) / height_px END AS com_height_ratio FROM features)"""
simple("stance_metrics", "track_id, frame_index, " + ", ".join(r(c, c) for c in ("stance_width_ratio", "hand_width_ratio", "mean_knee_deg", "trunk_flexion_deg", "hand_height_ratio", "com_height_ratio")) + ", height_px IS NOT NULL AND stance_width_ratio IS NOT NULL AS is_valid", "stance", f"{BASE}, {STANCE}")
_FLAGS = (("height_px IS NULL", "no_height"), ("mean_knee_deg > 165", "legs_straight"), ("mean_knee_deg < 130", "legs_deep"), ("stance_width_ratio > 1.7", "feet_wide"), ("stance_width_ratio < 0.9", "feet_narrow"), ("trunk_flexion_deg > 30", "trunk_folded"), ("trunk_flexion_deg < 5", "trunk_upright"), ("hand_height_ratio < -0.02", "hands_low"))
simple("stance_flags", f"track_id, frame_index, concat_ws(',', {', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for c, n in _FLAGS)}) AS flags", "stance", f"{BASE}, {STANCE}")

# Tracks.
simple("reference_height", f"track_id, {r('median(height_px)', 'reference_px')}, count(height_px) AS n_heights", where="GROUP BY track_id")
simple("track_span", f"track_id, count(*) AS n, min(frame_index) AS first_frame, max(frame_index) AS last_frame, {r('count(*)::DOUBLE / (max(frame_index) - min(frame_index) + 1)', 'coverage')}", where="WHERE mean_conf >= 0.55 GROUP BY track_id")
SQL["longest_track"] = "SELECT 0::BIGINT AS clip_id, vec_id // 50 AS track_id, count(*) AS n FROM embeddings GROUP BY vec_id // 50 ORDER BY n DESC, track_id LIMIT 1"
simple("goal_offsets", f"track_id, frame_index, {r('lateral_m', 'lateral_m')}, {r('depth_m', 'depth_m')}, {r('coverage', 'coverage')}, in_area, CASE WHEN coverage < 0.35 THEN 'left' WHEN coverage > 0.65 THEN 'right' ELSE 'central' END AS mouth", f"(SELECT *, {GOAL} FROM features WHERE com_x IS NOT NULL)")
SQL["goal_scale"] = f"""WITH a AS (SELECT s_suppkey, (852 - s_suppkey % 1500)::DOUBLE AS ax, 300.0e0 AS ay, 120.0e0 AS bx, (300 + s_suppkey % 7)::DOUBLE AS b_y, CASE WHEN s_suppkey % 3 > 0 THEN 56.0e0 END AS bar FROM supplier),
  g AS (SELECT s_suppkey, bar, CASE WHEN ax > bx THEN bx ELSE ax END AS lx, CASE WHEN ax > bx THEN b_y ELSE ay END AS ly, CASE WHEN ax > bx THEN ax ELSE bx END AS rx, CASE WHEN ax > bx THEN ay ELSE b_y END AS ry FROM a),
  m AS (SELECT *, {dist('rx', 'ry', 'lx', 'ly')} AS w, (ly + ry) / 2 AS cy FROM g)
  SELECT s_suppkey, {r('w', 'width_px')}, {r('nullif(w, 0) / 7.32e0', 'px_per_m')}, {r('coalesce(abs(cy - bar), nullif(w, 0) / 7.32e0 * 2.44e0)', 'height_px')}, {r('abs(cy - bar) / (nullif(w, 0) / 7.32e0 * 2.44e0)', 'consistency')},
    {r('-(ry - ly) / nullif(w, 0) * CASE WHEN (rx - lx) / nullif(w, 0) > 0 THEN 1 ELSE -1 END', 'normal_x')}, {r('abs((rx - lx) / nullif(w, 0))', 'normal_y')} FROM m"""
_T = "(PARTITION BY track_id ORDER BY frame_index)"
PATH = f"""path AS (SELECT *, {step(_T)} AS step_px, sqrt(power({even('com_x', '1.0e0', _T)}, 2) + power({even('com_y', '1.0e0', _T)}, 2)) * 60 AS raw_speed, {GOAL} FROM usable), ref AS (SELECT track_id, median(height_px) AS reference_px FROM usable GROUP BY track_id)"""
SQL["positioning_by_track"] = f"""WITH {BASE}, {USABLE}, {PATH} SELECT 0::BIGINT AS clip_id, track_id, count(*) AS frames_analysed, CASE WHEN count(*) >= 2 THEN round(sum(step_px / reference_px), 6) END AS distance_covered_bh, CASE WHEN count(*) >= 2 THEN round(max(raw_speed / reference_px), 6) END AS peak_speed_bh_s,
  CASE WHEN count(*) >= 2 THEN round(median(depth_m), 6) END AS median_depth_m, CASE WHEN count(*) >= 2 THEN round(quantile_cont(depth_m, 0.95) - quantile_cont(depth_m, 0.05), 6) END AS depth_range_m, CASE WHEN count(*) >= 2 THEN round(median(coverage), 6) END AS median_coverage,
  CASE WHEN count(*) >= 2 THEN round(avg(in_area::INT), 6) END AS time_in_goal_area, CASE WHEN count(*) >= 2 THEN round(sum(step_px / 100.0e0), 6) END AS distance_covered_m FROM path JOIN ref USING (track_id) GROUP BY track_id"""
IDENT = f"""scored AS (SELECT track_id, count(*) AS frames, min(frame_index) AS first_frame, median(depth_m) AS median_depth_m, avg(in_mouth::INT) AS within_mouth, sum(step_px) / 100.0e0 AS distance_m FROM (SELECT *, {step(_T)} AS step_px, {GOAL} FROM features WHERE com_x IS NOT NULL) GROUP BY track_id HAVING count(*) >= 10),
  ranked AS (SELECT *, 0.55e0 * exp(-greatest(0, median_depth_m) / 8) + 0.25e0 * within_mouth + 0.2e0 * exp(-(distance_m / frames) / 0.05e0) AS score FROM scored)"""
simple("identify_geometry", f"track_id, frames, {r('median_depth_m', 'median_depth_m')}, {r('within_mouth', 'within_mouth')}, {r('distance_m', 'distance_m')}, {r('score', 'score')}, row_number() OVER (ORDER BY score DESC, first_frame, track_id) AS rank", "ranked", f"{BASE}, {IDENT}")
simple("identify_keeper", f"0::BIGINT AS clip_id, track_id, 'geometry' AS method, {r('score', 'score')}", "ranked", f"{BASE}, {IDENT}", "ORDER BY score DESC, first_frame, track_id LIMIT 1")
SQL["kit_colour_rank"] = f"""WITH {BASE}, s AS (SELECT track_id, frame_index, ((det_id * 37 + track_id * 91) % 256)::DOUBLE AS r, ((det_id * 11 + track_id * 53) % 256)::DOUBLE AS g, ((det_id * 5 + track_id * 17) % 256)::DOUBLE AS b FROM pose),
  t AS (SELECT track_id, count(*) AS n, min(frame_index) AS first_frame, median(r) AS r, median(g) AS g, median(b) AS b FROM s GROUP BY track_id HAVING count(*) >= 5), m AS (SELECT median(r) AS mr, median(g) AS mg, median(b) AS mb FROM t),
  d AS (SELECT track_id, n, first_frame, sqrt(power(r - mr, 2) + power(g - mg, 2) + power(b - mb, 2)) AS distance FROM t, m)
  SELECT track_id, n, {r('distance', 'distance')}, {r('distance / coalesce(nullif(max(distance) OVER (), 0), 1)', 'score')}, row_number() OVER (ORDER BY distance DESC, first_frame, track_id) AS rank FROM d"""
SQL["set_position"] = f"""WITH {BASE}, {USABLE}, {PATH}, a AS (SELECT track_id, frame_index, step_px / reference_px AS step, com_y / reference_px AS depth, row_number() OVER {_T} - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM path JOIN ref USING (track_id)),
  c AS (SELECT *, step - 0.05e0 * (depth - avg(depth) OVER (PARTITION BY track_id)) AS cost, first_value(i) OVER (PARTITION BY track_id ORDER BY step DESC, i) AS fastest FROM a WHERE n >= 3)
  SELECT track_id, frame_index, {r('cost', 'cost')} FROM c WHERE fastest < 3 OR i < fastest QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY cost, i) = 1"""
_w = f"({H[6]}e0 * feet_x + {H[7]}e0 * feet_y + {H[8]}e0)"
simple("pitch_project", f"track_id, frame_index, {r(f'({H[0]}e0 * feet_x + {H[1]}e0 * feet_y + {H[2]}e0) / {_w}', 'pitch_x')}, {r(f'({H[3]}e0 * feet_x + {H[4]}e0 * feet_y + {H[5]}e0) / {_w}', 'pitch_y')}, {r('feet_x', 'image_x')}, {r('feet_y', 'image_y')}")
_cw = f"({H[6]}e0 * com_x + {H[7]}e0 * com_y + {H[8]}e0)"
_ON = lambda x, y, w: tuple(f"(({H[k]}e0 * {x} + {H[k + 1]}e0 * {y} + {H[k + 2]}e0) / {w})" for k in (0, 3))
simple("ground_distance", f"track_id, frame_index, {r(dist(*_ON('feet_x', 'feet_y', _w), *_ON('com_x', 'com_y', _cw)), 'distance_m')}")
simple("detector_filter", "frame_index, det_id, row_number() OVER (PARTITION BY frame_index ORDER BY w * h DESC, det_id) AS rank", "box", BOXES, "WHERE y2 - y1 >= 0.05 * 720")
simple("identity_uncertain", f"0::BIGINT AS clip_id, count(*) AS candidates, {r('max(score)', 'score')}, count(*) > 1 AND max(score) < 0.5 AS uncertain", "ranked", f"{BASE}, {IDENT}", "HAVING count(*) > 0")
# The clicks are made by the inverse of H, so its values come back.
SQL["homography_fit"] = "SELECT s_suppkey::BIGINT AS clip_id, " + ", ".join(f"{v}e0 AS h{i}" for i, v in enumerate(f"{h:.4f}" for h in H)) + ", 6::BIGINT AS n_points, TRUE AS reliable FROM supplier"
_NAMES = ", ".join(f"'{n}'" for n, _, _ in LANDMARKS)
_CLICKS = f"clicks AS (SELECT s_suppkey::BIGINT AS clip_id, CASE WHEN j = 6 THEN 'nowhere' ELSE [{_NAMES}][(s_suppkey + j * 5) % {len(LANDMARKS)} + 1] END AS landmark FROM supplier, range(7) t(j))"
simple("landmark_lookup", "clip_id, landmark, pitch_x::DOUBLE AS pitch_x, pitch_y::DOUBLE AS pitch_y", f"clicks JOIN (VALUES {', '.join(str(x) for x in LANDMARKS)}) l(landmark, pitch_x, pitch_y) USING (landmark)", _CLICKS)
simple("landmark_unknown", "clip_id, landmark", "clicks", _CLICKS, "WHERE landmark = 'nowhere'")

# Series.
_U = "(PARTITION BY user_id ORDER BY idx)"
simple("gradient_nonuniform", f"user_id, idx, {r(uneven('v', 'm', _U), 'dv', 4)}", "(SELECT *, t / 60 AS m FROM sig)", SIGNAL)
simple("gradient_uniform", f"user_id, idx, {r(even('v', '(1.0e0 / 60)', _U), 'dv')}", "sig", SIGNAL)
SQL["acceleration"] = f"WITH {SIGNAL}, a AS (SELECT user_id, idx, abs({even('v', '1.0e0', _U)}) AS s FROM sig) SELECT user_id, idx, {r('s', 'speed')}, {r(even('s', '1.0e0', _U), 'acc')} FROM a"
simple("step_distance", f"track_id, frame_index, {r(step(_T), 'step_px')}", "usable", f"{BASE}, {USABLE}")
SQL["gap_fill"] = f"WITH {BASE}, f AS (SELECT * FROM features WHERE mean_conf >= 0.55), d AS (SELECT track_id, unnest(range(min(frame_index), max(frame_index) + 1)) AS frame_index FROM f GROUP BY track_id) SELECT track_id, frame_index, {r('com_x', 'com_x')} FROM d LEFT JOIN f USING (track_id, frame_index)"
SQL["gap_interpolate"] = f"""WITH {SIGNAL}, g AS (SELECT user_id, idx, CASE WHEN event_type <> 'error' THEN v END AS g FROM sig),
  n AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ai, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS a,
    first_value(CASE WHEN g IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi, first_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
  SELECT user_id, idx, {r('coalesce(g, a + (b - a) * (idx - ai) / nullif(bi - ai, 0), a, b, 0)', 'filled')} FROM n"""
simple("local_peaks", f"user_id, idx, {r('v', 'v')}", f"(SELECT *, v >= 20 AND v >= lag(v) OVER {_U} AND v > lead(v) OVER {_U} AS peak FROM sig)", SIGNAL, "WHERE peak")
_A = "(PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
simple("kick_tail", f"user_id, idx, {r(f'min(v) OVER {_A}', 'least')}, {r(f'avg(v) OVER {_A}', 'mean')}", "sig", SIGNAL)
SQL["refractory_events"] = f"""WITH RECURSIVE {SIGNAL}, e AS (SELECT user_id, idx, v, row_number() OVER {_U} AS n FROM sig WHERE v >= 5),
  s AS (SELECT user_id, n, [{{'idx': idx, 'v': v}}] AS kept FROM e WHERE n = 1
    UNION ALL SELECT s.user_id, e.n, CASE WHEN e.idx - s.kept[-1].idx >= 4 THEN list_append(s.kept, {{'idx': e.idx, 'v': e.v}}) WHEN e.v > s.kept[-1].v THEN list_append(s.kept[:-2], {{'idx': e.idx, 'v': e.v}}) ELSE s.kept END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1),
  l AS (SELECT user_id, unnest(arg_max(kept, n)) AS k FROM s GROUP BY user_id) SELECT user_id, k.idx AS idx, {r('k.v', 'v')} FROM l"""
SQL["islands"] = f"""WITH {SIGNAL}, b AS (SELECT *, coalesce(v >= 30, FALSE) AS f, coalesce(lag(coalesce(v >= 30, FALSE)) OVER {_U}, FALSE) AS before FROM sig), i AS (SELECT *, sum((f AND NOT before)::INT) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM b)
  SELECT user_id, island::BIGINT AS island, min(idx) AS start, max(idx) AS "end", count(*) AS n, arg_max(idx, v * 1e6 - idx) AS peak FROM i WHERE f GROUP BY user_id, island HAVING count(*) >= 2"""
SQL["prefix_median"] = f"WITH {SIGNAL}, t AS (SELECT *, first_value(idx) OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST, idx) AS top FROM sig) SELECT user_id, any_value(top) AS top, {r('median(CASE WHEN idx < top THEN v END)', 'baseline')} FROM t GROUP BY user_id"
_SO_FAR = "median(CASE WHEN event_type <> 'error' THEN v END) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
SQL["running_median"] = f"WITH {SIGNAL} SELECT user_id, idx, {r(_SO_FAR, 'median')} FROM sig"
SQL["asof_reaction"] = f"WITH {SIGNAL}, e AS (SELECT user_id, event_id, t FROM sig WHERE event_type = 'error'), p AS (SELECT user_id, t AS shot FROM sig WHERE event_type = 'purchase') SELECT e.user_id, event_id, {r('t - shot', 'reaction_s', 3)} FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.t >= p.shot"
SQL["stride_trim"] = f"WITH {SIGNAL}, w AS (SELECT *, row_number() OVER {_U} - 1 AS n FROM sig WHERE idx >= 2 AND idx < 40) SELECT user_id, idx, {r('v', 'v')} FROM w WHERE n % 3 = 0"
SQL["tumbling_summary"] = f"SELECT event_type, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n, {r('avg(value)', 'mean_value')}, {r('max(value)', 'max_value')} FROM events GROUP BY event_type, date_trunc('day', ts)"
SQL["session_summary"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n_ FROM g)
  SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n FROM s GROUP BY user_id, n_"""

# Feet.
FEET = """feet AS (SELECT track_id, frame_index, height_px, 'left' AS foot, 0 AS foot_order, x15 AS x, y15 AS y, c15 AS conf FROM features WHERE height_px > 0 AND x15 IS NOT NULL UNION ALL SELECT track_id, frame_index, height_px, 'right', 1, x16, y16, c16 FROM features WHERE height_px > 0 AND x16 IS NOT NULL),
  series AS (SELECT *, count(*) OVER (PARTITION BY track_id, foot) AS n, median(height_px) OVER (PARTITION BY track_id, foot) AS reference_px, frame_index / {fps} AS time_s FROM feet)"""
_F = "(PARTITION BY track_id, foot ORDER BY frame_index)"
CONTACTS = f"""vert AS (SELECT *, abs({uneven('y', 'time_s', _F)}) / reference_px AS vertical, y >= lag(y) OVER {_F} AND y > lead(y) OVER {_F} AS low FROM series WHERE n >= 8), cut AS (SELECT track_id, foot, quantile_cont(vertical, 0.4) AS p40 FROM vert GROUP BY track_id, foot), contacts AS (SELECT v.* FROM vert v JOIN cut USING (track_id, foot) WHERE low AND vertical < p40)"""
simple("foot_contacts_raw", f"track_id, frame_index, foot, {r('time_s', 'time_s')}, {r('conf', 'confidence')}", "contacts", f"{BASE}, {FEET.format(fps='60.0e0')}, {CONTACTS}")
_RATE = "60.0e0 * (count(*) - 1) / nullif(max(time_s) - min(time_s), 0)"
simple("cadence", f"track_id, count(*) AS contacts, {r(f'CASE WHEN {_RATE} BETWEEN 40 AND 260 THEN {_RATE} END', 'cadence_spm')}", "contacts", f"{BASE}, {FEET.format(fps='5.0e0')}, {CONTACTS}", "GROUP BY track_id")
_F3 = "(PARTITION BY track_id, foot ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
SQL["kicks_raw"] = f"""WITH RECURSIVE {BASE}, {FEET.format(fps='60.0e0')}, vel AS (SELECT *, {uneven('x', 'time_s', _F)} / reference_px AS vx, {uneven('y', 'time_s', _F)} / reference_px AS vy FROM series WHERE n >= 8), spd AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM vel), acc AS (SELECT *, {uneven('speed', 'time_s', _F)} AS acc FROM spd),
  pk AS (SELECT *, speed >= 3 AND speed >= lag(speed) OVER {_F} AND speed > lead(speed) OVER {_F} AS peak, min(acc) OVER {_F3} AS dec, avg(conf) OVER {_F3} AS confidence FROM acc),
  e AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY time_s, speed, foot_order) AS k FROM pk WHERE peak),
  s AS (SELECT track_id, k, [k] AS kept, time_s AS lt, speed AS ls FROM e WHERE k = 1
    UNION ALL SELECT s.track_id, e.k, CASE WHEN e.time_s - lt >= 0.4 THEN list_append(kept, e.k) WHEN e.speed > ls THEN list_append(kept[:-2], e.k) ELSE kept END, CASE WHEN e.time_s - lt >= 0.4 OR e.speed > ls THEN e.time_s ELSE lt END, CASE WHEN e.time_s - lt >= 0.4 OR e.speed > ls THEN e.speed ELSE ls END FROM s JOIN e ON e.track_id = s.track_id AND e.k = s.k + 1),
  l AS (SELECT track_id, unnest(arg_max(kept, k)) AS k FROM s GROUP BY track_id)
  SELECT track_id, frame_index, foot, {r('time_s', 'time_s')}, {r('speed', 'peak_speed_bh_s')}, {r('dec', 'deceleration_bh_s2')}, {r('confidence', 'confidence')} FROM e JOIN l USING (track_id, k)"""

# Dives.
_C = "(PARTITION BY clip_id ORDER BY frame_index)"
DIVES = f"""{DIVE_BASE}, {USABLE}, ref AS (SELECT clip_id, median(height_px) AS reference_px, count(*) AS n FROM usable GROUP BY clip_id),
  s0 AS (SELECT u.*, reference_px, n, row_number() OVER {_C} - 1 AS i, frame_index / 60.0e0 AS time_s FROM usable u JOIN ref USING (clip_id)),
  s1 AS (SELECT *, {uneven('com_x', 'time_s', _C)} / reference_px AS vx, {uneven('com_y', 'time_s', _C)} / reference_px AS vy, ankle_y / reference_px AS ankle_bh, (midhip_y - min_wrist_y) / reference_px AS reach_bh, (ankle_y - com_y) / reference_px AS com_h_bh FROM s0),
  s2 AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM s1), s3 AS (SELECT *, speed >= 1.2 AND coalesce(lag(speed) OVER {_C}, 0) < 1.2 AS begins FROM s2), s4 AS (SELECT *, sum(begins::INT) OVER (PARTITION BY clip_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS island FROM s3),
  b AS (SELECT clip_id, island, min(i) AS si, max(i) AS ei, any_value(n) AS n, any_value(reference_px) AS reference_px, min(frame_index) AS start_frame, max(frame_index) AS end_frame, arg_max(frame_index, speed) AS peak_frame, max(speed) AS peak_speed_bh_s, (arg_max(com_x, i) - arg_min(com_x, i)) / any_value(reference_px) AS lateral_bh, max(abs(lean_deg)) AS max_lean_deg, max(reach_bh) AS peak_reach_bh, min(com_h_bh) AS lowest, avg(mean_conf) AS confidence
    FROM s4 WHERE speed >= 1.2 GROUP BY clip_id, island HAVING count(*) >= 4 AND coalesce(max(abs(lean_deg)), 90) >= 25),
  d AS (SELECT *, CASE WHEN abs(lateral_bh) < 0.15 THEN 'centre' WHEN lateral_bh > 0 THEN 'right' ELSE 'left' END AS direction, CASE WHEN lowest < 0.2 THEN 'low' WHEN lowest > 0.4 AND (peak_reach_bh IS NULL OR peak_reach_bh > 0.35) THEN 'high' WHEN lowest IS NOT NULL THEN 'mid' WHEN peak_reach_bh > 0.4 THEN 'high' WHEN peak_reach_bh < 0.1 THEN 'low' ELSE 'mid' END AS height,
    start_frame / 60.0e0 - (SELECT max(x) FROM (VALUES (0.25e0), (0.5e0), (1.5e0)) v(x) WHERE x <= start_frame / 60.0e0) AS reaction FROM b),
  bl AS (SELECT b.clip_id, b.island, coalesce(median(CASE WHEN i < si THEN speed END), 0) AS baseline, median(CASE WHEN i < si THEN ankle_bh END) AS ground FROM b JOIN s4 USING (clip_id) GROUP BY b.clip_id, b.island),
  ph AS (SELECT b.clip_id, b.island, arg_min(CASE WHEN i < si AND i >= greatest(0, si - round_even(b.n * 0.1, 0)::BIGINT - 1) THEN frame_index END, CASE WHEN i < si AND i >= greatest(0, si - round_even(b.n * 0.1, 0)::BIGINT - 1) THEN speed END) AS set_frame, coalesce(max(CASE WHEN i < si AND speed <= 1.5 * baseline THEN i END) + 1, 0) AS prep_i, min(CASE WHEN i BETWEEN si AND ei AND ankle_bh < ground - 0.04 THEN frame_index END) AS flight_start FROM b JOIN bl USING (clip_id, island) JOIN s4 USING (clip_id) GROUP BY b.clip_id, b.island),
  p AS (SELECT d.*, set_frame, s4.frame_index AS preparatory_start, flight_start FROM d JOIN ph USING (clip_id, island) JOIN s4 ON s4.clip_id = d.clip_id AND s4.i = ph.prep_i)"""
simple("dives_raw", f"clip_id, start_frame, end_frame, peak_frame, {r('peak_speed_bh_s', 'peak_speed_bh_s')}, {r('lateral_bh', 'lateral_bh')}, {r('lateral_bh * reference_px / 100', 'lateral_m')}, {r('max_lean_deg', 'max_lean_deg')}, {r('peak_reach_bh', 'peak_reach_bh')}, direction, height, {r('reaction', 'reaction_time_s')}, {r('confidence', 'confidence')}", "p", DIVES)
simple("dive_phases", "clip_id, set_frame, preparatory_start, start_frame AS takeoff, flight_start, peak_frame AS peak, end_frame AS landing", "p", DIVES)
simple("phase_label", "clip_id, frame_index, CASE WHEN frame_index >= end_frame THEN 'landing' WHEN frame_index >= flight_start THEN 'flight' WHEN frame_index >= start_frame THEN 'takeoff' WHEN frame_index >= preparatory_start THEN 'preparatory' WHEN frame_index >= set_frame THEN 'set' ELSE 'dive' END AS phase", "p JOIN (SELECT clip_id, frame_index FROM pose) USING (clip_id)", DIVES, "WHERE frame_index BETWEEN start_frame AND end_frame")
_RE = lambda v, n, d: f"round_even({v}, {d}) + 0.0e0 AS {n}"
simple("dive_table", f"clip_id, {_RE('start_frame / 60.0e0', 'start_s', 3)}, {_RE('(end_frame - start_frame) / 60.0e0', 'duration_s', 3)}, direction, height, {_RE('peak_speed_bh_s', 'peak_speed_bh_s', 2)}, {_RE('lateral_bh', 'lateral_bh', 2)}, {_RE('max_lean_deg', 'max_lean_deg', 1)}, {_RE('confidence', 'confidence', 2)}", "p", DIVES)

_STEP = step(_C)
SQL["report_row"] = f"""WITH {DIVES}, placed AS (SELECT clip_id, {_STEP} AS step_px, {GOAL} FROM usable), pos AS (SELECT clip_id, count(*) AS frames_analysed, median(depth_m) AS dm, median(coverage) AS cm, avg(in_area::INT) AS area, sum(step_px / 100.0e0) AS dist FROM placed GROUP BY clip_id),
  span AS (SELECT clip_id, count(*) AS n FROM features GROUP BY clip_id), counted AS (SELECT clip_id, count(*) AS k FROM p GROUP BY clip_id),
  rows_ AS (SELECT clip_id, n, frames_analysed, coalesce(k, 0) AS k, dm, cm, area, dist, CASE WHEN cm < 0.35 THEN 'left' WHEN cm > 0.65 THEN 'right' ELSE 'central' END AS mouth FROM span LEFT JOIN pos USING (clip_id) LEFT JOIN counted USING (clip_id))
  SELECT clip_id, 0::BIGINT AS track_id, n, {r('n / 60.0e0', 'duration_s')}, k AS dive_count, frames_analysed, {r('dm', 'median_depth_m')}, {r('cm', 'median_coverage')}, {r('area', 'time_in_goal_area')}, {r('dist', 'distance_covered_m')}, mouth, 'track 0 | ' || n || ' frames | ' || k || ' dives | ' || printf('%.2f', dm) || ' m off the line | ' || mouth AS summary FROM rows_"""

# Low-pass: the recursion forwards and backwards over the series continued by its mirrored rows.
def low_passed(name: str, source: str, keys: str, order: str, values: list[str], fps: float, cutoff: float) -> str:
    """CTEs that end in ``name``: source with its values filtered."""
    b, a = butterworth(cutoff, fps)
    n, pad = len(a) - 1, PAD
    companion = np.zeros((n, n))
    companion[0], companion[1:, :-1] = -a[1:], np.eye(n - 1)
    start = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])
    e = lambda v: f"({float(v)!r})::DOUBLE"
    using = f"USING ({keys})"

    def states(x: str, v: str, before: list[str]) -> str:
        y = f"({e(b[0])} * {x} + {before[0]})"
        rest = ", ".join(f"{e(b[k + 1])} * {x} - {e(a[k + 1])} * {y}" + (f" + {before[k + 1]}" if k + 1 < n else "") + f" AS s{k}_{v}" for k in range(n))
        return f"{y} AS y_{v}, {rest}"

    def passed(to: str, of: str) -> str:
        first = ", ".join(states(f"p.{v}", v, [f"{e(z)} * p.{v}" for z in start]) for v in values)
        then = ", ".join(states(f"p.{v}", v, [f"q.s{k}_{v}" for k in range(n)]) for v in values)
        same = " AND ".join(f"p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
        of_p = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
        return f"{to} AS (SELECT {of_p}, p.t_, {first} FROM {of} p WHERE p.t_ = 0 UNION ALL SELECT {of_p}, p.t_, {then} FROM {to} q JOIN {of} p ON {same} AND p.t_ = q.t_ + 1)"

    mirrored = lambda end: ", ".join(f"2 * {end}.{v} - a.{v} AS {v}" for v in values)
    plain = ", ".join(f"a.{v}" for v in values)
    of_a = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{name}_i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i_, count(*) OVER (PARTITION BY {keys}) AS n_ FROM {source}),
  {name}_p AS MATERIALIZED (SELECT {of_a}, a.i_ + {pad} AS t_, {plain} FROM {name}_i a WHERE a.n_ > {pad}
    UNION ALL SELECT {of_a}, {pad} - a.i_, {mirrored('f')} FROM {name}_i a JOIN {name}_i f {using} WHERE f.i_ = 0 AND a.i_ BETWEEN 1 AND {pad} AND a.n_ > {pad}
    UNION ALL SELECT {of_a}, 2 * a.n_ + {pad - 2} - a.i_, {mirrored('l')} FROM {name}_i a JOIN {name}_i l {using} WHERE l.i_ = l.n_ - 1 AND a.i_ BETWEEN a.n_ - {pad + 1} AND a.n_ - 2 AND a.n_ > {pad}),
  {passed(f'{name}_f', f'{name}_p')},
  {name}_r AS MATERIALIZED (SELECT {keys}, max(t_) OVER (PARTITION BY {keys}) - t_ AS t_, {', '.join(f'y_{v} AS {v}' for v in values)} FROM {name}_f),
  {passed(f'{name}_b', f'{name}_r')},
  {name} AS MATERIALIZED (SELECT a.* REPLACE ({', '.join(f'coalesce(b.y_{v}, a.{v}) AS {v}' for v in values)}) FROM {name}_i a LEFT JOIN {name}_b b ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} AND b.t_ = a.n_ - 1 - a.i_ + {pad})"""


_SMOOTH = low_passed("smooth", "raw", "clip_id", "frame_index", ["com_x", "com_y"], 60.0, 8.0)
#: The dives of the filtered path; heights of the centre of mass stay those of the raw one.
DIVES_FILTERED = DIVES.replace(USABLE, f"{USABLE.replace('usable AS (SELECT *', 'raw AS (SELECT *, com_y AS raw_com_y')}, {_SMOOTH}, usable AS (SELECT * FROM smooth)").replace("(ankle_y - com_y) / reference_px AS com_h_bh", "(ankle_y - raw_com_y) / reference_px AS com_h_bh")
SQL["dives_filtered"] = f"WITH RECURSIVE {DIVES_FILTERED} SELECT clip_id, start_frame, end_frame, peak_frame, {r('peak_speed_bh_s', 'peak_speed_bh_s')}, {r('lateral_bh', 'lateral_bh')}, direction, height FROM p"
# Every joint of these keepers is sure, so their set positions are valid; there are no shots, and the posts and the bar agree.
SQL["goalkeeper_report"] = f"""WITH RECURSIVE {DIVES_FILTERED}, {low_passed('calm', 'raw', 'clip_id', 'frame_index', ['com_x', 'com_y'], 60.0, 6.0)},
  pos AS (SELECT clip_id, count(*) AS frames, median(depth_m) AS dm, median(coverage) AS cm FROM (SELECT clip_id, {GOAL} FROM calm) GROUP BY clip_id), span AS (SELECT clip_id, count(*) AS n, max(frame_index) - min(frame_index) + 1 AS wide FROM features GROUP BY clip_id), counted AS (SELECT clip_id, count(*) AS k FROM p GROUP BY clip_id),
  rows_ AS (SELECT *, coalesce(k, 0) AS dives, CASE WHEN cm < 0.35 THEN 'left' WHEN cm > 0.65 THEN 'right' ELSE 'central' END AS mouth FROM span LEFT JOIN pos USING (clip_id) LEFT JOIN counted USING (clip_id))
  SELECT clip_id, 0::BIGINT AS track_id, n, {r('n / 60.0e0', 'duration_s')}, dives AS dive_count, {r('dm', 'median_depth_m')}, mouth,
    concat_ws(',', 'scale_holds_at_line', CASE WHEN dives > 0 THEN 'no_shot_times' END, CASE WHEN n < 0.8 * wide THEN 'gaps' END, CASE WHEN frames < 15 THEN 'few_frames' END, CASE WHEN abs(cm - 0.5) * 7.32e0 > 1.5 THEN 'off_centre' END) AS warnings,
    'track 0 | ' || n || ' frames | ' || dives || ' dives | ' || printf('%.2f', dm) || ' m off the line | ' || mouth AS summary FROM rows_"""
SQL["kicks_filtered"] = SQL["kicks_raw"].replace("n >= 8)", "n >= 8)", 1).replace("FROM series WHERE n >= 8), spd", "FROM steady), spd").replace(", vel AS (", f", cut AS (SELECT * FROM series WHERE n >= 8), {low_passed('steady', 'cut', 'track_id, foot', 'frame_index', ['x', 'y'], 60.0, 12.0)}, vel AS (")
SQL["kicks_filtered"] = f"SELECT track_id, frame_index, foot, peak_speed_bh_s FROM ({SQL['kicks_filtered']})"
_LEANLESS = DIVES.replace("max(abs(lean_deg)) AS max_lean_deg", "max(CASE WHEN clip_id % 3 > 0 THEN abs(lean_deg) END) AS max_lean_deg").replace("coalesce(max(abs(lean_deg)), 90)", "coalesce(max(CASE WHEN clip_id % 3 > 0 THEN abs(lean_deg) END), 90)")
SQL["dive_notes"] = f"""WITH {_LEANLESS}, n AS (SELECT clip_id, start_frame, max_lean_deg, confidence, CASE WHEN start_frame / 60.0e0 >= CASE WHEN clip_id % 4 = 0 THEN 0.7e0 ELSE 0.2e0 END THEN start_frame / 60.0e0 - CASE WHEN clip_id % 4 = 0 THEN 0.7e0 ELSE 0.2e0 END END AS late FROM b)
  SELECT clip_id, start_frame, {r('late', 'reaction_time_s')}, concat_ws(',', CASE WHEN late < 0.1 THEN 'early_reaction' END, CASE WHEN max_lean_deg IS NULL THEN 'trunk_unseen' END, CASE WHEN confidence < 0.5 THEN 'unsure_pose' END) AS notes FROM n"""

# Tracking: the two people of a clip are far apart and move slowly, so each keeps its id and is confirmed in its third frame.
_FRAMES = "supplier, range(120) t(f)"
SQL["track_boxes"] = f"SELECT s_suppkey::BIGINT AS clip_id, f AS frame_index, d AS det_id, d AS track_id, f >= 2 AS confirmed FROM {_FRAMES}, range(2) u(d)"
SQL["track_segments"] = f"SELECT s_suppkey::BIGINT * 200 + f AS frame_index, d AS det_id, 2 * (dense_rank() OVER (ORDER BY s_suppkey) - 1) + d AS track_id, f >= 2 AS confirmed FROM {_FRAMES}, range(2) u(d)"
SQL["streamed_tracks"] = f"SELECT s_suppkey::BIGINT AS clip_id, f AS frame_index, 0::BIGINT AS det_id, 0::BIGINT AS track_id, f >= 2 AS confirmed FROM {_FRAMES}"

# One long series.
_O = "(ORDER BY event_id)"
SQL["long_gradient"] = f"SELECT event_id, {r(uneven('value', 'event_id', _O), 'dv')} FROM events"
SQL["long_uniform_gradient"] = f"SELECT event_id, {r(even('value', '0.5e0', _O), 'dv')} FROM events"
SQL["long_steps"] = f"SELECT event_id, {r(f'coalesce(sqrt(power(value - lag(value) OVER {_O}, 2) + power(event_id % 97 - lag(event_id % 97) OVER {_O}, 2)), 0)', 'step')} FROM events"
SQL["long_peaks"] = f"SELECT event_id, {r('value', 'v')} FROM events QUALIFY value >= 20 AND value >= lag(value) OVER {_O} AND value > lead(value) OVER {_O}"
SQL["long_islands"] = f"""WITH b AS (SELECT event_id, coalesce(value >= 10, FALSE) AS f, coalesce(lag(value >= 10) OVER {_O}, FALSE) AS before FROM events), i AS (SELECT *, sum((f AND NOT before)::INT) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
  SELECT island::BIGINT AS island, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM i WHERE f GROUP BY island HAVING count(*) >= 2"""
SQL["long_interpolate"] = f"""WITH g AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS g FROM events),
  n AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ai, last_value(g IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS a,
    first_value(CASE WHEN g IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi, first_value(g IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
  SELECT event_id, {r('coalesce(g, a + (b - a) * (event_id - ai) / nullif(bi - ai, 0), a, b, 0)', 'filled')} FROM n"""

# Pictures.
def _corner(size: tuple[str, str]) -> dict[str, str]:
    """Edges of a torso's patch, with the joints' columns as they are."""
    out = {}
    for axis, far, low, high in (("x", size[0], "x1", "x2"), ("y", size[1], "y1", "y2")):
        places = ", ".join(f"{axis}{j}" for j in (5, 6, 11, 12))
        least, most = f"least({places})", f"greatest({places})"
        out[low] = f"greatest(0, trunc({least} + ({most} - {least}) * 0.2e0))::BIGINT"
        out[high] = f"least({far}, trunc({most} - ({most} - {least}) * 0.2e0))::BIGINT"
    return out


def _patch(source: str, size: tuple[str, str]) -> str:
    edges = ", ".join(f"{v} AS {n}" for n, v in _corner(size).items())
    return f"patch AS (SELECT clip_id, track_id, frame_index, det_id, {edges} FROM {source} WHERE {_TRUNK}), framed AS (SELECT * FROM patch WHERE x2 > x1 AND y2 > y1)"


simple("torso_patch", "det_id, x1, y1, x2, y2", "framed", f"{BASE}, {_patch('sure', ('1280', '720'))}")
_TENTH = "tenth AS (SELECT * REPLACE (" + ", ".join(f"{a}{j} * 0.1e0 AS {a}{j}" for j in (5, 6, 11, 12) for a in "xy") + ") FROM sure)"
_PICTURE = f"""{_TENTH}, {_patch('tenth', ('128', '72'))}, seen AS (SELECT track_id, frame_index, {', '.join(f'median((px * 3 + py * 5 + frame_index * 7 + {11 * k}) % 256) AS {c}' for k, c in enumerate('rgb'))}
  FROM framed, range(128) u(px), range(72) v(py) WHERE px >= x1 AND px < x2 AND py >= y1 AND py < y2 GROUP BY track_id, frame_index)"""
simple("kit_samples", f"track_id, frame_index, {r('r', 'r')}, {r('g', 'g')}, {r('b', 'b')}", "seen", f"{BASE}, {_PICTURE}")
SQL["kit_keeper"] = f"""WITH {BASE}, {_PICTURE}, t AS (SELECT track_id, count(*) AS n, min(frame_index) AS first_frame, median(r) AS r, median(g) AS g, median(b) AS b FROM seen GROUP BY track_id HAVING count(*) >= 5), m AS (SELECT median(r) AS mr, median(g) AS mg, median(b) AS mb FROM t),
  d AS (SELECT track_id, n, first_frame, sqrt(power(r - mr, 2) + power(g - mg, 2) + power(b - mb, 2)) AS distance FROM t, m)
  SELECT track_id, n, {r('distance', 'distance')}, {r('distance / coalesce(nullif(max(distance) OVER (), 0), 1)', 'score')}, row_number() OVER (ORDER BY distance DESC, first_frame, track_id) AS rank FROM d"""
_TURNED = {"x": "CASE vec_id % 4 WHEN 1 THEN 359 - y WHEN 2 THEN 639 - x WHEN 3 THEN y ELSE x END", "y": "CASE vec_id % 4 WHEN 1 THEN x WHEN 2 THEN 359 - y WHEN 3 THEN 639 - x ELSE y END"}
SQL["pixel_landmarks"] = "WITH k AS (" + " UNION ALL ".join(f"SELECT vec_id, {j}::BIGINT AS joint, {_E(j)} * 640 AS x, {_E(j + 31)} * 360 AS y, abs({_E(j)}) AS conf FROM embeddings" for j in range(33)) + f") SELECT vec_id, joint, {r(f'({_TURNED['x']}) / 0.5e0', 'x')}, {r(f'({_TURNED['y']}) / 0.5e0', 'y')}, {r('conf', 'conf')} FROM k"
_PLACED = "places AS (SELECT vec_id // 50 AS track_id, vec_id % 50 AS frame_index, " + ", ".join(" + ".join(_E(3 * j + n) for j in range(17)) + f" AS {a}" for n, a in enumerate("xyz")) + " FROM embeddings)"
SQL["smoothed_3d"] = f"WITH RECURSIVE {_PLACED}, {low_passed('calm', 'places', 'track_id', 'frame_index', ['x', 'y', 'z'], 60.0, 6.0)} SELECT track_id, frame_index, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM calm"
SQL["session_low_pass"] = f"""WITH RECURSIVE gaps AS (SELECT user_id, ts, value AS v, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 DAY THEN 0 ELSE 1 END AS new FROM events), runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
  {low_passed('calm', 'runs', 'user_id, run', 'ts', ['v'], 60.0, 8.0)} SELECT user_id, epoch_us(min(ts) OVER (PARTITION BY user_id, run)) AS start_us, epoch_us(ts) AS at_us, {r('v', 'v')} FROM calm"""
SQL["run_summary"] = f"""WITH {DIVES}, k AS (SELECT clip_id, count(*) AS dives FROM p GROUP BY clip_id)
  SELECT s_suppkey::BIGINT AS clip_id, 'Clip       : ' || s_suppkey || chr(10) || 'Resolution : 1280x720  (landscape)' || chr(10) || 'Frame rate : 60.00 fps' || chr(10) || 'Frames     : 120 processed' || chr(10) || 'People     : 1 track(s)' || chr(10) || 'Dives      : ' || coalesce(dives, 0) AS text FROM supplier LEFT JOIN k ON clip_id = s_suppkey"""

SQL["parse_points"] = f"SELECT p_partkey, {r('CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey + 0.5e0 END', 'x')}, {r('CASE WHEN p_partkey % 4 < 2 THEN p_size END', 'y')} FROM part"
SQL["clean_values"] = "SELECT p_partkey AS clip_id, " + ", ".join(f"CASE WHEN p_partkey % 5 <> {bad} THEN (p_partkey + {i})::DOUBLE END AS {c}" for i, (c, bad) in enumerate({"lx": 0, "ly": 1, "rx": 2, "ry": 0, "crossbar_y": 4}.items())) + " FROM part"
simple("untracked_skipped", "track_id, count(*) AS n, count(com_x) AS placed", where="WHERE det_id % 3 > 0 GROUP BY track_id")
SQL["set_position_window"] = f"""WITH {BASE}, usable AS (SELECT * FROM features WHERE com_x IS NOT NULL AND height_px > 0 AND frame_index BETWEEN 10 AND 30), {PATH},
  a AS (SELECT track_id, frame_index, step_px / reference_px AS step, com_y / reference_px AS depth, row_number() OVER {_T} - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM path JOIN ref USING (track_id)), c AS (SELECT *, step - 0.05e0 * (depth - avg(depth) OVER (PARTITION BY track_id)) AS cost FROM a WHERE n >= 3)
  SELECT track_id, frame_index, {r('cost', 'cost')} FROM c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY cost, i) = 1"""
SQL["calibration_error"] = "SELECT s_suppkey::BIGINT AS clip_id, CASE WHEN s_suppkey % 2 = 0 THEN 0.0e0 END AS reproj_err_px, CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 3 END::BIGINT AS n_points, s_suppkey % 2 = 0 AS reliable FROM supplier"

# Clips.
_CLIP = "clip AS (SELECT p_partkey::BIGINT AS clip_id, CASE p_partkey % 3 WHEN 0 THEN 3840 WHEN 1 THEN 1920 ELSE 1280 END AS width, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 1600 ELSE 2160 END WHEN 1 THEN 1080 ELSE 720 END AS height, CASE p_partkey % 5 WHEN 0 THEN 120.0e0 WHEN 1 THEN 24.0e0 WHEN 2 THEN 60.0e0 ELSE 30.0e0 END AS fps, (p_size * 60)::BIGINT AS frame_count, (p_partkey % 4 * 90)::INT AS rotation, CASE WHEN p_partkey % 7 < 3 THEN 'HEVC' ELSE 'h264' END AS codec, (p_size * 4)::DOUBLE AS duration_s FROM part)"
simple("frame_times", f"clip_id, {r('CASE WHEN clip_id % 3 > 0 THEN frame_count * 1001 / 30000.0e0 ELSE (frame_count - 1) / fps END', 'time_s')}", "clip", _CLIP)
_DEVICE = "CASE WHEN codec = 'HEVC' AND greatest(width, height) / least(width, height)::DOUBLE > 1.9 THEN 'action_cam' WHEN codec = 'HEVC' THEN 'iphone_recent' WHEN greatest(width, height) >= 3000 THEN 'android_flagship' WHEN fps <= 30.5 AND greatest(width, height) <= 1920 THEN 'android_midrange' ELSE 'generic' END"
_SHOWN = "shown AS (SELECT *, CASE WHEN rotation IN (90, 270) THEN height ELSE width END AS display_width, CASE WHEN rotation IN (90, 270) THEN width ELSE height END AS display_height, fps >= 100 AS is_high_speed FROM clip)"
simple("display_size", "clip_id, display_width, display_height, display_height > display_width AS is_portrait, is_high_speed", "shown", f"{_CLIP}, {_SHOWN}")
simple("device_preset", f"clip_id, {_DEVICE} AS device", "clip", _CLIP)
_PROFILED = f"dev AS (SELECT *, {_DEVICE} AS device FROM shown), prof AS (SELECT *, CASE WHEN device = 'android_midrange' THEN 'fast' ELSE 'balanced' END AS profile FROM dev), q AS (SELECT *, CASE WHEN profile = 'fast' OR is_high_speed THEN 2 ELSE 1 END AS frame_stride, CASE WHEN profile = 'fast' THEN 640 ELSE 1280 END AS target_long_edge FROM prof)"
simple("resolve_profile", f"clip_id, device, profile, frame_stride, target_long_edge, greatest(1, floor(coalesce(CASE WHEN clip_id % 2 = 0 THEN trunc(3.5e0 * fps) END, frame_count) / frame_stride))::BIGINT AS expected, {r('least(1.0e0, target_long_edge / greatest(width, height)::DOUBLE)', 'scale')}", "q", f"{_CLIP}, {_SHOWN}, {_PROFILED}")
simple("capture_warnings", "clip_id, concat_ws(',', CASE WHEN device = 'android_midrange' THEN 'rolling_shutter' END, CASE WHEN device = 'action_cam' THEN 'wide_angle' END, CASE WHEN display_height > display_width THEN 'portrait' END, CASE WHEN fps < 29 THEN 'low_frame_rate' END) AS warnings, concat_ws(',', CASE WHEN device = 'iphone_recent' THEN 'no_action_mode' END, 'landscape', 'still_camera', 'whole_body', 'frame_rate') AS tips", "q", f"{_CLIP}, {_SHOWN}, {_PROFILED}")

# Exports.
simple("wide_export", f"frame_index AS frame, {r('frame_index / 60.0e0', 'time_s')}, track_id, " + ", ".join(r(f"{a}{i}", f"{j}_{n}") for i, j in enumerate(sk.COCO17) for a, n in (("x", "x"), ("y", "y"), ("c", "conf"))), "pose")
SQL["long_export"] = f"WITH pose AS ({POSE}) " + " UNION ALL ".join(f"SELECT frame_index, track_id, '{j}' AS joint, {r(f'x{i}', 'x')}, {r(f'y{i}', 'y')}, {r(f'c{i}', 'conf')} FROM pose" for i, j in enumerate(sk.COCO17))
_PLACES = " || chr(9) || ".join(f"printf('%.6f', {_E(i)})" for i in range(51))
SQL["trc_rows"] = f"SELECT vec_id, vec_id::VARCHAR || chr(9) || printf('%.6f', vec_id / 60.0e0) || chr(9) || {_PLACES} AS line FROM embeddings"
