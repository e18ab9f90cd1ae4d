"""Named queries over the generic tables, each with its SQL form where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.config import CLASSES
from kerbside.functions import geometry as G
from kerbside.functions import safety as S
from kerbside.operators import clusters, events, features, interactions, kinematics, movement, spatial, traffic
from kerbside.plans import sql as Q
from kerbside.sources.points import points, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the last bits of other engines' functions don't matter."""
    # adding zero turns a negative zero into a plain one
    return df.select(*[(_round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _round(v: Column, digits: int) -> Column:
    """``F.round``, which makes a decimal of each value, only for those that are large or about half way between two results."""
    unit = 10.0**digits
    low = F.floor(v * unit)
    over = v * unit - low
    clear = (F.abs(v) < 1e11 / unit) & (F.abs(over - 0.5) > 1e-3)
    return F.when(clear, (low + F.when(over > 0.5, 1).otherwise(0)) / F.lit(unit)).otherwise(F.round(v, digits))


def kin(spark, d):
    return kinematics.kinematics(points(spark, d))


def tracks(spark, d):
    return kinematics.tracks(kin(spark, d))


def _r(columns: str) -> str:
    """A select list in which names that end with ~ are rounded."""
    return ", ".join(f"round({c[:-1]}, 4) + 0.0 AS {c[:-1]}" if c.endswith("~") else c for c in (x.strip() for x in columns.split(",")))


@query("points_scan", f"WITH {Q.PTS} SELECT {_r('track_id, frame_id, timestamp_s~, class_name, event_type, x~, y~')} FROM pts")
def points_scan(spark, d):
    return rounded(points(spark, d))


@query("class_map", """SELECT event_id, coalesce(map{'click':'CAR','view':'LGV','purchase':'BUS','error':'PEDESTRIAN'}[lower(event_type)], 'UNKNOWN') AS class_name FROM events""")
def class_map(spark, d):
    extra = {"Click": "CAR", "view ": "LGV", "purchase": "BUS", "error": "PEDESTRIAN"}
    return table(spark, d, "events").select("event_id", S.map_class(F.col("event_type"), extra).alias("class_name"))


@query("detections_filter", """SELECT event_id, CASE WHEN value / 100.0 >= 0.5 THEN 'high' ELSE 'low' END AS band FROM events WHERE value / 100.0 >= 0.15""")
def detections_filter(spark, d):
    c = F.col("value") / 100.0
    return table(spark, d, "events").where(c >= 0.15).select("event_id", F.when(c >= 0.5, "high").otherwise("low").alias("band"))


@query("world_transform_scale", f"WITH {Q.PTS} SELECT track_id, frame_id, round((x - 10) * 0.1, 4) AS wx, round((y - 10) * 0.1, 4) AS wy FROM pts")
def world_transform_scale(spark, d):
    wx, wy = G.scale_to_world(F.col("x"), F.col("y"), 0.1, (10.0, 10.0))
    return rounded(points(spark, d).select("track_id", "frame_id", wx.alias("wx"), wy.alias("wy")))


_H = ((2.0, 0.1, 5.0), (0.2, 2.0, 10.0), (0.001, 0.002, 1.0))


@query("world_transform_homography", f"WITH {Q.PTS} SELECT track_id, frame_id, round((2 * x + 0.1 * y + 5) / (0.001 * x + 0.002 * y + 1), 4) AS wx, round((0.2 * x + 2 * y + 10) / (0.001 * x + 0.002 * y + 1), 4) AS wy FROM pts")
def world_transform_homography(spark, d):
    wx, wy = G.project(F.col("x"), F.col("y"), _H)
    return rounded(points(spark, d).select("track_id", "frame_id", wx.alias("wx"), wy.alias("wy")))


_KIN = "track_id, frame_id, vx~, vy~, speed_mps~, speed_kmh~, accel~, ax~, ay~, jerk~, heading_deg~, omega~"


@query("kinematics", f"WITH {Q.KIN} SELECT {_r(_KIN)} FROM kin")
def kinematics_query(spark, d):
    return rounded(kin(spark, d).select(*[c.strip("~ ") for c in _KIN.split(",")]))


_TRK = "track_id, class_name, n_points, start_frame, end_frame, start_s~, end_s~, duration_s~, missing_ratio~, mean_kmh~, max_kmh~, dwell_s~, distance_m~, max_accel~, max_decel~, quality_score~"


@query("trajectory_quality", f"WITH {Q.TRK} SELECT {_r(_TRK)}, n_points >= 10 AND quality_score >= 0.4 AS is_valid FROM trk")
def trajectory_quality(spark, d):
    return rounded(tracks(spark, d))


@query("min_track_length", f"WITH {Q.PTS} SELECT track_id, count(*) AS n FROM pts GROUP BY track_id HAVING count(*) >= 60")
def min_track_length(spark, d):
    return points(spark, d).groupBy("track_id").agg(F.count("*").alias("n")).where("n >= 60")


@query("majority_class", f"WITH {Q.PTS}, c AS (SELECT track_id, event_type, count(*) AS n, min(frame_id) AS f FROM pts GROUP BY ALL) SELECT track_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, f, event_type) = 1")
def majority_class(spark, d):
    return kinematics.majority_class(points(spark, d), "event_type")


@query("class_speed_stats", f"""WITH {Q.TRK}, p AS (SELECT class_name, avg(speed_kmh) AS mean_speed_kmh, quantile_cont(speed_kmh, 0.5) AS median_speed_kmh, quantile_cont(speed_kmh, 0.85) AS p85_speed_kmh, max(speed_kmh) AS max_speed_kmh FROM kin GROUP BY class_name)
SELECT class_name, count(*) AS count, round(avg(duration_s), 4) AS mean_duration_s, round(avg(distance_m), 4) AS mean_distance_m, round(max(max_accel), 4) AS max_accel_mps2, round(min(max_decel), 4) AS max_decel_mps2,
 round(any_value(mean_speed_kmh), 4) AS mean_speed_kmh, round(any_value(median_speed_kmh), 4) AS median_speed_kmh, round(any_value(p85_speed_kmh), 4) AS p85_speed_kmh, round(any_value(max_speed_kmh), 4) AS max_speed_kmh
 FROM trk JOIN p USING (class_name) GROUP BY class_name""")
def class_speed_stats(spark, d):
    k = kin(spark, d)
    return rounded(traffic.speed_by_class(k, kinematics.tracks(k)))


@query("congestion", f"""WITH {Q.KIN} SELECT round(avg(speed_kmh), 4) AS mean_kmh, round(quantile_cont(speed_kmh, 0.5), 4) AS median_kmh, round(stddev_pop(speed_kmh), 4) AS std_kmh, round(quantile_cont(speed_kmh, 0.85), 4) AS p85_kmh, count(DISTINCT track_id) AS total_vehicles,
 CASE WHEN avg(speed_kmh) >= 50 THEN 'FREE_FLOW' WHEN avg(speed_kmh) >= 35 THEN 'MILD' WHEN avg(speed_kmh) >= 20 THEN 'MODERATE' WHEN avg(speed_kmh) >= 10 THEN 'SEVERE' ELSE 'STOPPED' END AS level FROM kin""")
def congestion(spark, d):
    return rounded(traffic.congestion(kin(spark, d)))


_CONS = f"""{Q.TRK}, cs AS (SELECT count(*) AS n, avg(CASE WHEN n_points >= 10 AND quality_score >= 0.4 THEN 1.0 ELSE 0.0 END) AS vr, avg(duration_s) AS dur, avg(missing_ratio) AS mr, avg(quality_score) AS q,
 avg(CASE WHEN max_kmh <= 180 AND max_accel <= 12 AND max_decel >= -15 THEN 1.0 ELSE 0.0 END) AS pl FROM trk), cj AS (SELECT coalesce(avg(abs(jerk)), 0.0) AS j FROM kin),
 co AS (SELECT *, 0.35 * q + 0.35 * pl + 0.20 * vr + 0.10 * greatest(0.0, 1.0 - j / 50.0) AS s FROM cs, cj)"""


@query("consistency_eval", f"""WITH {_CONS} SELECT round(s, 4) AS overall_quality_score, round(vr, 4) AS valid_trajectory_ratio, n AS total_reconstructed_trajectories, round(dur, 2) AS mean_track_duration_s, round(mr, 4) AS mean_missing_ratio,
 round(pl, 4) AS physical_plausibility_rate, round(j, 3) AS mean_jerk_energy, CAST(0.0 AS DOUBLE) AS camera_stabilization_residual_px, CASE WHEN s >= 0.85 THEN 'EXCELLENT' WHEN s >= 0.7 THEN 'GOOD' WHEN s >= 0.5 THEN 'FAIR' ELSE 'POOR' END AS data_confidence_grade FROM co""")
def consistency_eval(spark, d):
    k = kin(spark, d)
    return traffic.consistency(k, kinematics.tracks(k))


@query("auto_zones", f"WITH {Q.ZON} SELECT {_r('ord, name, xmin~, xmax~, ymin~, ymax~')} FROM zones")
def auto_zones(spark, d):
    return rounded(movement.auto_zones(points(spark, d)))


def _ends(spark, d):
    p = points(spark, d)
    return movement.entry_exit(p, movement.auto_zones(p))


@query("entry_exit", f"WITH {Q.ZON} SELECT * FROM ee")
def entry_exit(spark, d):
    return _ends(spark, d)


@query("zone_visits", f"WITH {Q.ZON} SELECT DISTINCT track_id, name FROM pts JOIN zones ON x > xmin AND x < xmax AND y > ymin AND y < ymax")
def zone_visits(spark, d):
    p = points(spark, d)
    return movement.in_zone(p, movement.auto_zones(p))


@query("polygon_entry_exit", f"WITH {Q.ZON} SELECT track_id, CASE WHEN x0 >= 0 AND y0 >= 0 AND x0 + y0 < 60 THEN 'Triangle' END AS origin_zone, CASE WHEN x1 >= 0 AND y1 >= 0 AND x1 + y1 < 60 THEN 'Triangle' END AS destination_zone FROM ends")
def polygon_entry_exit(spark, d):
    """The even-odd rule of ``in_polygon`` counts the left and lower edges of this triangle as inside, its slope as outside."""
    return movement.entry_exit(points(spark, d), movement.polygon_zones(spark, [("Triangle", [(0, 0), (60, 0), (0, 60)])]))


@query("movement_types", f"WITH {Q.ZON} SELECT * FROM mov")
def movement_types(spark, d):
    k = kin(spark, d)
    return movement.movement_types(k, kinematics.tracks(k))


@query("turning_matrix", f"WITH {Q.ZON} SELECT coalesce(origin_zone, 'Unknown_Origin') AS origin_zone, coalesce(destination_zone, 'Unknown_Destination') AS destination_zone, movement_type, count(*) AS count FROM mov JOIN ee USING (track_id) GROUP BY 1, 2, 3")
def turning_matrix(spark, d):
    k = kin(spark, d)
    return movement.turning_matrix(movement.movement_types(k, kinematics.tracks(k)), _ends(spark, d))


_OD = f"{Q.ZON}, od AS (SELECT coalesce(origin_zone, 'Origin_Unknown') AS o, coalesce(destination_zone, 'Dest_Unknown') AS t FROM ee), cube AS (SELECT CASE WHEN grouping(o) = 1 THEN 'Total' ELSE o END AS origin, CASE WHEN grouping(t) = 1 THEN 'Total' ELSE t END AS destination, count(*) AS n FROM od GROUP BY CUBE (o, t))"


@query("od_matrix", f"WITH {_OD} SELECT * FROM cube")
def od_matrix(spark, d):
    return movement.od_matrix(_ends(spark, d))


@query("od_table", f"WITH {_OD} SELECT origin, " + ", ".join(f'CAST(coalesce(sum(n) FILTER (destination = \'{x}\'), 0) AS BIGINT) AS "{x}"' for x in (*Q.DESTINATIONS, "Dest_Unknown", "Total")) + " FROM cube GROUP BY origin")
def od_table(spark, d):
    return movement.od_table(_ends(spark, d), [*Q.DESTINATIONS, "Dest_Unknown"])


_BIN = 24.0


@query("flow_bins", f"WITH {Q.TRK}{Q.bins(_BIN)} SELECT bin, round(any_value(w0), 4) AS bin_start_s, round(any_value(w1), 4) AS bin_end_s, count(t.track_id) AS vehicle_count, round(count(t.track_id) * CAST({3600 / _BIN} AS DOUBLE), 4) AS flow_rate_veh_hr, " + ", ".join(f"count(*) FILTER (t.class_name = '{c}') AS {c}" for c in CLASSES) + " FROM bin b LEFT JOIN trk t ON NOT (t.end_s < b.w0 OR t.start_s > b.w1) GROUP BY bin")
def flow_bins(spark, d):
    return rounded(traffic.flow(tracks(spark, d), _BIN))


@query("interaction_edges", f"WITH {Q.EDG} SELECT {_r('frame_id, track_a, track_b, class_a, class_b, distance_m~, relative_speed_mps~, closing_speed_mps~, heading_diff_deg~')} FROM edg")
def interaction_edges(spark, d):
    return rounded(interactions.edges(kin(spark, d)).select("frame_id", "track_a", "track_b", "class_a", "class_b", "distance_m", "relative_speed_mps", "closing_speed_mps", "heading_diff_deg"))


_CON = "frame_id, timestamp_s~, track_a, track_b, class_a, class_b, conflict_type, severity, ttc_s~, drac_mps2~, distance_m~, relative_speed_mps~, closing_speed_mps~, mid_x~, mid_y~"


def conflicts(spark, d, columns=None):
    return interactions.conflicts(kin(spark, d), columns=columns)


@query("conflicts", f"WITH {Q.CON} SELECT {_r(_CON)} FROM con")
def conflicts_query(spark, d):
    return rounded(conflicts(spark, d))


@query("conflict_ids", f"WITH {Q.CON} SELECT 'CONF_' || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INT), '0') AS event_id, frame_id, track_a, track_b FROM (SELECT *, row_number() OVER (ORDER BY frame_id, track_a, track_b) AS k FROM con)")
def conflict_ids(spark, d):
    return interactions.named(conflicts(spark, d, ["frame_id", "track_a", "track_b"]), "CONF_", ["frame_id", "track_a", "track_b"]).select("event_id", "frame_id", "track_a", "track_b")


@query("conflict_severity_counts", f"WITH {Q.CON} SELECT severity, conflict_type, count(*) AS n FROM con GROUP BY ALL")
def conflict_severity_counts(spark, d):
    return conflicts(spark, d, ["severity", "conflict_type"]).groupBy("severity", "conflict_type").agg(F.count("*").alias("n"))


@query("conflict_topk", f"WITH {Q.CON} SELECT frame_id, track_a, track_b, severity FROM con ORDER BY frame_id, track_a, track_b LIMIT 12")
def conflict_topk(spark, d):
    return interactions.first_conflicts(kin(spark, d), 12).select("frame_id", "track_a", "track_b", "severity")


@query("pet_pairs", f"""WITH {Q.PTS}, g AS (SELECT *, CAST(floor(x / 2.0) AS BIGINT) AS cx, CAST(floor(y / 2.0) AS BIGINT) AS cy FROM pts), a AS (SELECT cx, cy, track_id, max_by(timestamp_s, frame_id) AS ta FROM g GROUP BY ALL)
SELECT a.track_id AS track_a, g.track_id AS track_b, round(min(abs(g.timestamp_s - ta)), 4) AS pet_s FROM a JOIN g ON a.cx = g.cx AND a.cy = g.cy AND a.track_id < g.track_id WHERE abs(g.timestamp_s - ta) <= 5.0 GROUP BY 1, 2""")
def pet_pairs(spark, d):
    return rounded(interactions.pet_pairs(points(spark, d)))


_EVT = "event_type, track_id, other_id, class_name, start_s~, end_s~, start_frame, end_frame, severity, confidence, x~, y~, measure~, speed_kmh~"


def _event_query(rule: str):
    @query(f"ev_{rule}", f"WITH {Q.EVT} SELECT {_r(_EVT)} FROM {rule}")
    def run(spark, d):
        k = kin(spark, d)
        return rounded(events._DETECTORS[rule](k, kinematics.tracks(k), events.Events()).drop("description"))


for _rule in Q.RULES:
    _event_query(_rule)


def all_events(spark, d):
    k = kin(spark, d)
    return events.detect_all(k, kinematics.tracks(k))


@query("events_union", f"WITH {Q.EVT} SELECT {_r(_EVT)} FROM ({Q.UNION})")
def events_union(spark, d):
    return rounded(all_events(spark, d).drop("description"))


@query("event_counts", f"WITH {Q.EVT} SELECT event_type, severity, count(*) AS n FROM ({Q.UNION}) GROUP BY ALL")
def event_counts(spark, d):
    return all_events(spark, d).groupBy("event_type", "severity").agg(F.count("*").alias("n"))


@query("temporal_windows", f"""WITH {Q.EVT}{Q.bins(_BIN)}, act AS ({Q._HITS}), ev AS ({Q.UNION}),
 con0 AS (WITH {Q.CON} SELECT timestamp_s FROM con)
SELECT b.bin, round(w0, 4) AS window_start_s, round(w1, 4) AS window_end_s, act.c AS active_vehicle_count,
 round(coalesce((SELECT avg(speed_kmh) FROM kin WHERE floor((timestamp_s - b.t0) / {_BIN}) = b.bin), 0.0), 4) AS mean_speed_kmh,
 (SELECT count(*) FROM con0 WHERE floor((timestamp_s - b.t0) / {_BIN}) = b.bin) AS conflict_count, (SELECT count(*) FROM ev WHERE floor((start_s - b.t0) / {_BIN}) = b.bin) AS event_count FROM bin b JOIN act USING (bin)""")
def temporal_windows(spark, d):
    k = kin(spark, d)
    return rounded(traffic.windows(kinematics.tracks(k), k, interactions.conflicts(k, columns=["timestamp_s"]), all_events(spark, d), _BIN))


@query("summary_counts")
def summary_counts(spark, d):
    k = kin(spark, d)
    t = kinematics.tracks(k)
    return traffic.summary(t, interactions.conflicts(k, columns=["conflict_type", "severity"]), events.detect_all(k, t), traffic.congestion(k), traffic.consistency(k, t))


@query("queues", f"""WITH RECURSIVE {Q.KIN}, slow AS (SELECT frame_id, track_id, x, y, timestamp_s FROM kin WHERE speed_kmh <= 5.0),
 nb AS (SELECT a.frame_id, a.track_id AS a, b.track_id AS b FROM slow a JOIN slow b ON a.frame_id = b.frame_id AND a.track_id <> b.track_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 8.0),
 reach(frame_id, a, b) AS (SELECT frame_id, a, b FROM nb UNION SELECT r.frame_id, r.a, n.b FROM reach r JOIN nb n ON r.frame_id = n.frame_id AND r.b = n.a),
 comp AS (SELECT frame_id, a AS track_id, least(a, min(b)) AS c FROM reach GROUP BY frame_id, a),
 mem AS (SELECT comp.*, s.x, s.y, s.timestamp_s FROM comp JOIN slow s USING (frame_id, track_id)),
 len AS (SELECT p.frame_id, p.c, max(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS l FROM mem p JOIN mem q ON p.frame_id = q.frame_id AND p.c = q.c GROUP BY 1, 2)
SELECT 'Queue_F' || frame_id || '_C' || c AS queue_id, frame_id, round(min(timestamp_s), 4) AS timestamp_s, count(*) AS vehicle_count, round(any_value(l), 4) AS queue_length_m, string_agg(track_id, ',' ORDER BY track_id) AS involved_vehicles FROM mem JOIN len USING (frame_id, c) GROUP BY frame_id, c""")
def queues(spark, d):
    return rounded(clusters.queues(kin(spark, d)).drop("head_x", "head_y", "tail_x", "tail_y"))


def _heat(value: str, source: str, n: int, sigma: float, unit: bool, cte: str, over: str = "pts") -> str:
    w = spatial.kernel(sigma)
    r = len(w) // 2
    rows = ", ".join(f"({k - r}, {x!r})" for k, x in enumerate(w))
    cell = lambda v, a: f"CAST(greatest(0, least({n - 1}, floor(({v} - l{a}) / CASE WHEN h{a} > l{a} THEN h{a} - l{a} ELSE 1.0 END * {n}))) AS INT)"
    fold = lambda c: f"CASE WHEN ({c} + d + {4 * n}) % {2 * n} < {n} THEN ({c} + d + {4 * n}) % {2 * n} ELSE {2 * n - 1} - ({c} + d + {4 * n}) % {2 * n} END"
    return f"""WITH {cte}, ker(d, w) AS (VALUES {rows}), bnd AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM {over}),
 c0 AS (SELECT {cell('y', 'y')} AS "row", {cell('x', 'x')} AS col, {value} AS v FROM {source}, bnd GROUP BY 1, 2),
 b1 AS (SELECT CAST({fold('"row"')} AS INT) AS "row", col, sum(v * w) AS v FROM c0, ker GROUP BY 1, 2), b2 AS (SELECT "row", CAST({fold('col')} AS INT) AS col, sum(v * w) AS v FROM b1, ker GROUP BY 1, 2),
 g AS (SELECT CAST(i AS INT) AS "row", CAST(j AS INT) AS col FROM range({n}) t(i), range({n}) u(j))
SELECT g."row", g.col, round(coalesce(v{' / (SELECT max(v) FROM b2)' if unit else ''}, 0.0), 4) AS v FROM g LEFT JOIN b2 ON g."row" = b2."row" AND g.col = b2.col"""


@query("heatmap_density", _heat("CAST(count(*) AS DOUBLE)", "pts", 100, 2.0, True, Q.PTS))
def heatmap_density(spark, d):
    return rounded(spatial.density(points(spark, d)))


@query("heatmap_speed", _heat("avg(speed_kmh)", "kin", 100, 2.0, False, Q.KIN, "kin"))
def heatmap_speed(spark, d):
    return rounded(spatial.speed(kin(spark, d)))


@query("heatmap_conflict", _heat("sum(CASE severity WHEN 'CRITICAL' THEN 3.0 WHEN 'HIGH' THEN 2.0 ELSE 1.0 END)", "(SELECT mid_x AS x, mid_y AS y, severity FROM con)", 100, 2.5, True, Q.CON))
def heatmap_conflict(spark, d):
    return rounded(spatial.conflict_risk(conflicts(spark, d, ["mid_x", "mid_y", "severity"]), points(spark, d)))


@query("speed_histogram", f"""WITH {Q.KIN}, b AS (SELECT min(speed_kmh) AS lo, max(speed_kmh) AS hi FROM kin), c AS (SELECT CAST(least(39, floor((speed_kmh - lo) / (hi - lo) * 40)) AS INT) AS bin, count(*) AS n FROM kin, b GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * (hi - lo) / 40, 4) AS lo, round(lo + (i + 1) * (hi - lo) / 40, 4) AS hi, coalesce(n, 0) AS n FROM range(40) t(i) CROSS JOIN b LEFT JOIN c ON c.bin = i""")
def speed_histogram(spark, d):
    return rounded(spatial.histogram(kin(spark, d), "speed_kmh", 40))


@query("overlay_trails", f"WITH {Q.PTS} SELECT track_id, frame_id, count(*) OVER w AS n, round(sum(x) OVER w, 4) AS sx FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY frame_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def overlay_trails(spark, d):
    t = spatial.trails(points(spark, d))
    return rounded(t.select("track_id", "frame_id", F.size("trail").cast("bigint").alias("n"), F.aggregate("trail", F.lit(0.0), lambda a, p: a + p["x"]).alias("sx")))


_SECTORS = ", ".join(f"count(*) FILTER (heading_deg >= {45 * k} AND heading_deg < {45 * k + 45}) AS s{k}" for k in range(8))
_ENTROPY = " + ".join(f"CASE WHEN s{k} > 0 THEN -(s{k} / CAST(n AS DOUBLE)) * ln(s{k} / CAST(n AS DOUBLE)) ELSE 0.0 END" for k in range(8))
_FTR = Q.KIN + f""", f0 AS (SELECT track_id, count(*) AS n, max(timestamp_s) - min(timestamp_s) AS duration_s, sum(step) AS path, first(x ORDER BY frame_id) AS start_x, first(y ORDER BY frame_id) AS start_y, last(x ORDER BY frame_id) AS end_x, last(y ORDER BY frame_id) AS end_y,
 avg(speed_mps) AS mean_speed_mps, quantile_cont(speed_mps, 0.5) AS median_speed_mps, stddev_pop(speed_mps) AS std_speed_mps, max(speed_mps) AS max_speed_mps, quantile_cont(speed_mps, 0.85) AS p85_speed_mps, avg(accel) AS mean_accel_mps2, greatest(max(accel), 0.0) AS max_accel_mps2, least(min(accel), 0.0) AS max_decel_mps2,
 avg(abs(jerk)) AS mean_jerk_mps3, avg(jerk * jerk) AS jerk_energy, sum(abs(dh)) AS turn, avg(abs(omega)) AS mean_angular_velocity_degps, max(abs(omega)) AS max_angular_velocity_degps, count(*) FILTER (speed_mps < 0.8) / CAST(count(*) AS DOUBLE) AS dwell_time_ratio, {_SECTORS} FROM kin GROUP BY track_id),
 f1 AS (SELECT f0.*, sqrt(power(end_x - start_x, 2) + power(end_y - start_y, 2)) AS net_displacement_m, m2, m3, m4 FROM f0 JOIN (SELECT track_id, avg(power(accel - a, 2)) AS m2, avg(power(accel - a, 3)) AS m3, avg(power(accel - a, 4)) AS m4 FROM kin JOIN (SELECT track_id, avg(accel) AS a FROM kin GROUP BY 1) USING (track_id) GROUP BY 1) USING (track_id)),
 f2 AS (SELECT *, greatest(1e-3, CASE WHEN path > 0 THEN path ELSE net_displacement_m END) AS total_distance_m FROM f1),
 ftr AS (SELECT track_id, n, duration_s, total_distance_m, net_displacement_m, total_distance_m / greatest(1e-3, net_displacement_m) AS tortuosity_ratio, mean_speed_mps, median_speed_mps, std_speed_mps, max_speed_mps, p85_speed_mps, mean_accel_mps2, max_accel_mps2, max_decel_mps2, CASE WHEN n > 3 AND std_speed_mps > 1e-4 AND m2 > 0 THEN m3 / power(m2, 1.5) ELSE 0.0 END AS accel_skewness,
 CASE WHEN n > 3 AND std_speed_mps > 1e-4 AND m2 > 0 THEN m4 / (m2 * m2) - 3.0 ELSE 0.0 END AS accel_kurtosis, mean_jerk_mps3, jerk_energy, CASE WHEN n > 2 THEN turn ELSE 0.0 END AS total_turning_angle_deg, mean_angular_velocity_degps, max_angular_velocity_degps, CASE WHEN n > 2 THEN {_ENTROPY} ELSE 0.0 END AS heading_entropy, dwell_time_ratio, start_x, start_y, end_x, end_y FROM f2)"""


def track_features(spark, d):
    return features.track_features(kin(spark, d))


@query("traj_features", f"WITH {_FTR} SELECT track_id, " + ", ".join(f"round(CASE WHEN n < 2 THEN 0.0 ELSE {c} END, 3) AS {c}" for c in features.FEATURES) + " FROM ftr")
def traj_features(spark, d):
    return rounded(track_features(spark, d), 3)


@query("feature_scale", f"WITH {_FTR} SELECT track_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN stddev_pop({c}) OVER () ELSE 1.0 END, 3) AS {c}" for c in features.FEATURES) + " FROM ftr")
def feature_scale(spark, d):
    return rounded(features.scaled(track_features(spark, d)), 3)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("lof_scores", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.id <> b.id),
 nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM d QUALIFY r <= 20), kd AS (SELECT id, d AS kd FROM nn WHERE r = 20),
 lrd AS (SELECT nn.id, 1.0 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS den FROM nn JOIN kd ON nn.other = kd.id GROUP BY nn.id)
SELECT nn.id, round(avg(o.den) / any_value(l.den), 4) AS lof FROM nn JOIN lrd o ON nn.other = o.id JOIN lrd l ON nn.id = l.id GROUP BY nn.id""")
def lof_scores(spark, d):
    return rounded(features.lof(_vectors(spark, d), 20))


@query("cosine_distance", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.id AS id_a, b.id AS id_b, round(greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(a.v, b.v))), 4) AS d FROM v a, v b WHERE a.id % 50 = 0""")
def cosine_distance(spark, d):
    v = _vectors(spark, d)
    return rounded(features.cosine_pairs(v.where("id % 50 = 0"), v))


@query("dbscan_labels", f"""WITH RECURSIVE {Q.PTS}, p AS (SELECT track_id, frame_id, x, y FROM pts), nb AS (SELECT a.frame_id, a.track_id AS a, b.track_id AS b FROM p a JOIN p b ON a.frame_id = b.frame_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 10.0),
 core AS (SELECT frame_id, a FROM nb GROUP BY 1, 2 HAVING count(*) >= 3), cc AS (SELECT n.* FROM nb n JOIN core c ON n.frame_id = c.frame_id AND n.a = c.a JOIN core e ON n.frame_id = e.frame_id AND n.b = e.a),
 reach(frame_id, a, b) AS (SELECT * FROM cc UNION SELECT r.frame_id, r.a, c.b FROM reach r JOIN cc c ON r.frame_id = c.frame_id AND r.b = c.a), lab AS (SELECT frame_id, a, min(b) AS c FROM reach GROUP BY 1, 2),
 bor AS (SELECT n.frame_id, n.a, min(l.c) AS c FROM nb n JOIN lab l ON n.frame_id = l.frame_id AND n.b = l.a GROUP BY 1, 2)
SELECT p.frame_id, p.track_id, coalesce(lab.c, bor.c) AS cluster FROM p LEFT JOIN lab ON p.frame_id = lab.frame_id AND p.track_id = lab.a LEFT JOIN bor ON p.frame_id = bor.frame_id AND p.track_id = bor.a""")
def dbscan_labels(spark, d):
    p = points(spark, d).select("frame_id", "track_id", "x", "y", F.struct("frame_id", "track_id").alias("id"))
    return clusters.dbscan(p, 10.0, 3, ["frame_id"]).select("frame_id", "track_id", F.col("cluster.track_id").alias("cluster"))


@query("pca_embed")
def pca_embed(spark, d):
    return features.pca(track_features(spark, d))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return features.kmeans(features.pca(track_features(spark, d)), 5, columns=["pca_1", "pca_2", "pca_3"])


@query("cluster_summary")
def cluster_summary(spark, d):
    e = features.pca(track_features(spark, d))
    columns = ["pca_1", "pca_2", "pca_3"]
    return features.cluster_summary(features.kmeans(e, 5, columns=columns), e, tracks(spark, d), columns)


@query("iforest_scores")
def iforest_scores(spark, d):
    return features.anomalies(features.isolation_scores(track_features(spark, d)), tracks(spark, d))


@query("iou_pairs", """WITH p AS (SELECT p_partkey AS id, p_partkey % 50 AS f, (p_partkey * 37) % 100 AS x, (p_partkey * 53) % 100 AS y, p_size AS s FROM part), i AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x + a.s, b.x + b.s) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.s, b.y + b.s) - greatest(a.y, b.y)) AS n, a.s * a.s + b.s * b.s AS t FROM p a JOIN p b ON a.f = b.f AND a.id < b.id)
SELECT a, b, round(CASE WHEN t - n > 0 THEN n / CAST(t - n AS DOUBLE) ELSE 0.0 END, 4) AS iou FROM i""")
def iou_pairs(spark, d):
    from kerbside.operators.detection import overlapping

    # rounded by the operator: once for two places, not for each pair
    return overlapping(boxes(spark, d), 4)


def boxes(spark, d):
    """Detections made of the part table: 50 frames of overlapping boxes."""
    k = F.col("p_partkey")
    x, y, s = ((k * 37) % 100).cast("double"), ((k * 53) % 100).cast("double"), F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        k.alias("det_id"), (k % 50).alias("frame_id"), ((k % 50) / 10.0).alias("timestamp_s"), x.alias("x1"), y.alias("y1"), (x + s).alias("x2"), (y + s).alias("y2"),
        ((k * 29) % 101 / 100.0).alias("confidence"), F.when(k % 2 == 0, "CAR").otherwise("PEDESTRIAN").alias("class_name"),
    )


@query("slice_grid", "SELECT id, tx1, ty1, least(tx1 + 640, w) AS tx2, least(ty1 + 640, h) AS ty2 FROM (SELECT DISTINCT p_partkey AS id, 800 + p_size * 10 AS w, 600 + p_size * 5 AS h, greatest(0, least(i, 800 + p_size * 10 - 640)) AS tx1, greatest(0, least(j, 600 + p_size * 5 - 640)) AS ty1 FROM part, LATERAL (SELECT unnest(range(0, 800 + p_size * 10, 512)) AS i), LATERAL (SELECT unnest(range(0, 600 + p_size * 5, 512)) AS j))")
def slice_grid(spark, d):
    from kerbside.operators.detection import tiles

    images = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.lit(800) + F.col("p_size") * 10).alias("width"), (F.lit(600) + F.col("p_size") * 5).alias("height"))
    return tiles(images).select("id", *[F.col(c).cast("bigint").alias(c) for c in ("tx1", "ty1", "tx2", "ty2")])


@query("nms")
def nms(spark, d):
    from kerbside.operators.detection import suppress

    return suppress(boxes(spark, d))


@query("nmm")
def nmm(spark, d):
    from kerbside.operators.detection import merge

    return merge(boxes(spark, d))


def _sources(spark, d):
    return boxes(spark, d).withColumn("source_id", F.concat(F.lit("s"), (F.col("det_id") % 3).cast("string")))


@query("track_bytetrack")
def track_bytetrack(spark, d):
    from kerbside.operators.tracking import track

    return track(_sources(spark, d))


@query("track_botsort")
def track_botsort(spark, d):
    from kerbside.operators.tracking import track

    # embeddings are dealt to the boxes in turn, as there are fewer of them
    e = table(spark, d, "embeddings")
    looks = e.select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("look"))
    n = e.agg(F.greatest(F.max("vec_id") + 1, F.lit(1)).alias("_n"))
    found = _sources(spark, d).crossJoin(F.broadcast(n)).withColumn("_vec", F.pmod(F.col("det_id") - 1, F.col("_n")))
    return track(found.join(looks, "_vec", "left").drop("_vec", "_n"), appearance=True)


@query("kalman_smooth")
def kalman_smooth(spark, d):
    from kerbside.operators.smoothing import smooth

    return rounded(smooth(points(spark, d), "kalman"))


@query("savgol_smooth")
def savgol_smooth(spark, d):
    from kerbside.operators.smoothing import smooth

    return rounded(smooth(points(spark, d), "savitzky_golay"))


@query("build_trajectories")
def build_trajectories(spark, d):
    from kerbside.operators.smoothing import build_trajectories as build

    p = points(spark, d)
    obs = p.select("track_id", "frame_id", "timestamp_s", F.col("event_type").alias("class_name"), (F.col("x") - 2).alias("x1"), (F.col("y") - 1).alias("y1"), (F.col("x") + 2).alias("x2"), (F.col("y") + 1).alias("y2"))
    return rounded(build(obs)[1])


@query("lane_centerlines")
def lane_centerlines(spark, d):
    from kerbside.operators.camera import lane_lines

    k = kin(spark, d)
    return lane_lines(k, kinematics.tracks(k))


@query("telemetry_asof", f"""WITH {Q.PTS}, r AS (SELECT track_id, timestamp_s AS t, x AS alt FROM pts WHERE event_type = 'view'), l AS (SELECT track_id, frame_id, timestamp_s AS t FROM pts WHERE event_type = 'click'),
 b AS (SELECT l.*, r.t AS bt, r.alt AS ba FROM l ASOF LEFT JOIN r ON l.track_id = r.track_id AND l.t >= r.t), a AS (SELECT b.*, r.t AS nt, r.alt AS na FROM b ASOF LEFT JOIN r ON b.track_id = r.track_id AND b.t <= r.t)
SELECT track_id, frame_id, round(CASE WHEN nt IS NULL OR (bt IS NOT NULL AND t - bt <= nt - t) THEN ba ELSE na END, 4) + 0.0 AS alt FROM a""")
def telemetry_asof(spark, d):
    from kerbside.sources.telemetry import nearest

    p = points(spark, d)
    left = p.where("event_type = 'click'").select("track_id", "frame_id", "timestamp_s")
    right = p.where("event_type = 'view'").select("track_id", "timestamp_s", F.col("x").alias("alt"))
    return rounded(nearest(left, right, "timestamp_s", ["track_id"], ["alt"]).select("track_id", "frame_id", "alt"))


_AGENTS = ", ".join(map(str, [(1, "CAR", 100.0, 340.0), (2, "CAR", 40.0, 340.0), (3, "TRUCK", 620.0, 50.0), (4, "CAR", 1180.0, 380.0), (5, "PEDESTRIAN", 560.0, 460.0), (6, "MOTORCYCLE", 80.0, 300.0), (7, "LGV", 500.0, 340.0), (8, "CAR", 1100.0, 340.0)]))


@query("scenario_points", f"""WITH a(track_id, class_name, x0, y0) AS (VALUES {_AGENTS}), s AS (SELECT a.*, CAST(f AS BIGINT) AS frame_id,
 x0 + sum(CASE track_id WHEN 1 THEN 5.6 WHEN 2 THEN CASE WHEN f < 60 THEN 10.0 WHEN f < 80 THEN 1.0 ELSE 5.0 END WHEN 4 THEN CASE WHEN f < 90 THEN -6.0 WHEN f < 130 THEN -0.5 ELSE 0.0 END WHEN 6 THEN 8.0 WHEN 8 THEN -8.0 ELSE 0.0 END) OVER w AS px,
 y0 + sum(CASE track_id WHEN 1 THEN 0.05 * sin(0.1 * f) WHEN 3 THEN 3.0 WHEN 4 THEN CASE WHEN f < 90 THEN 0.0 ELSE 6.0 END WHEN 5 THEN -1.5 WHEN 6 THEN CASE WHEN f BETWEEN 40 AND 100 THEN 1.5 ELSE 0.0 END ELSE 0.0 END) OVER w AS py
 FROM a, range(300) r(f) WINDOW w AS (PARTITION BY track_id ORDER BY f))
SELECT CAST(track_id AS BIGINT) AS track_id, class_name, frame_id, round(CAST((px + CASE WHEN track_id = 7 THEN 0 ELSE sin(0.2 * frame_id) END) * 0.05 AS DOUBLE), 4) + 0.0 AS x, round(CAST((py + CASE WHEN track_id = 7 THEN 0 ELSE cos(0.15 * frame_id) END) * 0.05 AS DOUBLE), 4) + 0.0 AS y FROM s WHERE px BETWEEN 0 AND 1280 AND py BETWEEN 0 AND 720""")
def scenario_points(spark, d):
    from kerbside.sources import scenario

    return rounded(scenario.points(spark).select("track_id", "class_name", "frame_id", "x", "y"))


@query("synthetic_telemetry", "SELECT round(f / 30.0, 4) + 0.0 AS timestamp_s, round(60 + 0.5 * sin(0.05 * f), 4) + 0.0 AS altitude_m, round(45 + 0.2 * cos(0.08 * f), 4) + 0.0 AS heading_deg FROM (SELECT CAST(i AS DOUBLE) AS f FROM range(300) t(i))")
def synthetic_telemetry(spark, d):
    from kerbside.sources.telemetry import synthetic

    return rounded(synthetic(spark).select("timestamp_s", "altitude_m", "heading_deg"))


def _stream(spark, d, name):
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


@query("stream_tumbling", "SELECT date_trunc('day', ts) AS window_start, ['CAR','LGV','HGV','BUS','TRUCK','MOTORCYCLE','PEDESTRIAN'][CAST(user_id % 7 AS INT) + 1] AS class_name, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    from kerbside.sources.points import CLASS_BY_RESIDUE
    from kerbside.streaming import trajectory as T

    e = _stream(spark, d, "events")
    classes = F.array(*[F.lit(c) for c in CLASS_BY_RESIDUE])
    p = e.select(F.col("user_id").alias("track_id"), F.get(classes, F.pmod("user_id", F.lit(7)).cast("int")).alias("class_name"), F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("ts"))
    out = T.drain(T.flow(p, size="1 day", late="0 seconds"), "kerbside_tumbling", "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "class_name", "n")


@query("stream_tracker")
def stream_tracker(spark, d):
    from kerbside.streaming import trajectory as T

    p = _stream(spark, d, "part")
    k = F.col("p_partkey")
    x, y, s = ((k * 37) % 100).cast("double"), ((k * 53) % 100).cast("double"), F.col("p_size").cast("double")
    dets = p.select(
        k.alias("det_id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source_id"), (k % 50).alias("frame_id"), ((k % 50) / 10.0).alias("timestamp_s"), x.alias("x1"), y.alias("y1"),
        (x + s).alias("x2"), (y + s).alias("y2"), ((k * 29) % 101 / 100.0).alias("confidence"), F.when(k % 2 == 0, "CAR").otherwise("PEDESTRIAN").alias("class_name"),
    )
    return T.drain(T.track(dets), "kerbside_tracker")
