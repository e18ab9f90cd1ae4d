"""SQL forms of the queries, for a database that holds the same tables."""

from __future__ import annotations

#: The points view over ``events``.
PTS = """raw AS (
  SELECT user_id AS track_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 3600 AS timestamp_s, event_type,
    CAST(value AS DOUBLE) AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, ts, event_id FROM events),
pts AS (
  SELECT track_id, CAST(floor(timestamp_s) AS BIGINT) AS frame_id, timestamp_s,
    ['CAR','LGV','HGV','BUS','TRUCK','MOTORCYCLE','PEDESTRIAN'][CAST(track_id % 7 AS INT) + 1] AS class_name, event_type, x, y
  FROM raw QUALIFY row_number() OVER (PARTITION BY track_id, floor(timestamp_s) ORDER BY ts, event_id) = 1)"""


def wrap(d: str) -> str:
    return f"((({d} + 180.0) % 360.0 + 360.0) % 360.0 - 180.0)"


def slope(v: str) -> str:
    return (
        f"(coalesce(lead({v}) OVER w, {v}) - coalesce(lag({v}) OVER w, {v})) / "
        "greatest(1e-4, coalesce(lead(timestamp_s) OVER w, timestamp_s) - coalesce(lag(timestamp_s) OVER w, timestamp_s))"
    )


W = "WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)"
INNER = "/ greatest(1e-4, lead(timestamp_s) OVER w - lag(timestamp_s) OVER w), 0.0)"
#: Points with their kinematics.
KIN = PTS + f""",
k1 AS (SELECT *, {slope('x')} AS vx, {slope('y')} AS vy FROM pts {W}),
k2 AS (SELECT *, least(sqrt(vx * vx + vy * vy), 60.0) AS speed_mps,
  CASE WHEN abs(vx) < 1e-6 AND abs(vy) < 1e-6 THEN 0.0 ELSE ((degrees(atan2(vy, vx)) + 360.0) % 360.0 + 360.0) % 360.0 END AS heading_deg FROM k1),
k3 AS (SELECT *, speed_mps * 3.6 AS speed_kmh, greatest(-15.0, least(15.0, {slope('speed_mps')})) AS accel,
  greatest(-15.0, least(15.0, {slope('vx')})) AS ax, greatest(-15.0, least(15.0, {slope('vy')})) AS ay FROM k2 {W}),
kin AS (SELECT *, coalesce((lead(accel) OVER w - lag(accel) OVER w) {INNER} AS jerk,
  coalesce({wrap('(lead(heading_deg) OVER w - lag(heading_deg) OVER w)')} {INNER} AS omega,
  sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step, row_number() OVER w AS k, count(*) OVER (PARTITION BY track_id) AS n,
  {wrap('(heading_deg - lag(heading_deg) OVER w)')} AS dh FROM k3 {W})"""
#: Tracks with their quality.
TRK = KIN + """,
agg AS (SELECT track_id, min(class_name) AS class_name, count(*) AS n_points, min(frame_id) AS start_frame, max(frame_id) AS end_frame,
  min(timestamp_s) AS start_s, max(timestamp_s) AS end_s, avg(speed_kmh) AS m, max(speed_kmh) AS mx, count(*) FILTER (speed_kmh < 3.0) AS slow,
  greatest(max(accel), 0.0) AS acc, least(min(accel), 0.0) AS dec, coalesce(sum(step), 0.0) AS dist, avg(abs(jerk)) AS jk FROM kin GROUP BY track_id),
pen AS (SELECT *, n_points >= 10 AS ok, end_s - start_s AS duration_s,
  greatest(0, greatest(1, end_frame - start_frame + 1) - n_points) / CAST(greatest(1, end_frame - start_frame + 1) AS DOUBLE) AS miss FROM agg),
trk AS (SELECT track_id, class_name, n_points, start_frame, end_frame, start_s, end_s, duration_s,
  CASE WHEN ok THEN miss ELSE 0.0 END AS missing_ratio, CASE WHEN ok THEN m ELSE 0.0 END AS mean_kmh, CASE WHEN ok THEN mx ELSE 0.0 END AS max_kmh,
  CASE WHEN ok THEN slow * (duration_s / n_points) ELSE 0.0 END AS dwell_s, CASE WHEN ok THEN dist ELSE 0.0 END AS distance_m,
  CASE WHEN ok THEN acc ELSE 0.0 END AS max_accel, CASE WHEN ok THEN dec ELSE 0.0 END AS max_decel,
  CASE WHEN ok THEN greatest(0.0, least(1.0, 1.0 - (miss * 0.4 + CASE WHEN mx > 200 THEN 0.3 ELSE 0.0 END + CASE WHEN jk > 30 THEN 0.2 ELSE 0.0 END
    + CASE WHEN n_points < 15 THEN 0.1 ELSE 0.0 END))) ELSE 0.2 END AS quality_score FROM pen),
mid AS (SELECT track_id, x, y FROM kin WHERE k - 1 = n // 2)"""


def angle(a: str, b: str) -> str:
    d = f"(abs({a} - {b}) % 360.0)"
    return f"(CASE WHEN {d} > 180.0 THEN 360.0 - {d} ELSE {d} END)"


#: Pairs within 25 units of one frame.
EDG = KIN + f""",
e0 AS (SELECT a.frame_id, a.timestamp_s, a.track_id AS track_a, b.track_id AS track_b, a.class_name AS class_a, b.class_name AS class_b,
  b.x - a.x AS dx, b.y - a.y AS dy, b.vx - a.vx AS dvx, b.vy - a.vy AS dvy, (a.x + b.x) / 2.0 AS mid_x, (a.y + b.y) / 2.0 AS mid_y,
  {angle('a.heading_deg', 'b.heading_deg')} AS heading_diff_deg
  FROM kin a JOIN kin b ON a.frame_id = b.frame_id AND a.track_id < b.track_id WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 25.0),
edg AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance_m, sqrt(dvx * dvx + dvy * dvy) AS relative_speed_mps,
  CASE WHEN sqrt(dx * dx + dy * dy) > 1e-4 THEN -(dx * dvx + dy * dvy) / sqrt(dx * dx + dy * dy) ELSE 0.0 END AS closing_speed_mps FROM e0)"""
#: Conflicts among them.
CON = EDG + """,
q0 AS (SELECT *, dvx * dvx + dvy * dvy AS qa, 2.0 * (dx * dvx + dy * dvy) AS qb, dx * dx + dy * dy - 9.0 AS qc FROM edg),
c1 AS (SELECT *, qb * qb - 4.0 * qa * qc AS disc, sqrt(greatest(qb * qb - 4.0 * qa * qc, 0.0)) AS root, CASE WHEN qa < 1e-6 THEN 1.0 ELSE 2.0 * qa END AS base FROM q0),
c2 AS (SELECT *, CASE WHEN qc <= 0 THEN 0.0 WHEN qa < 1e-6 OR qb >= 0 OR disc < 0 THEN NULL
    WHEN (-qb - root) / base BETWEEN 0 AND 10 THEN (-qb - root) / base WHEN (-qb + root) / base BETWEEN 0 AND 10 THEN (-qb + root) / base END AS ttc_s,
  CASE WHEN closing_speed_mps <= 0 THEN 0.0 ELSE closing_speed_mps * closing_speed_mps / (2.0 * greatest(0.1, distance_m - 2.0)) END AS drac_mps2 FROM c1),
con AS (SELECT *, CASE WHEN 'PEDESTRIAN' IN (class_a, class_b) THEN 'PEDESTRIAN_VEHICLE' WHEN 'MOTORCYCLE' IN (class_a, class_b) THEN 'MOTORCYCLE_VEHICLE'
    WHEN heading_diff_deg < 35 THEN 'REAR_END' WHEN heading_diff_deg < 85 THEN 'MERGING' WHEN heading_diff_deg < 145 THEN 'CROSSING' ELSE 'HEAD_ON' END AS conflict_type,
  CASE WHEN coalesce(ttc_s <= 1.5, false) OR drac_mps2 >= 4.0 THEN 'CRITICAL' WHEN coalesce(ttc_s <= 2.0, false) OR drac_mps2 >= 3.25 THEN 'HIGH'
    WHEN coalesce(ttc_s <= 2.5, false) OR drac_mps2 >= 2.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM c2 WHERE coalesce(ttc_s <= 2.5, false) OR drac_mps2 >= 2.5 OR (distance_m < 3.5 AND relative_speed_mps > 2.0))"""
#: Zones and the zones of each track's ends.
ZON = TRK + """,
ends AS (SELECT track_id, first(x ORDER BY frame_id) AS x0, first(y ORDER BY frame_id) AS y0, last(x ORDER BY frame_id) AS x1, last(y ORDER BY frame_id) AS y1 FROM pts GROUP BY track_id),
lim AS (SELECT least(min(x0), min(x1)) AS lx, greatest(max(x0), max(x1)) AS hx, least(min(y0), min(y1)) AS ly, greatest(max(y0), max(y1)) AS hy FROM ends),
mar AS (SELECT *, (hx - lx) * 0.15 AS dx, (hy - ly) * 0.15 AS dy FROM lim),
zones AS (SELECT 1 AS ord, 'West_Approach' AS name, lx - 5 AS xmin, lx + dx AS xmax, ly AS ymin, hy AS ymax FROM mar
  UNION ALL SELECT 2, 'East_Approach', hx - dx, hx + 5, ly, hy FROM mar UNION ALL SELECT 3, 'North_Approach', lx, hx, hy - dy, hy + 5 FROM mar
  UNION ALL SELECT 4, 'South_Approach', lx, hx, ly - 5, ly + dy FROM mar),
ee AS (SELECT track_id, (SELECT max_by(name, ord) FROM zones z WHERE e.x0 > xmin AND e.x0 < xmax AND e.y0 > ymin AND e.y0 < ymax) AS origin_zone,
  (SELECT max_by(name, ord) FROM zones z WHERE e.x1 > xmin AND e.x1 < xmax AND e.y1 > ymin AND e.y1 < ymax) AS destination_zone FROM ends e),
mv0 AS (SELECT track_id, max(n) AS n, coalesce(sum(dh), 0.0) AS turn,
  max(CASE WHEN k = 1 THEN x END) AS xa, max(CASE WHEN k = 1 THEN y END) AS ya, max(CASE WHEN k = least(6, n) THEN x END) AS xb, max(CASE WHEN k = least(6, n) THEN y END) AS yb,
  max(CASE WHEN k = greatest(1, n - 5) THEN x END) AS xc, max(CASE WHEN k = greatest(1, n - 5) THEN y END) AS yc, max(CASE WHEN k = n THEN x END) AS xd, max(CASE WHEN k = n THEN y END) AS yd
  FROM kin GROUP BY track_id),
mv1 AS (SELECT m.*, t.mean_kmh, t.distance_m, """ + wrap("(degrees(atan2(yd - yc, xd - xc)) - degrees(atan2(yb - ya, xb - xa)))") + """ AS net, CASE WHEN n > 2 THEN turn ELSE 0.0 END AS tot FROM mv0 m JOIN trk t USING (track_id)),
mov AS (SELECT track_id, CASE WHEN n < 3 THEN 'UNKNOWN' WHEN mean_kmh < 3 AND distance_m < 5 THEN 'STOPPED' WHEN abs(net) > 140 OR abs(tot) > 150 THEN 'U_TURN'
  WHEN net > 35 OR tot > 45 THEN 'LEFT_TURN' WHEN net < -35 OR tot < -45 THEN 'RIGHT_TURN' ELSE 'STRAIGHT' END AS movement_type FROM mv1)"""


def bins(size: float) -> str:
    """Bins of the tracks' span."""
    return f""",
span AS (SELECT min(start_s) AS t0, max(end_s) AS t1 FROM trk),
bin AS (SELECT i AS bin, t0 + i * {size} AS w0, t0 + (i + 1) * {size} AS w1, t0 FROM span, LATERAL (SELECT unnest(range(CAST(ceil((t1 - t0) / {size}) AS BIGINT))) AS i))"""


_HITS = """SELECT b.bin, count(t.track_id) AS c FROM bin b LEFT JOIN trk t ON NOT (t.end_s < b.w0 OR t.start_s > b.w1) GROUP BY b.bin"""
#: Events of all six rules.
EVT = TRK + f""",
run0 AS (SELECT *, accel <= -4.5 AS hard, lead(timestamp_s) OVER w AS nt, lead(frame_id) OVER w AS nf FROM kin {W}),
run1 AS (SELECT *, sum(CASE WHEN hard AND NOT coalesce(lag(hard) OVER w, false) THEN 1 ELSE 0 END) OVER w AS run FROM (SELECT * FROM run0) {W}),
run1s AS (SELECT *, sum(CASE WHEN hard AND NOT coalesce(ph, false) THEN 1 ELSE 0 END) OVER w AS run FROM (SELECT *, lag(hard) OVER w AS ph FROM run0 {W}) {W}),
run2 AS (SELECT track_id, run, count(*) AS n, min(accel) AS measure, min(class_name) AS class_name, first(timestamp_s ORDER BY frame_id) AS start_s, first(frame_id ORDER BY frame_id) AS start_frame,
  first(x ORDER BY frame_id) AS x, first(y ORDER BY frame_id) AS y, first(speed_kmh ORDER BY frame_id) AS speed_kmh, last(nt ORDER BY frame_id) AS end_s, last(nf ORDER BY frame_id) AS end_frame
  FROM run1s WHERE hard GROUP BY track_id, run),
braking AS (SELECT 'SUDDEN_BRAKING' AS event_type, track_id, CAST(NULL AS BIGINT) AS other_id, class_name, start_s, end_s, start_frame, end_frame,
  CASE WHEN measure < -7 THEN 'CRITICAL' WHEN measure < -5.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(0.92 AS DOUBLE) AS confidence, x, y, measure, speed_kmh FROM run2 WHERE n >= 2 AND end_s IS NOT NULL),
acceleration AS (SELECT 'SUDDEN_ACCELERATION' AS event_type, track_id, CAST(NULL AS BIGINT) AS other_id, class_name, timestamp_s AS start_s, timestamp_s + 0.5 AS end_s, frame_id AS start_frame, frame_id + 5 AS end_frame,
  CASE WHEN accel > 5.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(0.88 AS DOUBLE) AS confidence, x, y, accel AS measure, speed_kmh
  FROM kin WHERE accel >= 3.5 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame_id) = 1),
stopped AS (SELECT 'STOPPED_VEHICLE' AS event_type, track_id, CAST(NULL AS BIGINT) AS other_id, class_name, start_s, end_s, start_frame, end_frame,
  CASE WHEN dwell_s < 15 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CAST(0.95 AS DOUBLE) AS confidence, x, y, dwell_s AS measure, mean_kmh AS speed_kmh FROM trk JOIN mid USING (track_id) WHERE dwell_s >= 5),
mvg AS (SELECT k.track_id, k.heading_deg FROM kin k JOIN trk t USING (track_id) WHERE t.class_name <> 'PEDESTRIAN' AND t.mean_kmh > 10),
mean_h AS (SELECT track_id, avg(heading_deg) AS h FROM mvg GROUP BY track_id),
opp AS (SELECT m.track_id, m.h FROM mean_h m, mvg v GROUP BY ALL HAVING count(*) FILTER ({angle('m.h', 'v.heading_deg')} >= 120) > 0.4 * count(*)),
wrong_way AS (SELECT 'WRONG_WAY' AS event_type, track_id, CAST(NULL AS BIGINT) AS other_id, class_name, start_s, end_s, start_frame, end_frame, 'CRITICAL' AS severity, CAST(0.91 AS DOUBLE) AS confidence, x, y, h AS measure, mean_kmh AS speed_kmh
  FROM opp JOIN trk USING (track_id) JOIN mid USING (track_id)),
swerve AS (SELECT track_id, avg(speed_mps) AS ms, max(abs(omega)) AS wmax FROM kin GROUP BY track_id),
cut_in AS (SELECT 'CUT_IN' AS event_type, track_id, CAST(NULL AS BIGINT) AS other_id, class_name, timestamp_s AS start_s, timestamp_s + 1.0 AS end_s, frame_id AS start_frame, frame_id + 10 AS end_frame,
  CASE WHEN wmax > 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(0.86 AS DOUBLE) AS confidence, x, y, wmax AS measure, speed_kmh
  FROM kin JOIN swerve USING (track_id) WHERE wmax > 25 AND ms > 8 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY abs(omega) DESC, frame_id) = 1),
vru0 AS (SELECT p.track_id, v.track_id AS veh, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM trk p JOIN trk v ON p.class_name = 'PEDESTRIAN' AND v.class_name <> 'PEDESTRIAN' AND p.start_s <= v.end_s AND v.start_s <= p.end_s
  JOIN pts a ON a.track_id = p.track_id JOIN pts b ON b.track_id = v.track_id AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 GROUP BY ALL),
vru AS (SELECT 'PEDESTRIAN_VEHICLE_CONFLICT' AS event_type, track_id, veh AS other_id, class_name, start_s, end_s, start_frame, end_frame,
  CASE WHEN d < 2.5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CAST(0.94 AS DOUBLE) AS confidence, x, y, d AS measure, mean_kmh AS speed_kmh FROM vru0 JOIN trk USING (track_id) JOIN mid USING (track_id) WHERE d < 6)"""
EVT = EVT.replace("""run1 AS (SELECT *, sum(CASE WHEN hard AND NOT coalesce(lag(hard) OVER w, false) THEN 1 ELSE 0 END) OVER w AS run FROM (SELECT * FROM run0) """ + W + """),
""", "")
RULES = ("braking", "acceleration", "stopped", "wrong_way", "cut_in", "vru")
UNION = " UNION ALL ".join(f"SELECT * FROM {r}" for r in RULES)
DESTINATIONS = ("West_Approach", "East_Approach", "North_Approach", "South_Approach")
