"""Exact values and invariants of the trajectory operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.config import Config, Tracker, from_dict, merge
from kerbside.functions import geometry as G
from kerbside.functions import safety as S
from kerbside.operators import camera, clusters, detection, events, features, interactions, kinematics, movement, smoothing, spatial, tracking, traffic
from kerbside.sources import scenario, telemetry

D = "double"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_geometry(spark):
    got = one(spark, G.heading_deg(*lit(1, 0)), G.heading_deg(*lit(0, 1)), G.heading_deg(*lit(-1, 0)), G.heading_deg(*lit(0, 0)), G.angle_between(*lit(10, 350)), G.angle_between(*lit(0, 180)), G.angle_between(*lit(90, 45)), G.wrap_deg(F.lit(-190.0)))
    assert list(got) == pytest.approx([0, 90, 180, 0, 20, 180, 45, 170])
    assert list(one(spark, *G.scale_to_world(*lit(110, 210), 0.1, (10, 10)))) == pytest.approx([10, 20])
    square = [(0, 0), (100, 0), (100, 100), (0, 100)]
    h = G.estimate_homography(square, [(2 * x + 5, 2 * y + 10) for x, y in square])
    assert list(one(spark, *G.project(*lit(50, 20), h))) == pytest.approx([105, 50], abs=1e-3)
    assert G.estimate_homography(square[:3], square[:3]) is None and not G.valid_homography(np.zeros((3, 3)))
    a = G.estimate_affine([(0, 0), (1, 0), (0, 1)], [(1, 1), (1, 3), (-1, 1)])
    assert a @ [1, 1, 1] == pytest.approx([-1, 3, 1])
    box = lambda *v: tuple(lit(*v))
    assert list(one(spark, G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)), G.iou(box(0, 0, 1, 1), box(5, 5, 6, 6)), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)))) == [1, 0, 0]


def test_safety(spark):
    assert one(spark, S.time_to_collision(*lit(100, 0, -20, 0), 2.0), S.time_to_collision(*lit(100, 0, 20, 0), 2.0))[0] == pytest.approx(4.9)
    assert one(spark, S.time_to_collision(*lit(100, 0, 20, 0), 2.0))[0] is None and one(spark, S.time_to_collision(*lit(1, 0, 0, 0)))[0] == 0
    assert list(one(spark, S.required_deceleration(*lit(22, 10)), S.required_deceleration(*lit(22, -1)))) == [2.5, 0]
    names = ["car", "Van", "lorry", " person", "bicycle", "other"]
    assert [one(spark, S.map_class(F.lit(n)))[0] for n in names] == ["CAR", "LGV", "HGV", "PEDESTRIAN", "MOTORCYCLE", "UNKNOWN"]
    none = F.lit(None).cast(D)
    assert [one(spark, S.severity(*x))[0] for x in ([none, none, none], [F.lit(1.2), none, none], [none, F.lit(1.4), none], [none, none, F.lit(2.6)])] == ["LOW", "CRITICAL", "HIGH", "MEDIUM"]


def points(spark, rows):
    return spark.createDataFrame(rows, "track_id bigint, frame_id bigint, timestamp_s double, class_name string, x double, y double")


def test_kinematics(spark):
    k = kinematics.kinematics(points(spark, [(1, f, f / 10, "CAR", 1.0 * f, 10.0) for f in range(10)] + [(2, 5, 0.5, "CAR", 3.0, 4.0)]))
    rows = {(r.track_id, r.frame_id): r for r in k.collect()}
    assert all(r.speed_kmh == pytest.approx(36) and r.accel == pytest.approx(0, abs=1e-9) for (t, _), r in rows.items() if t == 1)
    assert rows[2, 5].speed_mps == rows[2, 5].jerk == rows[2, 5].omega == 0
    t = {r.track_id: r for r in kinematics.tracks(k).collect()}
    assert t[1].is_valid and t[1].distance_m == pytest.approx(9) and t[1].quality_score == pytest.approx(0.9) and t[2].quality_score == 0.2 and not t[2].is_valid


@pytest.fixture(scope="module")
def scene(spark):
    from kerbside.storage import materialise

    k = materialise(kinematics.kinematics(scenario.points(spark, fps=10.0, duration_s=15.0)), "scene")
    return k, materialise(kinematics.tracks(k), "scene-tracks")


def test_scene(spark, scene):
    k, t = scene
    assert k.count() == 1183 and scenario.observations(spark).count() == 1670
    moves = {r.track_id: r.movement_type for r in movement.movement_types(k, t).collect()}
    assert moves[1] == "STRAIGHT" and moves[4] in ("LEFT_TURN", "RIGHT_TURN") and moves[7] == "STOPPED"
    e = from_dict({"brake_mps2": -3.0, "dwell_s": 1.0, "wrong_way_deg": 100.0}, Config().events)
    found = {r.event_type for r in events.detect_all(k, t, e).collect()}
    assert {"SUDDEN_BRAKING", "STOPPED_VEHICLE", "WRONG_WAY"} <= found
    assert interactions.conflicts(k).count() > 0
    assert traffic.flow(t, 1.0).count() > 0 and traffic.congestion(k).first().total_vehicles == 8
    assert traffic.consistency(k, t).first().data_confidence_grade in ("EXCELLENT", "GOOD", "FAIR")


def test_wrong_way_against_all_pairs(spark):
    r = np.random.default_rng(0)
    rows = []
    for t in range(12):
        a = np.radians(r.choice([0, 5, 120.3, 180, 300]) + r.normal(0, 8))
        rows += [(t, f, float(f), "CAR", float(6 * f * np.cos(a) + r.normal()), float(6 * f * np.sin(a) + r.normal())) for f in range(25)]
    k = kinematics.kinematics(points(spark, rows))
    t = kinematics.tracks(k)
    h = {}
    for x in k.collect():
        h.setdefault(x.track_id, []).append(x.heading_deg)
    everything = np.concatenate(list(h.values()))

    def far(m):
        d = np.abs(m - everything) % 360
        return np.where(d > 180, 360 - d, d)

    for limit in (60.0, 120.0):
        want = {i for i, v in h.items() if (far(np.mean(v)) >= limit).sum() > 0.4 * len(everything)}
        got = {x.track_id for x in events.wrong_way(k, t, from_dict({"wrong_way_deg": limit}, Config().events)).collect()}
        assert got == want


def test_smoothing(spark):
    r = np.random.default_rng(1)
    line = np.c_[2.0 * np.arange(20), 3.0 * np.arange(20)]
    noisy = line + r.normal(0, 0.5, line.shape)
    for f in (smoothing.smooth_kalman, smoothing.smooth_polynomial):
        out = f(noisy)
        assert out.shape == noisy.shape and np.abs(out - line).mean() < np.abs(noisy - line).mean() and np.array_equal(f(noisy[:2]), noisy[:2])
    assert smoothing.smooth_polynomial(line) == pytest.approx(line)
    with pytest.raises(ValueError):
        smoothing.smooth(points(spark, []), "gaussian")
    obs = spark.createDataFrame([(1, f, f / 10, "CAR", 100.0 + 5 * f, 100.0, 140.0 + 5 * f, 120.0) for f in range(10)], "track_id bigint, frame_id bigint, timestamp_s double, class_name string, x1 double, y1 double, x2 double, y2 double")
    p, t = smoothing.build_trajectories(obs)
    row = t.first()
    assert p.count() == 10 and row.class_name == "CAR" and row.is_valid


def dets(spark, rows):
    return spark.createDataFrame(rows, "source_id string, det_id bigint, frame_id bigint, timestamp_s double, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string")


def test_detection_and_tracking(spark):
    pair = dets(spark, [("a", 1, 0, 0.0, 0.0, 0.0, 10.0, 10.0, 0.9, "CAR"), ("a", 2, 0, 0.0, 1.0, 1.0, 10.0, 10.0, 0.8, "CAR")])
    assert [x.confidence for x in detection.suppress(pair).collect()] == [0.9]
    assert detection.merge(pair).first().x1 == pytest.approx(0.8 / 1.7)
    t = detection.tiles(spark.createDataFrame([(1000, 800)], "width int, height int"), 400, 0.2).collect()
    assert {(x.tx2 - x.tx1, x.ty2 - x.ty1) for x in t} == {(400, 400)} and max(x.tx2 for x in t) == 1000
    two = dets(spark, [
        ("a", 1, 0, 0.0, 100.0, 100.0, 140.0, 120.0, 0.95, "CAR"), ("a", 2, 0, 0.0, 200.0, 200.0, 215.0, 215.0, 0.85, "PEDESTRIAN"),
        ("a", 3, 1, 0.033, 102.0, 101.0, 142.0, 121.0, 0.94, "CAR"), ("a", 4, 1, 0.033, 201.0, 201.0, 216.0, 216.0, 0.88, "PEDESTRIAN"),
    ])
    for looks in (False, True):
        got = tracking.track(two, Tracker(), looks).collect()
        assert {(x.track_id, x.class_name, x.state) for x in got if x.frame_id == 1} == {(1, "CAR", "ACTIVE"), (2, "PEDESTRIAN", "ACTIVE")}


def test_assignment_against_all_orders():
    from itertools import permutations

    r = np.random.default_rng(2)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 3), (4, 4)] * 6:
        c = r.random((n, m))
        got = tracking.assign(c)
        small, big = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = min(sum(c[a, b] if n <= m else c[b, a] for a, b in zip(small, p)) for p in permutations(big, len(small)))
        assert len(got) == min(n, m) and sum(c[a, b] for a, b in got) == pytest.approx(best)
    assert tracking.assign(np.zeros((0, 3))) == []


def test_units_are_assigned_as_single_boxes_are():
    r = np.random.default_rng(3)
    for k in range(150):
        n, m = r.integers(0, 8, 2)
        gain = np.maximum(0, r.integers(-3, 6, (n, m)) / 6 if k % 2 else r.random((n, m)) - 0.3)
        supply, room = r.integers(1, 5, n), r.integers(1, 5, m)
        sent = tracking.ship(gain, supply, room)
        each = np.repeat(np.repeat(gain, supply, 0), room, 1)
        assert (sent >= 0).all() and (sent.sum(1) <= supply).all() and (sent.sum(0) <= room).all() and (gain[sent > 0] > 0).all()
        assert (sent * gain).sum() == pytest.approx(sum(each[a, b] for a, b in tracking.assign(1 - each)) if n and m else 0)


def test_equal_gains_are_shipped_together(monkeypatch):
    shapes, alone = [], tracking._ship
    monkeypatch.setattr(tracking, "_ship", lambda gain, *a: shapes.append(gain.shape) or alone(gain, *a))
    sent = tracking.ship(np.kron(np.eye(2), np.ones((30, 20))), np.full(60, 2), np.full(40, 4))
    assert set(shapes) == {(2, 2)} and sent.sum() == 120 and not sent[:30, 20:].any() and not sent[30:, :20].any()


@pytest.mark.parametrize("looks", [False, True])
def test_a_crowd_costs_by_its_kinds(monkeypatch, looks):
    moved, alone = [], tracking.BoxFilter.predict
    monkeypatch.setattr(tracking.BoxFilter, "predict", lambda self, motion=None: moved.append(1) or alone(self, motion))
    monkeypatch.setattr(tracking, "assign", lambda cost: pytest.fail("boxes are assigned one by one"))
    state, seen = tracking.State(), []
    for frame in range(4):
        found = [{"x1": 90.0 * (k % 3) + frame, "y1": 5.0, "x2": 90.0 * (k % 3) + frame + 40, "y2": 30.0, "confidence": 0.9, "timestamp_s": frame / 10, "class_name": "CAR", "look": np.eye(3)[k % 3]} for k in range(60)]
        seen = tracking.advance(state, frame, found, Tracker(), looks)
        assert [t.id for t in seen] == list(range(1, 61)) and all(t.frame == frame for t in seen)
    # each track stays with the boxes of its own kind, and a kind's filter moves once in a frame
    assert {(round(t.filter.box()[0] / 90), (t.id - 1) % 3) for t in seen} == {(k, k) for k in range(3)} and len(moved) == 6


def test_features_and_scores(spark, scene):
    k, t = scene
    f = features.track_features(k)
    assert f.count() == 8 and all(v is not None and np.isfinite(v) for r in f.collect() for v in r[1:])
    p = features.pca(f, 2)
    assert p.columns == ["track_id", "pca_1", "pca_2"] and p.count() == 8
    s = features.anomalies(features.isolation_scores(f), t).collect()
    assert len(s) == 8 and all(0 < r.score < 1 for r in s) and any(r.is_anomaly for r in s)


def test_blur_keeps_the_sum(spark):
    r = spark.createDataFrame([(0, 0, 1.0), (5, 9, 2.0)], "row int, col int, v double")
    assert spatial.blur(r, 10, 2.0).agg(F.sum("v")).first()[0] == pytest.approx(3.0)


def test_camera(spark):
    shift = np.array([[1, 0, 5], [0, 1, 0], [0, 0, 1.0]]).ravel().tolist()
    m = spark.createDataFrame([("a", f, *(shift if f else np.eye(3).ravel().tolist())) for f in range(3)], "source_id string, frame_id bigint, " + ", ".join(f"{c} double" for c in camera.MATRIX))
    c = camera.cumulative(m)
    p = spark.createDataFrame([("a", 2, 100.0, 1.0), ("b", 0, 1.0, 2.0)], "source_id string, frame_id bigint, x double, y double")
    assert {(r.source_id, r.x, r.y) for r in camera.compensate(p, c).collect()} == {("a", 90.0, 1.0), ("b", 1.0, 2.0)}


def test_telemetry(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Time, Lat ,LON,Altitude\n0,1,2,30\n1,1.5,2.5,31\n")
    (tmp_path / "t.json").write_text('{"telemetry": [{"timestamp": 0.5, "lat": 3.0, "yaw": 90}]}')
    (tmp_path / "t.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\n[latitude: 37.5] [longitude: -122.1] [rel_alt: 40.2]\n\n2\n00:00:02,000 --> 00:00:03,000\n[latitude: 37.6] [longitude: -122.2]\n")
    rows = {n: telemetry.read(spark, str(tmp_path / f"t.{n}")).collect() for n in ("csv", "json", "srt")}
    assert [(r.timestamp_s, r.latitude, r.altitude_m) for r in rows["csv"]] == [(0.0, 1.0, 30.0), (1.0, 1.5, 31.0)]
    assert rows["json"][0].heading_deg == 90 and rows["srt"][0].timestamp_s == 1.5 and rows["srt"][0].longitude == -122.1 and rows["srt"][1].altitude_m is None
    with pytest.raises(ValueError):
        telemetry.read(spark, "x.gpx")


def test_config():
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert from_dict({"queue": {"gap_m": 9.0}}).queue.gap_m == 9.0
    with pytest.raises(KeyError):
        from_dict({"queue": {"nope": 1}})


def test_queues_of_one(spark, scene):
    k, _ = scene
    q = clusters.queues(k, from_dict({"speed_kmh": 10.0, "gap_m": 20.0, "min_vehicles": 1}, Config().queue))
    assert q.count() > 0


def test_built_in_labels(spark):
    from kerbside.functions.safety import map_class

    want = {"Minivan": "LGV", "pickup": "LGV", " trailer": "HGV", "lorry": "HGV", "person": "PEDESTRIAN", "bicycle": "MOTORCYCLE", "motorbike": "MOTORCYCLE", "tram": "UNKNOWN"}
    got = spark.createDataFrame([(k,) for k in want], "label string").select("label", map_class(F.col("label")).alias("c")).collect()
    assert {r["label"]: r["c"] for r in got} == want


def test_csv_prefers_short_names(spark, tmp_path):
    (tmp_path / "t.csv").write_text("time,latitude,lat,gimbal_pitch,pitch\n0.5,1,2,-80,-70\n")
    row = telemetry.read(spark, str(tmp_path / "t.csv")).first()
    assert (row.latitude, row.gimbal_pitch_deg) == (2.0, -70.0)


def test_event_ids_count_within_their_type(spark):
    from kerbside.operators import events

    rows = [("CUT_IN", 7, 1, None, 9), ("CUT_IN", 3, 2, None, 9), ("CUT_IN", 3, 1, None, 9), ("PEDESTRIAN_VEHICLE_CONFLICT", 1, 5, 6, 2), ("OWN", 1, 1, None, 1)]
    df = spark.createDataFrame(rows, "event_type string, start_frame long, track_id long, other_id long, end_frame long")
    got = {(x.event_type, x.start_frame, x.track_id): x.event_id for x in events.with_ids(df.repartition(4)).collect()}
    assert got == {
        ("CUT_IN", 3, 1): "CUTIN_00001", ("CUT_IN", 3, 2): "CUTIN_00002", ("CUT_IN", 7, 1): "CUTIN_00003",
        ("PEDESTRIAN_VEHICLE_CONFLICT", 1, 5): "VRU_00001", ("OWN", 1, 1): "OWN_00001",
    }
    assert events.with_ids(df.limit(0)).columns == ["event_id", *df.columns] and events.with_ids(df.limit(0)).isEmpty()


def test_angles_follow_sql_to_the_last_bit(spark):
    import duckdb

    from kerbside.plans import sql

    below = [a - k * 2.0**-e for a in (0.0, 45.0, 90.0, 180.0, 270.0) for k in (-1, 0, 1, 2) for e in (44, 47, 50)]
    rows = [(a, d, x, y) for a, (d, x, y) in zip(below, [(180 - 2.0**-44, 1.0, 1.0 - 2.0**-52), (-180.0, 1.0 - 2.0**-52, 1.0), (180.0, -1.0, 2.0**-52), (179.99999999999994, 1.0, -(2.0**-50))] * 15)]
    got = spark.createDataFrame(rows, "a double, d double, x double, y double").select(G.wrap_deg(F.col("a")), G.wrap_deg(F.col("d")), G.heading_deg(F.col("x"), F.col("y"))).collect()
    con = duckdb.connect()
    con.execute("create table t (a double, d double, x double, y double)")
    con.executemany("insert into t values (?, ?, ?, ?)", rows)
    want = con.execute(f"select {sql.wrap('a')}, {sql.wrap('d')}, ((degrees(atan2(y, x)) + 360.0) % 360.0 + 360.0) % 360.0 from t").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_suppression_of_a_crowded_frame_holds_no_square_of_it(monkeypatch):
    largest = []
    plain = detection.overlaps
    monkeypatch.setattr(detection, "overlaps", lambda a, b: largest.append(len(a) * len(b)) or plain(a, b))
    rng = np.random.default_rng(3)
    boxes = np.round(rng.uniform(0, 60, (3000, 2)), 0)
    boxes = np.hstack([boxes, boxes + np.round(rng.uniform(0, 40, (3000, 2)), 0)])
    groups = dict(detection._groups(boxes, 0.5))
    assert max(largest) <= 3000
    o = plain(boxes, boxes) >= 0.5
    keep = np.ones(3000, bool)
    for k in range(3000):
        if keep[k]:
            keep[k + 1 :] &= ~o[k, k + 1 :]
    assert list(groups) == np.flatnonzero(keep).tolist()
    assert sorted(i for g in groups.values() for i in g.tolist()) == list(range(3000))


def test_first_conflicts_form_pairs_of_the_first_frames_only(spark, monkeypatch):
    rows = [(t, f, float(f), "CAR", 2.0 * t, 0.0, 1.0 if t else 0.0, 0.0, 0.0) for f in range(9) for t in range(3) if f > 1 or t == 0]
    kin = spark.createDataFrame(rows, "track_id long, frame_id long, timestamp_s double, class_name string, x double, y double, vx double, vy double, heading_deg double")
    plain, seen = interactions.conflicts, []
    whole = plain(kin).orderBy("frame_id", "track_a", "track_b")
    monkeypatch.setattr(interactions, "conflicts", lambda k, c: seen.append(k.agg(F.max("frame_id")).first()[0]) or plain(k, c))
    for n in (1, 4, 1000):
        assert interactions.first_conflicts(kin, n).collect() == whole.limit(n).collect() != []
    seen.clear()
    interactions.first_conflicts(kin, 1)
    assert seen == [0, 2]
    assert interactions.first_conflicts(kin.limit(0), 3).collect() == []


def test_copies_of_a_position_are_not_paired(spark, monkeypatch):
    seen, plain = [], clusters.near_pairs
    monkeypatch.setattr(clusters, "near_pairs", lambda a, b, *r: seen.append((a.count(), b.count())) or plain(a, b, *r))
    rows = [(k, 1, 0.0, 0.0) for k in range(40, 10, -1)] + [(5, 1, 4.0, 0.0), (3, 1, 50.0, 0.0), (99, 1, 8.0, 0.0), (98, 1, 8.0, 0.0), (50, 2, 0.0, 0.0), (1, 1, None, 0.0)]
    found = clusters.dbscan(spark.createDataFrame(rows, "id long, frame_id long, x double, y double"), 5.0, 3, ["frame_id"])
    got = {r.id: r.cluster for r in found.collect()}
    assert got == {k: 5 for k in (*range(11, 41), 5, 98, 99)} | {3: None, 50: None, 1: None}
    assert max(seen[0]) < 10


def test_pairs_within_sends_five_copies_and_meets_each_pair_once(spark):
    spots = [(k, k % 2, (k * 37 % 23) * 1.5 - 10, (k * 53 % 19) * 1.5 - 10) for k in range(60)]
    df = spark.createDataFrame(spots, "track_id long, frame_id long, x double, y double")
    found = interactions.pairs_within(df, 5.0, ["frame_id"], "track_id")
    want = sorted((p[0], q[0]) for p in spots for q in spots if p[0] < q[0] and p[1] == q[1] and ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5 <= 5.0)
    assert sorted((r.a.track_id, r.b.track_id) for r in found.collect()) == want and len(want) > 50


def test_pairs_of_boxes_come_of_their_places(spark, monkeypatch):
    monkeypatch.setattr(detection, "PIECE", 3)
    r, rows = np.random.default_rng(7), []
    for k in range(90):
        x, y, s = (float(v) for v in r.integers(0, 4, 3))
        rows.append(("a", k % 80, int(k % 3), 0.0, x, y, x + s, y + s, 0.9, "CAR"))
    rows.append(("a", 100, 7, 0.0, 1.0, 1.0, 2.0, 2.0, 0.9, "CAR"))
    found = detection.overlapping(dets(spark, rows))
    assert "box" not in found.columns
    box = lambda x: np.array([x[4:8]], float)
    want = sorted((a[1], b[1], round(float(detection.overlaps(box(a), box(b))[0, 0]), 9)) for a in rows for b in rows if a[2] == b[2] and a[1] < b[1])
    assert sorted((x.a, x.b, round(x.iou, 9)) for x in found.collect()) == want and len(want) > 1000
