import random

import numpy as np

from kerbside.config import Conflict
from kerbside.functions import safety as S
from kerbside.operators import clusters, interactions, nearby


def scene(spark, n=260):
    r = random.Random(3)
    label = ["CAR", "BUS", "PEDESTRIAN", "MOTORCYCLE"]
    rows = [(k % 3, float(k % 3), k // 3 + (k % 3), label[k % 4], r.choice([0.0, 100.0, 125.0, r.uniform(-120, 120)]), float(r.randint(0, 60)), r.uniform(-9, 9), None if k % 11 == 0 else r.uniform(-9, 9), r.uniform(0, 360)) for k in range(n)]
    rows += [(None, 0.0, 1, "CAR", 0.0, 0.0, 0.0, 0.0, 0.0), (0, 0.0, 9001, "CAR", None, 0.0, 0.0, 0.0, 0.0), (0, 0.0, 9002, "CAR", float("nan"), 0.0, 0.0, 0.0, 0.0), (0, 0.0, 9003, "CAR", 0.0, 0.0, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "frame_id long, timestamp_s double, track_id long, class_name string, x double, y double, vx double, vy double, heading_deg double")


def test_conflicts_are_those_of_the_measures_and_no_pair_is_joined(spark):
    kin, c = scene(spark), Conflict()
    e = interactions.edges(kin, c.radius_m)
    e = e.withColumns({"ttc_s": S.time_to_collision(e.dx, e.dy, e.dvx, e.dvy, c.collision_radius_m, c.horizon_s), "drac_mps2": S.required_deceleration(e.distance_m, e.closing_speed_mps)}).localCheckpoint()
    e = e.withColumns({"severity": S.severity(e.ttc_s, e.ttc_s * float("inf"), e.drac_mps2, c), "conflict_type": S.conflict_type(e.class_a, e.class_b, e.heading_diff_deg)})
    hit = e.where((e.ttc_s <= c.ttc_medium_s) | (e.drac_mps2 >= c.drac_medium) | ((e.distance_m < c.near_m) & (e.relative_speed_mps > c.near_speed_mps)))
    found = interactions.conflicts(kin, c)
    assert list(found.columns) == list(interactions.CONFLICT)
    text = lambda df: sorted(map(str, df.select(*found.columns).collect()))
    assert text(found) == text(hit) and len(text(found)) > 100
    counts = interactions.conflicts(kin, c, ["severity"])
    assert counts.columns == ["severity"] and counts.count() == found.count()
    assert "Join" not in found._jdf.queryExecution().toString()


def test_ranges_lose_no_pair():
    r = np.random.default_rng(1)
    for scale, n in ((1, 30), (20, 30), (0.05, 8)):
        a, b = ((np.repeat(np.arange(k), n), (r.exponential(50, k * n) * scale).round(2), r.integers(0, int(100 * scale) + 1, k * n).astype(float)) for k in (9, 40))
        d = np.sqrt((a[1][:, None] - b[1]) ** 2 + (a[2][:, None] - b[2]) ** 2)
        asked = r.random((9, 40)) < 0.9
        want = d.reshape(9, n, 40, n).min(axis=(1, 3))
        assert (np.sqrt(nearby.least(a, b, asked, 6.0)) == np.where(asked & (want <= 6), want, np.inf)).all()
        own = np.sqrt((a[1][:, None] - a[1]) ** 2 + (a[2][:, None] - a[2]) ** 2)
        got = sorted(tuple(sorted(p)) for i, j in nearby.within(a[1], a[2], 25.0) for p in zip(i.tolist(), j.tolist()))
        assert got == sorted(zip(*(v.tolist() for v in np.nonzero(np.triu(own <= 25, 1)))))


def test_paths_meet_by_blocks_and_no_pair_is_shuffled(spark, sf, monkeypatch):
    from kerbside.operators import events, kinematics
    from kerbside.sources.points import points

    kin = kinematics.kinematics(points(spark, sf)).localCheckpoint()
    tracks = kinematics.tracks(kin).localCheckpoint()
    row = lambda x: (x.track_id, x.other_id, round(x.measure, 9))
    one = sorted(map(row, events.vru(kin, tracks).collect()))
    monkeypatch.setattr(events, "PATHS", 2)
    monkeypatch.setattr(events, "AT_ONCE", 3)
    found = events.vru(kin, tracks)
    assert sorted(map(row, found.collect())) == one and len(one) > 5
    span = {t.track_id: t for t in tracks.collect()}
    spots = {}
    for p in kin.collect():
        spots.setdefault(p.track_id, []).append((p.x, p.y))
    want = []
    for a in span.values():
        for b in span.values():
            if a.class_name == "PEDESTRIAN" != b.class_name and a.start_s <= b.end_s and b.start_s <= a.end_s:
                d = min(((u[0] - v[0]) ** 2 + (u[1] - v[1]) ** 2) ** 0.5 for u in spots[a.track_id] for v in spots[b.track_id])
                want += [(a.track_id, b.track_id, round(d, 9))] if d < 6 else []
    assert one == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the join of what is known of a pedestrian stands below the unfolding of its pairs
    assert plan.index("Generate inline") < plan.index("Join")


def _by_hand(p, eps, least):
    """Smallest core id of each id's cluster, by all pairs."""
    near = {a[0]: [b[0] for b in p if a[1] == b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= eps] for a in p}
    core = {k for k, v in near.items() if len(v) >= least}
    label = {k: k for k in core}
    while any(label[k] > label[j] for k in core for j in near[k] if j in core):
        label = {k: min(label[j] for j in near[k] if j in core) for k in core}
    return {k: label[k] if k in core else min((label[j] for j in v if j in core), default=None) for k, v in near.items()}


def test_clusters_come_of_tiles_and_pairs_of_cores_are_not_formed(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TILE", 2)
    met, plain = [], clusters.near_pairs
    monkeypatch.setattr(clusters, "near_pairs", lambda a, b, *r: met.append(a.count()) or plain(a, b, *r))
    r = random.Random(5)
    for least, wide in ((3, 30), (5, 12)):
        rows = [(1000 - k, k % 2, round(r.uniform(-wide, wide), 1), float(r.randint(-wide, wide))) for k in range(240)]
        found = clusters.dbscan(spark.createDataFrame(rows, "id long, frame_id long, x double, y double"), 2.5, least, ["frame_id"])
        want = _by_hand(rows, 2.5, least)
        assert {x.id: x.cluster for x in found.collect()} == want and len(set(want.values())) > 3
        # only places that are no cores look for their neighbours one by one
        core = {a[0] for a in rows if sum(a[1] == b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 2.5 for b in rows) >= least}
        assert met.pop() <= len(rows) - len(core) < len(rows)


def test_full_cells_are_joined_as_by_all_pairs():
    r = np.random.default_rng(5)
    for trial in range(60):
        m, least, eps = int(r.integers(1, 120)), int(r.integers(1, 8)), float(r.choice([1.0, 2.5, 3.0]))
        scale = int(r.choice([3, 10, 25, 60]))
        x, y = r.integers(0, scale, (2, m)).astype(float) if trial % 2 else r.random((2, m)) * scale - 7
        n = r.integers(1, 3, m)
        near = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) <= eps
        core, group = nearby.dense(x, y, n, eps, least)
        assert (core == ((near * n).sum(1) >= least)).all() and (group[~core] == -1).all()
        label = np.arange(m)
        for _ in range(m):
            label = np.where(core, np.where(near & core & core[:, None], label, m).min(1, initial=m), label)
        assert ((label[core][:, None] == label[core]) == (group[core][:, None] == group[core])).all()


def test_clusters_without_keys_and_with_ids_of_two_parts_cross_tiles(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TILE", 2)
    r = random.Random(8)
    rows = [((10 - k % 9, k), 0, r.uniform(-20, 20), r.uniform(-20, 20)) for k in range(200)]
    df = spark.createDataFrame(rows, "id struct<track_id: long, frame_id: long>, z long, x double, y double").drop("z")
    found = clusters.dbscan(df, 2.5, 3)
    assert {tuple(x.id): x.cluster and tuple(x.cluster) for x in found.collect()} == _by_hand(rows, 2.5, 3)


def test_pairs_leave_a_slab_as_places_and_none_is_shuffled(spark, monkeypatch):
    kin = scene(spark).localCheckpoint()
    monkeypatch.setattr(nearby, "BLOCK", 64)
    e = interactions.edges(kin, 25.0)
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate inline") < plan.index("FlatMapGroupsInArrow")
    p = [x for x in kin.collect() if x.frame_id is not None and x.x is not None]
    want = sorted((a.frame_id, a.track_id, b.track_id) for a in p for b in p if a.frame_id == b.frame_id and a.track_id < b.track_id and ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5 <= 25.0)
    assert sorted((x.frame_id, x.track_a, x.track_b) for x in e.collect()) == want and len(want) > 1000


def test_opposing_headings_are_looked_up_and_no_cell_is_visited(spark):
    from dataclasses import replace

    from kerbside.config import Events
    from kerbside.operators import events

    r = random.Random(4)
    heads = [0.0, 359.95, 360.0, 90.0, 180.0, 270.0, 89.9, 12.34]
    rows = [(k % 40, k // 40, "PEDESTRIAN" if k % 40 == 7 else "CAR", 0.0, 0.0, None if k % 97 == 5 else r.choice(heads) if k % 3 else r.uniform(0, 360) * (k % 40) / 40) for k in range(800)]
    kin = spark.createDataFrame(rows, "track_id long, frame_id long, class_name string, x double, y double, heading_deg double")
    tracks = spark.createDataFrame([(k, "PEDESTRIAN" if k == 7 else "CAR", 50.0, 0.0, 1.0, 0, 1) for k in range(40)], "track_id long, class_name string, mean_kmh double, start_s double, end_s double, start_frame long, end_frame long")
    own = [x for x in rows if x[0] != 7]
    for limit, share in ((135.0, 0.2), (90.0, 0.45), (179.95, 0.0), (0.0, 0.9)):
        found = events.wrong_way(kin, tracks, replace(Events(), wrong_way_deg=limit, wrong_way_share=share))
        want = set()
        for k in {x[0] for x in own}:
            mine = [x[5] for x in own if x[0] == k and x[5] is not None]
            turn = [abs(sum(mine) / len(mine) - x[5]) % 360 for x in own if x[5] is not None]
            want |= {k} if sum(min(d, 360 - d) >= limit for d in turn) > share * len(own) else set()
        assert {x.track_id for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
