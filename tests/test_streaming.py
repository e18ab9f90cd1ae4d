"""Streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from kerbside.plans import catalogue
from kerbside.streaming import trajectory as T


def test_tracker_matches_batch(spark, sf):
    key = lambda rows: sorted((r.source_id, r.track_id, r.frame_id, round(r.x1, 6), r.state) for r in rows)
    assert key(catalogue.QUERIES["stream_tracker"](spark, sf).collect()) == key(catalogue.QUERIES["track_bytetrack"](spark, sf).collect())


def test_deduplication(spark, sf):
    e = catalogue._stream(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.hour("ts").alias("frame_id"), "ts")
    out = T.drain(T.distinct_points(e, late="60 days"), "kerbside_distinct")
    assert out.count() == catalogue.table(spark, sf, "events").select("user_id", F.hour("ts")).distinct().count()


def test_a_state_that_was_stored_keeps_its_kinds():
    import pickle

    from kerbside.operators.tracking import State, advance

    one, two = State(), State()
    for frame in range(4):
        found = [{"x1": 90.0 * (k % 3) + frame, "y1": 5.0, "x2": 90.0 * (k % 3) + frame + 40, "y2": 30.0, "confidence": 0.9, "timestamp_s": frame / 10, "class_name": "CAR"} for k in range(60)]
        two = pickle.loads(pickle.dumps(two))
        row = lambda t: (t.id, t.state, *t.filter.mean)
        assert list(map(row, advance(one, frame, found))) == list(map(row, advance(two, frame, found)))
    assert len({id(t.filter) for t in pickle.loads(pickle.dumps(two)).tracks}) == 3
