"""Velocity, acceleration, jerk and turn rate of points, and quality of tracks.

All windows are of one track in frame order, so one exchange by track serves every
step, and the aggregation of tracks after it needs none of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.config import Motion, Quality
from kerbside.functions.geometry import heading_deg, length, wrap_deg



def track_window():
    """A track's rows in frame order; made on use, as it needs a session."""
    return Window.partitionBy("track_id").orderBy("frame_id")


def _slope(value: str, c: Motion) -> Column:
    """Central difference inside a track, one-sided at its ends, 0 for a single point."""
    after, before = (F.coalesce(f(value).over(track_window()), F.col(value)) for f in (F.lead, F.lag))
    t1, t0 = (F.coalesce(f("timestamp_s").over(track_window()), F.col("timestamp_s")) for f in (F.lead, F.lag))
    return (after - before) / F.greatest(F.lit(c.min_dt_s), t1 - t0)


def _inner(difference: Column, c: Motion) -> Column:
    """A difference over the two neighbours, 0 where one of them is missing."""
    dt = F.lead("timestamp_s").over(track_window()) - F.lag("timestamp_s").over(track_window())
    return F.coalesce(difference / F.greatest(F.lit(c.min_dt_s), dt), F.lit(0.0))


def kinematics(points: DataFrame, c: Motion = Motion()) -> DataFrame:
    """Adds velocity, clipped speed, acceleration, jerk, heading and turn rate to points (track_id, frame_id, timestamp_s, x, y)."""
    clip = lambda v: F.greatest(F.lit(-c.max_accel_mps2), F.least(F.lit(c.max_accel_mps2), v))
    moved = points.withColumns({"vx": _slope("x", c), "vy": _slope("y", c)})
    fast = moved.withColumns({"speed_mps": F.least(length(F.col("vx"), F.col("vy")), F.lit(c.max_speed_mps)), "heading_deg": heading_deg(F.col("vx"), F.col("vy"))})
    fast = fast.withColumn("speed_kmh", F.col("speed_mps") * 3.6)
    pushed = fast.withColumns({"accel": clip(_slope("speed_mps", c)), "ax": clip(_slope("vx", c)), "ay": clip(_slope("vy", c))})
    turn = wrap_deg(F.lead("heading_deg").over(track_window()) - F.lag("heading_deg").over(track_window()))
    jerk = F.lead("accel").over(track_window()) - F.lag("accel").over(track_window())
    return pushed.withColumns({"jerk": _inner(jerk, c), "omega": _inner(turn, c)})


def tracks(kin: DataFrame, q: Quality = Quality()) -> DataFrame:
    """A row for each track: span, speeds, distance, quality score and whether it is valid.

    A track below ``min_length`` points gets score 0.2 and no measures, as nothing is derived from it.
    """
    stepped = kin.withColumn("_step", length(F.col("x") - F.lag("x").over(track_window()), F.col("y") - F.lag("y").over(track_window())))
    a = stepped.groupBy("track_id").agg(
        F.min("class_name").alias("class_name"), F.count("*").alias("n_points"),
        F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"),
        F.min("timestamp_s").alias("start_s"), F.max("timestamp_s").alias("end_s"),
        F.avg("speed_kmh").alias("_mean"), F.max("speed_kmh").alias("_max"), F.count_if(F.col("speed_kmh") < q.dwell_speed_kmh).alias("_slow"),
        F.greatest(F.max("accel"), F.lit(0.0)).alias("_acc"), F.least(F.min("accel"), F.lit(0.0)).alias("_dec"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("_dist"), F.avg(F.abs("jerk")).alias("_jerk"),
    )
    long = F.col("n_points") >= q.min_length
    duration = F.col("end_s") - F.col("start_s")
    expected = F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame") + 1)
    missing = F.greatest(F.lit(0), expected - F.col("n_points")) / expected
    penalty = (
        missing * 0.4 + F.when(F.col("_max") > q.max_speed_kmh, 0.3).otherwise(0.0)
        + F.when(F.col("_jerk") > q.max_mean_jerk, 0.2).otherwise(0.0) + F.when(F.col("n_points") < q.short_length, 0.1).otherwise(0.0)
    )
    if_long = lambda x: F.when(long, x).otherwise(0.0)
    score = F.when(long, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty))).otherwise(0.2)
    return a.select(
        "track_id", "class_name", "n_points", "start_frame", "end_frame", "start_s", "end_s", duration.alias("duration_s"),
        if_long(missing).alias("missing_ratio"), if_long(F.col("_mean")).alias("mean_kmh"), if_long(F.col("_max")).alias("max_kmh"),
        if_long(F.col("_slow") * (duration / F.col("n_points"))).alias("dwell_s"), if_long(F.col("_dist")).alias("distance_m"),
        if_long(F.col("_acc")).alias("max_accel"), if_long(F.col("_dec")).alias("max_decel"),
        score.alias("quality_score"), (long & (score >= q.min_score)).alias("is_valid"),
    )


def majority_class(observations: DataFrame, label: str = "class_name") -> DataFrame:
    """The most frequent label of each track; among equals the one seen first."""
    counted = observations.groupBy("track_id", label).agg(F.count("*").alias("n"), F.min("frame_id").alias("_first"))
    best = F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col("_first"), F.col(label)))
    return counted.groupBy("track_id").agg(best.alias("b")).select("track_id", f"b.{label}", F.col("b.n").alias("n"))
