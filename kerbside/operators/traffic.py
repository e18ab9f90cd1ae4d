"""Aggregates over tracks and points: speeds by class, congestion, flow, windows, quality, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.config import CLASSES
from kerbside.functions.safety import congestion_level, data_grade


def speed_by_class(kin: DataFrame, tracks: DataFrame) -> DataFrame:
    """Speeds of points and durations, distances and extremes of tracks by class, most tracks first."""
    of_points = kin.join(tracks.select("track_id", F.col("class_name").alias("_c")), "track_id").groupBy(F.col("_c").alias("class_name")).agg(
        F.avg("speed_kmh").alias("mean_speed_kmh"), F.percentile("speed_kmh", F.lit(0.5)).alias("median_speed_kmh"),
        F.percentile("speed_kmh", F.lit(0.85)).alias("p85_speed_kmh"), F.max("speed_kmh").alias("max_speed_kmh"),
    )
    of_tracks = tracks.groupBy("class_name").agg(
        F.count("*").alias("count"), F.avg("duration_s").alias("mean_duration_s"), F.avg("distance_m").alias("mean_distance_m"),
        F.max("max_accel").alias("max_accel_mps2"), F.min("max_decel").alias("max_decel_mps2"),
    )
    return of_tracks.join(of_points, "class_name", "left").orderBy(F.desc("count"), "class_name")


def congestion(kin: DataFrame) -> DataFrame:
    """One row: mean, median, spread and 85 % point of all speeds, with the level of the mean. Nulls for no points."""
    return kin.agg(
        F.avg("speed_kmh").alias("mean_kmh"), F.percentile("speed_kmh", F.lit(0.5)).alias("median_kmh"), F.stddev_pop("speed_kmh").alias("std_kmh"),
        F.percentile("speed_kmh", F.lit(0.85)).alias("p85_kmh"), F.countDistinct("track_id").alias("total_vehicles"),
    ).withColumn("level", F.when(F.col("mean_kmh").isNull(), "FREE_FLOW").otherwise(congestion_level(F.col("mean_kmh"))))


def bins(tracks: DataFrame, size: float) -> DataFrame:
    """(bin, w0, w1): windows of ``size`` from the first start on; as many as cover the span, none if it has no length."""
    span = tracks.agg(F.min("start_s").alias("t0"), F.max("end_s").alias("t1"))
    n = F.ceil((F.col("t1") - F.col("t0")) / size).cast("bigint")
    return span.where("t0 is not null").where(n > 0).select("t0", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("bin")).select(
        "bin", (F.col("t0") + F.col("bin") * size).alias("w0"), (F.col("t0") + (F.col("bin") + 1) * size).alias("w1")
    )


def in_bins(tracks: DataFrame, size: float) -> DataFrame:
    """Tracks repeated for each bin they touch, closed at both ends.

    Each track names the bins it may touch, so that the join is on the bin's number;
    the exact test on the bin's bounds follows.
    """
    start = tracks.agg(F.min("start_s").alias("_t0"))
    low = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("start_s") - F.col("_t0")) / size).cast("bigint") - 1)
    high = F.floor((F.col("end_s") - F.col("_t0")) / size).cast("bigint") + 1
    # one row holds the common start
    named = tracks.crossJoin(F.broadcast(start)).withColumn("bin", F.explode(F.sequence(low, high))).drop("_t0")
    return named.join(bins(tracks, size), "bin").where("not (end_s < w0 or start_s > w1)")


def flow(tracks: DataFrame, size: float = 60.0, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Tracks, hourly rate and tracks of each class by bin; empty bins are there with zeros."""
    counted = in_bins(tracks, size).groupBy("bin").agg(
        F.count("*").alias("vehicle_count"), *[F.count_if(F.col("class_name") == c).alias(c) for c in classes]
    )
    out = bins(tracks, size).join(counted, "bin", "left").fillna(0, ["vehicle_count", *classes])
    return out.select("bin", F.col("w0").alias("bin_start_s"), F.col("w1").alias("bin_end_s"), "vehicle_count", (F.col("vehicle_count") * (3600.0 / size)).alias("flow_rate_veh_hr"), *classes)


def _bin_of(time: Column, t0: Column, size: float) -> Column:
    return F.floor((time - t0) / size).cast("bigint")


def windows(tracks: DataFrame, kin: DataFrame, conflicts: DataFrame, events: DataFrame, size: float = 60.0) -> DataFrame:
    """By window: tracks that touch it, mean speed of its points, conflicts and events that begin in it (half open)."""
    t0 = tracks.agg(F.min("start_s").alias("_t0"))

    def binned(df: DataFrame, time: str) -> DataFrame:
        return df.crossJoin(F.broadcast(t0)).withColumn("bin", _bin_of(F.col(time), F.col("_t0"), size))

    active = in_bins(tracks, size).groupBy("bin").agg(F.count("*").alias("active_vehicle_count"))
    speeds = binned(kin.select("timestamp_s", "speed_kmh"), "timestamp_s").groupBy("bin").agg(F.avg("speed_kmh").alias("mean_speed_kmh"))
    hits = binned(conflicts.select("timestamp_s"), "timestamp_s").groupBy("bin").agg(F.count("*").alias("conflict_count"))
    happened = binned(events.select("start_s"), "start_s").groupBy("bin").agg(F.count("*").alias("event_count"))
    out = bins(tracks, size)
    for part in (active, speeds, hits, happened):
        out = out.join(part, "bin", "left")
    out = out.fillna(0, ["active_vehicle_count", "conflict_count", "event_count"]).fillna(0.0, ["mean_speed_kmh"])
    return out.select("bin", F.col("w0").alias("window_start_s"), F.col("w1").alias("window_end_s"), "active_vehicle_count", "mean_speed_kmh", "conflict_count", "event_count")


def consistency(kin: DataFrame, tracks: DataFrame, residuals: DataFrame | None = None) -> DataFrame:
    """One row of self-consistency measures of all tracks, with an overall score and its grade."""
    plausible = (F.col("max_kmh") <= 180) & (F.col("max_accel") <= 12) & (F.col("max_decel") >= -15)
    t = tracks.agg(
        F.count("*").alias("total_reconstructed_trajectories"), F.avg(F.col("is_valid").cast("double")).alias("valid_trajectory_ratio"),
        F.avg("duration_s").alias("mean_track_duration_s"), F.avg("missing_ratio").alias("mean_missing_ratio"),
        F.avg("quality_score").alias("_q"), F.avg(plausible.cast("double")).alias("physical_plausibility_rate"),
    )
    j = kin.agg(F.coalesce(F.avg(F.abs("jerk")), F.lit(0.0)).alias("mean_jerk_energy"))
    e = residuals.agg(F.avg("residual_px").alias("e")) if residuals is not None else kin.sparkSession.range(1).select(F.lit(0.0).alias("e"))
    one = t.crossJoin(j).crossJoin(e)  # one row each
    score = 0.35 * F.col("_q") + 0.35 * F.col("physical_plausibility_rate") + 0.20 * F.col("valid_trajectory_ratio") + 0.10 * F.greatest(F.lit(0.0), 1.0 - F.col("mean_jerk_energy") / 50.0)
    return one.select(
        F.round(score, 4).alias("overall_quality_score"), F.round("valid_trajectory_ratio", 4).alias("valid_trajectory_ratio"),
        "total_reconstructed_trajectories", F.round("mean_track_duration_s", 2).alias("mean_track_duration_s"), F.round("mean_missing_ratio", 4).alias("mean_missing_ratio"),
        F.round("physical_plausibility_rate", 4).alias("physical_plausibility_rate"), F.round("mean_jerk_energy", 3).alias("mean_jerk_energy"),
        F.round(F.coalesce("e", F.lit(0.0)), 3).alias("camera_stabilization_residual_px"), data_grade(score).alias("data_confidence_grade"),
    )


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"))


def _as_map(df: DataFrame, name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("name", "n")))
    return df.agg(F.map_from_entries(pairs).alias(name))


def summary(tracks: DataFrame, conflicts: DataFrame, events: DataFrame, congestion_row: DataFrame, quality_row: DataFrame) -> DataFrame:
    """One row of nested structs with the figures of a whole run; keys are bounded by the classes, types and severities."""
    span = tracks.agg(F.count("*").alias("n"), F.coalesce(F.max("end_s") - F.min("start_s"), F.lit(0.0)).alias("d"))
    parts = span.crossJoin(_as_map(counts(tracks, "class_name"), "classes")).crossJoin(_as_map(counts(conflicts, "conflict_type"), "types"))
    parts = parts.crossJoin(_as_map(counts(conflicts, "severity"), "levels")).crossJoin(_as_map(counts(events, "event_type"), "kinds"))
    parts = parts.crossJoin(congestion_row).crossJoin(quality_row.select(F.struct("*").alias("quality")))
    hour = 3600.0 / F.greatest(F.lit(1.0), F.col("d"))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return parts.select(
        F.struct(F.col("n").alias("total_vehicles_observed"), F.round("d", 2).alias("total_video_duration_s"), F.col("classes").alias("class_breakdown")).alias("metadata"),
        F.struct(
            F.round(F.coalesce("mean_kmh", F.lit(0.0)), 2).alias("overall_mean_speed_kmh"), F.round(F.coalesce("p85_kmh", F.lit(0.0)), 2).alias("p85_speed_kmh"),
            F.col("level").alias("congestion_level"), F.round(F.col("n") * hour, 1).alias("estimated_hourly_volume"),
        ).alias("flow_and_congestion"),
        F.struct(
            total("types").alias("total_conflicts"), F.col("types").alias("conflicts_by_type"), F.col("levels").alias("conflicts_by_severity"),
            F.round(F.coalesce(F.try_element_at("levels", F.lit("CRITICAL")), F.lit(0)) * hour, 2).alias("critical_conflict_rate_per_hour"),
        ).alias("surrogate_safety"),
        F.struct(total("kinds").alias("total_events_detected"), F.col("kinds").alias("events_by_type")).alias("behavioral_events"),
        F.col("quality").alias("data_quality_and_integrity"),
    )
