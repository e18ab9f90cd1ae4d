"""Streaming forms: tumbling flow, deduplicated points, and a tracker that keeps its state between batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbside.config import Tracker
from kerbside.operators.tracking import OUT, State, advance, rows_of


def flow(points: DataFrame, time: str = "ts", size: str = "60 seconds", slide: str | None = None, late: str = "10 minutes", start: str | None = None) -> DataFrame:
    """Rows and distinct tracks (approximate) by window and class; windows close when the watermark passes them.

    Windows begin at the epoch (moved by ``start``), not at the first row, which a stream doesn't know beforehand.
    """
    timed = points.withColumn("_t", F.col(time).cast("timestamp"))
    w = F.window("_t", size, slide, start) if slide or start else F.window("_t", size)
    counted = timed.withWatermark("_t", late).groupBy(w.alias("w"), "class_name").agg(F.count("*").alias("n"), F.approx_count_distinct("track_id").alias("tracks"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "class_name", "n", "tracks")


def distinct_points(points: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One point of each track and frame among those that arrive within the watermark."""
    return points.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(["track_id", "frame_id"])


def dwell_sessions(points: DataFrame, gap: str = "30 seconds", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Spans in which a track keeps reporting, with gaps below ``gap``."""
    timed = points.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = timed.groupBy(F.session_window("_t", gap).alias("s"), "track_id").agg(F.count("*").alias("n"))
    return g.select("track_id", F.col("s.start").alias("from_ts"), F.col("s.end").alias("to_ts"), "n")


def track(detections: DataFrame, c: Tracker = Tracker(), appearance: bool = False, timeout_ms: int | None = None) -> DataFrame:
    """Tracks of a stream of detections, by source; with a timeout, a source that is silent for so long starts anew.

    Frames of a batch are taken in order; a frame older than the last one of its source is late and left out.
    """
    import pandas as pd

    names = [x.split()[0] for x in OUT.split(", ")]

    def run(key, batches: Iterator, held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        last, blob = held.get if held.exists else (-1, pickle.dumps(State()))
        state, out = pickle.loads(blob), []
        df = pd.concat(list(batches))
        for frame, own in df.sort_values(["frame_id", "det_id"]).groupby("frame_id", sort=True):
            if frame > last:
                out += rows_of(key[0], int(frame), advance(state, int(frame), own.to_dict("records"), c, appearance))
                last = int(frame)
        held.update((last, pickle.dumps(state)))
        if timeout_ms is not None:
            held.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=names)

    return detections.groupBy("source_id").applyInPandasWithState(run, OUT, "last bigint, state binary", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the rows it gave, through a table in memory (for queries and tests)."""
    from kerbside.storage import scratch

    spark = df.sparkSession
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
