"""The points table, and a view of it over the generic ``events`` table.

A point is one position of one road user: track_id, frame_id, timestamp_s,
class_name, x, y.  ``events`` rows become points with hours in the place of seconds:
the user is the track, the value and the number in ``props`` are the position, and of
the events within an hour the first counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Class of a track by its number modulo 7.
CLASS_BY_RESIDUE = ("CAR", "LGV", "HGV", "BUS", "TRUCK", "MOTORCYCLE", "PEDESTRIAN")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """Points of an events table, one for each track and frame."""
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("double") / 1e6 / 3600.0
    classes = F.array(*[F.lit(c) for c in CLASS_BY_RESIDUE])
    rows = events.select(
        F.col("user_id").alias("track_id"), F.floor(hours).cast("bigint").alias("frame_id"), hours.alias("timestamp_s"),
        F.get(classes, F.pmod(F.col("user_id"), F.lit(7)).cast("int")).alias("class_name"), "event_type",
        F.col("value").cast("double").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "ts", "event_id",
    )
    first = Window.partitionBy("track_id", "frame_id").orderBy("ts", "event_id")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "ts", "event_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))
