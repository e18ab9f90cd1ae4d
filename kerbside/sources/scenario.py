"""A scripted scene of eight road users, built from frame numbers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Number, class, box and start of each road user, in pixels.
AGENTS = [
    (1, "CAR", 40.0, 20.0, 100.0, 340.0), (2, "CAR", 40.0, 20.0, 40.0, 340.0), (3, "TRUCK", 70.0, 25.0, 620.0, 50.0), (4, "CAR", 40.0, 20.0, 1180.0, 380.0),
    (5, "PEDESTRIAN", 12.0, 12.0, 560.0, 460.0), (6, "MOTORCYCLE", 22.0, 12.0, 80.0, 300.0), (7, "LGV", 45.0, 22.0, 500.0, 340.0), (8, "CAR", 40.0, 20.0, 1100.0, 340.0),
]
#: Frames in which the fourth user drives straight: from 1180 down to 640 by 6 a frame.
STRAIGHT = 90


def observations(spark: SparkSession, width: int = 1280, height: int = 720, fps: float = 30.0, duration_s: float = 10.0) -> DataFrame:
    """Boxes of all users in every frame in which they are in sight.

    Steps of a frame are sums of constants by phases, so positions are running sums.
    """
    agents = spark.createDataFrame(AGENTS, "track_id bigint, class_name string, w double, h double, x0 double, y0 double")
    f, a = F.col("frame_id"), F.col("track_id")
    by = lambda values: F.coalesce(*[F.when(a == k, v) for k, v in values.items()], F.lit(0.0))
    slide = F.when(f < STRAIGHT, -6.0).when(f < STRAIGHT + 40, -0.5).otherwise(0.0)
    dx = by({1: F.lit(5.6), 2: F.when(f < 60, 10.0).when(f < 80, 1.0).otherwise(5.0), 4: slide, 6: F.lit(8.0), 8: F.lit(-8.0)})
    dy = by({1: 0.05 * F.sin(0.1 * f), 3: F.lit(3.0), 4: F.when(f < STRAIGHT, 0.0).otherwise(6.0), 5: F.lit(-1.5), 6: F.when(f.between(40, 100), 1.5).otherwise(0.0)})
    # eight users and as many frames as the scene has
    grid = spark.range(int(fps * duration_s)).withColumnRenamed("id", "frame_id").crossJoin(F.broadcast(agents))
    w = Window.partitionBy("track_id").orderBy("frame_id")
    moved = grid.withColumns({"px": F.col("x0") + F.sum(dx).over(w), "py": F.col("y0") + F.sum(dy).over(w)})
    seen = moved.where((F.col("px") >= 0) & (F.col("px") <= width) & (F.col("py") >= 0) & (F.col("py") <= height))
    still = a == 7
    x = F.when(still, F.col("px")).otherwise(F.col("px") + F.sin(0.2 * f))
    y = F.when(still, F.col("py")).otherwise(F.col("py") + F.cos(0.15 * f))
    return seen.select(
        "track_id", "class_name", "frame_id", (f / fps).alias("timestamp_s"), x.alias("pixel_x"), y.alias("pixel_y"),
        (x - F.col("w") / 2).alias("x1"), (y - F.col("h") / 2).alias("y1"), (x + F.col("w") / 2).alias("x2"), (y + F.col("h") / 2).alias("y2"), F.lit(0.95).alias("confidence"),
    )


def points(spark: SparkSession, metres_per_pixel: float = 0.05, **options) -> DataFrame:
    return observations(spark, **options).withColumns({"x": F.col("pixel_x") * metres_per_pixel, "y": F.col("pixel_y") * metres_per_pixel})
