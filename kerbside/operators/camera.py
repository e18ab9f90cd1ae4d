"""Camera motion and lanes: cumulative homographies, compensation, centre lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import length, valid_homography

MATRIX = [f"m{i}" for i in range(9)]


def cumulative(motions: DataFrame) -> DataFrame:
    """(source_id, frame_id, m0 ... m8): from each frame to the first, from motions between neighbours.

    A motion that can't be inverted leaves the matrix as it is.  A source is one group,
    as each matrix needs the one before it.
    """

    def run(df):
        df = df.sort_values("frame_id")
        total, out = np.eye(3), []
        for row in df[MATRIX].to_numpy(float):
            h = row.reshape(3, 3)
            total = total @ np.linalg.inv(h) if valid_homography(h) else total
            out.append(total.ravel())
        df[MATRIX] = np.array(out).reshape(-1, 9)
        return df

    return motions.groupBy("source_id").applyInPandas(run, motions.schema)


def compensate(points: DataFrame, matrices: DataFrame) -> DataFrame:
    """Positions x, y of points (source_id, frame_id) in the coordinates of the first frame; without a matrix they stay."""
    j = points.join(matrices.select("source_id", "frame_id", *MATRIX), ["source_id", "frame_id"], "left")
    m = [F.coalesce(c, F.lit(float(k % 4 == 0))) for k, c in enumerate(MATRIX)]
    w = F.col("x") * m[6] + F.col("y") * m[7] + m[8]
    w = F.when(F.abs(w) > 1e-7, w).otherwise(1.0)
    return j.withColumns({"_x": (F.col("x") * m[0] + F.col("y") * m[1] + m[2]) / w, "_y": (F.col("x") * m[3] + F.col("y") * m[4] + m[5]) / w}).withColumns(
        {"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y", *MATRIX)


def lane_lines(kin: DataFrame, tracks: DataFrame, eps: float = 3.0, min_samples: int = 3, width_m: float = 3.5) -> DataFrame:
    """Centre lines: about ten positions of each moving track, clustered by distance, in order along each cluster's main axis."""
    from pyspark.sql.window import Window

    from kerbside.operators.clusters import dbscan
    from kerbside.operators.kinematics import track_window

    whole = Window.partitionBy("track_id")
    k = kin.select("track_id", "frame_id", "x", "y", (F.row_number().over(track_window()) - 1).alias("k"), F.count("*").over(whole).alias("n"))
    moving = tracks.where(F.col("mean_kmh") > 5).select("track_id")
    picked = k.where((F.col("n") > 5) & (F.col("k") % F.greatest(F.lit(1), F.floor(F.col("n") / 10)) == 0)).join(moving, "track_id")
    found = dbscan(picked.select(F.struct("track_id", "frame_id").alias("id"), "x", "y"), eps, min_samples).where("cluster is not null")
    g = found.groupBy("cluster").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy")
    ).where("n > 5")
    angle = 0.5 * F.atan2(2.0 * F.col("cxy"), F.col("vx") - F.col("vy"))
    axis = g.select("cluster", "n", "mx", "my", F.cos(angle).alias("ux"), F.sin(angle).alias("uy"))
    at = (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy")
    lines = found.join(axis, "cluster").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(at.alias("s"), "x", "y"))).alias("c"))
    return lines.select(
        F.concat(F.lit("Lane_"), F.col("cluster.track_id").cast("string"), F.lit("_"), F.col("cluster.frame_id").cast("string")).alias("lane_id"),
        F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("centerline"), F.lit(width_m).alias("width_m"),
    )


def lane_distance(points: DataFrame, lanes: DataFrame) -> DataFrame:
    """Distance of each point to the nearest vertex of each lane; infinite for a lane without any."""
    j = points.crossJoin(F.broadcast(lanes)) if lanes.count() <= 1000 else points.join(lanes)
    d = F.array_min(F.transform("centerline", lambda p: length(F.col("x") - p["x"], F.col("y") - p["y"])))
    return j.select("track_id", "frame_id", "lane_id", F.coalesce(d, F.lit(float("inf"))).alias("distance_m"))
