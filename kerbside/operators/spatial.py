"""Rasters over the plane: density, mean speed and weighted conflicts, with gaussian blur."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(points: DataFrame) -> DataFrame:
    """One row (lx, hx, ly, hy); 0 to 100 where there are no points."""
    b = points.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    return b.select(*[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("lx", 0.0), ("hx", 100.0), ("ly", 0.0), ("hy", 100.0))])


def _cell(v: str, lo: str, hi: str, n: int) -> Column:
    """Cell of a value, 0 to n - 1; values beyond the ends count for the outer cells."""
    span = F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)).otherwise(1.0)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(v) - F.col(lo)) / span * n))).cast("int")


def cells(points: DataFrame, over: DataFrame, n: int) -> DataFrame:
    """``points`` with ``row`` and ``col`` of an n by n grid over the bounds."""
    b = bounds(over)
    return points.crossJoin(F.broadcast(b)).withColumns({"row": _cell("y", "ly", "hy", n), "col": _cell("x", "lx", "hx", n)}).drop("lx", "hx", "ly", "hy")


def kernel(sigma: float) -> list[float]:
    """Weights of offsets -r ... r of a gaussian cut at four deviations."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def blur(raster: DataFrame, n: int, sigma: float) -> DataFrame:
    """Gaussian blur of a sparse raster (row, col, v), reflected at the borders; rows first, then columns.

    A cell gives its share to each cell in reach, so only cells with a value are moved.
    """
    w = kernel(sigma)
    r = len(w) // 2
    spread = F.array(*[F.struct(F.lit(k - r).alias("d"), F.lit(x).alias("w")) for k, x in enumerate(w)])
    for axis in ("row", "col"):
        moved = raster.select("row", "col", "v", F.explode(spread).alias("s"))
        at = F.pmod(F.col(axis) + F.col("s.d"), F.lit(2 * n))
        folded = F.when(at < n, at).otherwise(2 * n - 1 - at)
        raster = moved.withColumn(axis, folded.cast("int")).groupBy("row", "col").agg(F.sum(F.col("v") * F.col("s.w")).alias("v"))
    return raster


def dense(raster: DataFrame, n: int) -> DataFrame:
    """All n by n cells, 0 where the sparse raster has none."""
    grid = raster.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    return grid.join(raster, ["row", "col"], "left").fillna(0.0, ["v"])


def _to_one(raster: DataFrame) -> DataFrame:
    top = raster.agg(F.max("v").alias("m"))
    return raster.crossJoin(F.broadcast(top)).select("row", "col", F.when(F.col("m") > 0, F.col("v") / F.col("m")).otherwise(F.col("v")).alias("v"))


def density(points: DataFrame, n: int = 100, sigma: float = 2.0) -> DataFrame:
    """Blurred counts of points, the largest being 1."""
    counted = cells(points, points, n).groupBy("row", "col").agg(F.count("*").cast("double").alias("v"))
    return dense(_to_one(blur(counted, n, sigma)), n)


def speed(kin: DataFrame, n: int = 100, sigma: float = 2.0) -> DataFrame:
    """Blurred mean speeds; empty cells count as 0."""
    mean = cells(kin, kin, n).groupBy("row", "col").agg(F.avg("speed_kmh").alias("v"))
    return dense(blur(mean, n, sigma), n)


def conflict_risk(conflicts: DataFrame, points: DataFrame, n: int = 100, sigma: float = 2.5) -> DataFrame:
    """Blurred weights of conflicts (critical 3, high 2, others 1) over the bounds of the points, the largest being 1."""
    weight = F.when(F.col("severity") == "CRITICAL", 3.0).when(F.col("severity") == "HIGH", 2.0).otherwise(1.0)
    at = conflicts.select(F.col("mid_x").alias("x"), F.col("mid_y").alias("y"), weight.alias("w"))
    return dense(_to_one(blur(cells(at, points, n).groupBy("row", "col").agg(F.sum("w").alias("v")), n, sigma)), n)


def histogram(df: DataFrame, column: str, n: int = 40) -> DataFrame:
    """(bin, lo, hi, n): equal bins over the range of a column, the last one closed."""
    b = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo is not null")
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    k = F.least(F.lit(n - 1), F.floor((F.col(column) - F.col("lo")) / span * n)).cast("int")
    counted = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(b)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    return b.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"), "lo", span.alias("span")).join(counted, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("span") / n).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("span") / n).alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def trails(points: DataFrame, n: int = 30) -> DataFrame:
    """The last n positions of each track up to each of its points."""
    from kerbside.operators.kinematics import track_window

    return points.withColumn("trail", F.collect_list(F.struct("x", "y")).over(track_window().rowsBetween(1 - n, 0)))
