"""Listings of media and images: files as rows, without their contents unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIDEO, IMAGE, TELEMETRY = ("mp4", "avi", "mov", "mkv"), ("jpg", "jpeg", "png", "bmp", "tif", "tiff"), ("csv", "json", "srt")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, folder, stem, suffix) of all files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(
        "path", "length", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix")
    )


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """Each video with the telemetry of the same stem: beside it first, then in its folder ``telemetry``; by suffix, then path."""
    files = listing(spark, path)
    video = files.where(F.col("suffix").isin(*VIDEO)).select("path", "folder", "stem")
    tele = files.where(F.col("suffix").isin(*TELEMETRY)).select(F.col("path").alias("telemetry"), F.col("folder").alias("tf"), "stem", F.col("suffix").alias("ts"))
    j = video.join(tele, (video.stem == tele.stem) & ((tele.tf == video.folder) | (tele.tf == F.concat(video.folder, F.lit("/telemetry")))), "left").drop(tele.stem)
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.when(F.col("tf") == F.col("folder"), 0).otherwise(1), "ts", "telemetry"))
    return j.withColumn("_r", rank).where("_r = 1").select("path", "stem", "telemetry")


def image_frames(spark: SparkSession, path: str, fps: float = 30.0, stride: int = 1, start: int = 0, end: int | None = None, limit: int | None = None, content: bool = False) -> DataFrame:
    """Images of a folder as frames in order of their paths, every ``stride``-th from ``start`` to before ``end``."""
    f = spark.read.format("binaryFile").load(path)
    f = f.where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*IMAGE))
    order = f.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("frame_id"))  # a row for each file name
    kept = order.where((F.col("frame_id") >= start) & ((F.col("frame_id") - start) % stride == 0))
    kept = kept if end is None else kept.where(F.col("frame_id") < end)
    kept = kept.withColumn("timestamp_s", F.col("frame_id") / F.lit(float(fps if 0 < fps <= 240 else 30.0)))
    kept = kept if limit is None else kept.orderBy("frame_id").limit(limit)
    return kept.join(f.select("path", "content"), "path") if content else kept
