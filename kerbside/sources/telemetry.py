"""Telemetry of an aerial camera: readers, the nearest record in time, and a synthetic flight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names under which files give each field, the first that is there counts.
ALIASES = {
    "timestamp_s": ["timestamp_s", "timestamp", "time", "t", "time_sec", "rel_time"],
    "latitude": ["latitude", "lat"], "longitude": ["longitude", "lon", "lng"], "altitude_m": ["altitude_m", "altitude", "alt", "height"],
    "heading_deg": ["heading_deg", "heading", "yaw"], "gimbal_pitch_deg": ["gimbal_pitch_deg", "gimbal_pitch", "pitch"],
    "gimbal_roll_deg": ["gimbal_roll_deg", "gimbal_roll", "roll"], "gimbal_yaw_deg": ["gimbal_yaw_deg", "gimbal_yaw"],
    "camera_fov_deg": ["camera_fov_deg", "fov"], "drone_speed_mps": ["drone_speed_mps", "drone_speed", "speed"],
}
#: Where files of comma-separated values prefer other names.
CSV_ALIASES = ALIASES | {
    "latitude": ["lat", "latitude"], "longitude": ["lon", "longitude", "lng"], "gimbal_pitch_deg": ["pitch", "gimbal_pitch", "gimbal_pitch_deg"],
    "gimbal_roll_deg": ["roll", "gimbal_roll", "gimbal_roll_deg"], "drone_speed_mps": ["speed", "drone_speed", "drone_speed_mps"],
}
#: Seconds between records of files without times.
STEP_S = 0.0333


def _resolve(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Columns by their aliases; a file without times gets them from its order (files are read as one partition each)."""
    names = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    pick = lambda field: [F.expr(f"try_cast(`{names[a]}` as double)") for a in aliases[field] if a in names]
    out = df.withColumn("_k", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_k")) - 1 if not pick("timestamp_s") else F.lit(0)
    fields = {f: (F.coalesce(*pick(f)) if pick(f) else F.lit(None).cast("double")) for f in ALIASES}
    if not pick("timestamp_s"):
        fields["timestamp_s"] = place * STEP_S
    return out.select(*[c.alias(f) for f, c in fields.items()])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _resolve(spark.read.csv(path, header=True), CSV_ALIASES)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, or an object with the list under ``telemetry``."""
    df = spark.read.json(path, multiLine=True)
    if "telemetry" in df.columns:
        df = df.select(F.explode("telemetry").alias("r")).select("r.*")
    return _resolve(df)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle blocks of a drone's video: start time, position and height; the camera looks straight down."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "\r", ""), "\n\\s*\n")).alias("b"))
    part = lambda k: F.expr(f"try_cast(regexp_extract(b, '(\\\\d+):(\\\\d+):(\\\\d+)[,.](\\\\d+)\\\\s*-->', {k}) as double)")
    number = lambda name: F.expr(f"try_cast(regexp_extract(b, '(?i){name}[^:=]*[:=]\\\\s*(-?[0-9.]+)', 1) as double)")
    t = part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000
    fields = {f: F.lit(None).cast("double") for f in ALIASES} | {
        "timestamp_s": t, "latitude": number("latitude"), "longitude": number("(?:longitude|longtitude)"), "altitude_m": number("(?:rel_alt|altitude)"), "gimbal_pitch_deg": F.lit(-90.0)
    }
    return blocks.select(*[c.alias(f) for f, c in fields.items()]).where("timestamp_s is not null")


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the file's suffix; one that isn't known raises."""
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "json": read_json, "srt": read_srt}
    if suffix not in readers:
        raise ValueError(f"telemetry of type .{suffix} is not supported")
    return readers[suffix](spark, path)


def nearest(left: DataFrame, right: DataFrame, time: str, keys: list[str], columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` nearest in time within ``keys``; among equals the earlier one.

    Both sides are laid on one time axis of each key; the last record before and the
    first after each row are found by windows, so no pair of rows is formed.
    """
    value = F.struct(F.col(time).alias("t"), *columns)
    tagged = left.select(*keys, F.col(time).alias("_t"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("r"), F.lit(1).alias("_o"))
    facts = right.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("v")).schema["v"].dataType).alias("l"), value.alias("r"), F.lit(0).alias("_o"))
    both = tagged.unionByName(facts)
    w = Window.partitionBy(*keys).orderBy("_t", "_o")
    before = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    j = both.select("l", "_t", before.alias("b"), after.alias("a")).where("l is not null")
    early = F.col("a").isNull() | (F.col("b").isNotNull() & ((F.col("_t") - F.col("b.t")) <= (F.col("a.t") - F.col("_t"))))
    got = F.when(early, F.col("b")).otherwise(F.col("a"))
    return j.withColumn("g", got).select("l.*", *[F.col(f"g.{c}").alias(c) for c in columns], F.col("g.t").alias("matched_time"))


def synthetic(spark: SparkSession, fps: float = 30.0, duration_s: float = 10.0) -> DataFrame:
    f = F.col("id").cast("double")
    return spark.range(int(fps * duration_s)).select(
        (f / fps).alias("timestamp_s"), (37.7749 + 1e-6 * f).alias("latitude"), (-122.4194 + 1e-6 * f).alias("longitude"), (60 + 0.5 * F.sin(0.05 * f)).alias("altitude_m"),
        (45 + 0.2 * F.cos(0.08 * f)).alias("heading_deg"), (-88.5 + 0.1 * F.sin(0.1 * f)).alias("gimbal_pitch_deg"), (0.1 * F.sin(0.04 * f)).alias("gimbal_roll_deg"), (0.3 + 0.05 * F.cos(0.02 * f)).alias("drone_speed_mps"),
    )
