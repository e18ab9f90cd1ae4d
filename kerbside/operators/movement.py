"""Zones, entries and exits, turning movements and origin-destination tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import in_polygon, wrap_deg
from kerbside.operators.kinematics import track_window


def ends(points: DataFrame) -> DataFrame:
    """First and last position of each track."""
    at = F.struct("x", "y")
    e = points.groupBy("track_id").agg(F.min_by(at, "frame_id").alias("a"), F.max_by(at, "frame_id").alias("b"))
    return e.select("track_id", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


def auto_zones(points: DataFrame, margin: float = 0.15, overhang: float = 5.0) -> DataFrame:
    """Four approaches around the first and last positions of all tracks; later ones take precedence."""
    e = ends(points)
    both = e.select(F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("p.*")
    b = both.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy")).where("lx is not null")
    dx, dy = (F.col("hx") - F.col("lx")) * margin, (F.col("hy") - F.col("ly")) * margin
    zone = lambda k, name, *box: F.struct(F.lit(k).alias("ord"), F.lit(name).alias("name"), *[F.expr(v).alias(n) if isinstance(v, str) else v.alias(n) for n, v in zip(("xmin", "xmax", "ymin", "ymax"), box)])
    lx, hx, ly, hy = (F.col(c) for c in ("lx", "hx", "ly", "hy"))
    return b.select(F.explode(F.array(
        zone(1, "West_Approach", lx - overhang, lx + dx, ly, hy), zone(2, "East_Approach", hx - dx, hx + overhang, ly, hy),
        zone(3, "North_Approach", lx, hx, hy - dy, hy + overhang), zone(4, "South_Approach", lx, hx, ly - overhang, ly + dy),
    )).alias("z")).select("z.*")


def polygon_zones(spark, zones: list[tuple[str, list[tuple[float, float]]]]) -> DataFrame:
    """Zones that a user names by their corners, in order of precedence."""
    rows = [(k, name, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, (name, ring) in enumerate(zones, 1)]
    return spark.createDataFrame(rows, "ord int, name string, ring array<struct<x:double,y:double>>")


def _inside(zones: DataFrame, x: str, y: str):
    if "ring" in zones.columns:
        return in_polygon(F.col(x), F.col(y), F.col("ring"))
    return (F.col(x) > F.col("xmin")) & (F.col(x) < F.col("xmax")) & (F.col(y) > F.col("ymin")) & (F.col(y) < F.col("ymax"))


def entry_exit(points: DataFrame, zones: DataFrame) -> DataFrame:
    """The zones of the first and the last point of each track; of several the last in order.

    Zones are a user's list or the four automatic ones, so all of them fit one row of a broadcast.
    """
    listed = zones.agg(F.array_sort(F.collect_list(F.struct(*zones.columns))).alias("zs"))
    e = ends(points).crossJoin(F.broadcast(listed))

    def name(x: str, y: str):
        def test(z):
            if "ring" in zones.columns:
                return in_polygon(F.col(x), F.col(y), z["ring"])
            return (F.col(x) > z["xmin"]) & (F.col(x) < z["xmax"]) & (F.col(y) > z["ymin"]) & (F.col(y) < z["ymax"])

        return F.get(F.reverse(F.filter("zs", test)), F.lit(0))["name"]

    return e.select("track_id", name("x0", "y0").alias("origin_zone"), name("x1", "y1").alias("destination_zone"))


def in_zone(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Tracks with any point in a zone: (track_id, name)."""
    return points.join(F.broadcast(zones.hint("broadcast")), _inside(zones, "x", "y")).select("track_id", "name").distinct() if "ring" not in zones.columns else (
        points.crossJoin(F.broadcast(zones)).where(_inside(zones, "x", "y")).select("track_id", "name").distinct()
    )


def movement_types(kin: DataFrame, tracks: DataFrame) -> DataFrame:
    """How each track turns, from its first and last six points and its headings on the way."""
    from pyspark.sql.window import Window

    whole = Window.partitionBy("track_id")
    numbered = kin.select("track_id", "frame_id", "x", "y", F.row_number().over(track_window()).alias("k"), F.count("*").over(whole).alias("n"), wrap_deg(F.col("heading_deg") - F.lag("heading_deg").over(track_window())).alias("dh"))
    at = lambda cond, c: F.max(F.when(cond, F.col(c)))
    k, n = F.col("k"), F.col("n")
    spots = {"a": k == 1, "b": k == F.least(F.lit(6), n), "c": k == F.greatest(F.lit(1), n - 5), "d": k == n}
    g = numbered.groupBy("track_id").agg(F.max("n").alias("n"), F.coalesce(F.sum("dh"), F.lit(0.0)).alias("turn"), *[at(cond, c).alias(c + s) for s, cond in spots.items() for c in "xy"])
    angle = lambda p, q: F.degrees(F.atan2(F.col(f"y{q}") - F.col(f"y{p}"), F.col(f"x{q}") - F.col(f"x{p}")))
    net = wrap_deg(angle("c", "d") - angle("a", "b"))
    total = F.when(F.col("n") > 2, F.col("turn")).otherwise(0.0)
    j = g.join(tracks.select("track_id", "mean_kmh", "distance_m"), "track_id")
    kind = (
        F.when(F.col("n") < 3, "UNKNOWN").when((F.col("mean_kmh") < 3) & (F.col("distance_m") < 5), "STOPPED")
        .when((F.abs(net) > 140) | (F.abs(total) > 150), "U_TURN").when((net > 35) | (total > 45), "LEFT_TURN").when((net < -35) | (total < -45), "RIGHT_TURN").otherwise("STRAIGHT")
    )
    return j.select("track_id", kind.alias("movement_type"))


def turning_matrix(movements: DataFrame, ends_zones: DataFrame) -> DataFrame:
    """Tracks by origin, destination and movement, most first."""
    j = movements.join(ends_zones, "track_id").select(
        F.coalesce("origin_zone", F.lit("Unknown_Origin")).alias("origin_zone"), F.coalesce("destination_zone", F.lit("Unknown_Destination")).alias("destination_zone"), "movement_type"
    )
    return j.groupBy("origin_zone", "destination_zone", "movement_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "origin_zone", "destination_zone", "movement_type")


def od_matrix(ends_zones: DataFrame) -> DataFrame:
    """Origins against destinations with totals, in long form: (origin, destination, n)."""
    named = ends_zones.select(F.coalesce("origin_zone", F.lit("Origin_Unknown")).alias("o"), F.coalesce("destination_zone", F.lit("Dest_Unknown")).alias("d"))
    cubed = named.cube("o", "d").agg(F.count("*").alias("n"), F.grouping("o").alias("go"), F.grouping("d").alias("gd"))
    return cubed.select(F.when(F.col("go") == 1, "Total").otherwise(F.col("o")).alias("origin"), F.when(F.col("gd") == 1, "Total").otherwise(F.col("d")).alias("destination"), "n")


def od_table(ends_zones: DataFrame, destinations: list[str]) -> DataFrame:
    """``od_matrix`` with a column for each named destination and ``Total``."""
    return od_matrix(ends_zones).groupBy("origin").pivot("destination", [*destinations, "Total"]).agg(F.sum("n")).fillna(0)
