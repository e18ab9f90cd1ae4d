"""Rule-based events of single tracks and of pedestrian-vehicle pairs.

All detectors return the same columns (``COLUMNS``), so that their union is plain;
detectors of a user's own join by ``register``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.config import Events
from kerbside.functions.geometry import angle_between, length
from kerbside.operators import interactions
from kerbside.operators.kinematics import track_window

COLUMNS = ["event_type", "track_id", "other_id", "class_name", "start_s", "end_s", "start_frame", "end_frame", "severity", "confidence", "x", "y", "measure", "speed_kmh", "description"]


def _event(df: DataFrame, kind: str, confidence: float, severity: Column, other: Column | None = None, **columns: Column) -> DataFrame:
    values = {
        "event_type": F.lit(kind), "confidence": F.lit(confidence), "severity": severity,
        "other_id": (F.lit(None) if other is None else other).cast("bigint"),
    } | columns
    return df.select(*[values.get(c, F.col(c)).alias(c) for c in COLUMNS])


def _say(pattern: str, *values) -> Column:
    return F.format_string(pattern, *values)


def braking(kin: DataFrame, c: Events = Events()) -> DataFrame:
    """Runs of two points or more at or below the threshold that a later point of the track ends."""
    hard = F.coalesce(F.col("accel"), F.lit(0.0)) <= c.brake_mps2
    flagged = kin.withColumn("hard", hard)
    began = F.col("hard") & ~F.coalesce(F.lag("hard").over(track_window()), F.lit(False))
    runs = flagged.withColumn("run", F.sum(began.cast("int")).over(track_window())).withColumn("next", F.lead(F.struct("timestamp_s", "frame_id", "hard")).over(track_window())).where("hard")
    g = runs.groupBy("track_id", "run").agg(
        F.min("class_name").alias("class_name"), F.count("*").alias("n"), F.min("accel").alias("measure"),
        F.min_by(F.struct("timestamp_s", "frame_id", "x", "y", "speed_kmh"), "frame_id").alias("s"), F.max_by("next", "frame_id").alias("e"),
    ).where("n >= 2 and e is not null")
    level = F.when(F.col("measure") < -7, "CRITICAL").when(F.col("measure") < -5.5, "HIGH").otherwise("MEDIUM")
    return _event(
        g, "SUDDEN_BRAKING", 0.92, level, start_s=F.col("s.timestamp_s"), end_s=F.col("e.timestamp_s"), start_frame=F.col("s.frame_id"), end_frame=F.col("e.frame_id"),
        x=F.col("s.x"), y=F.col("s.y"), speed_kmh=F.col("s.speed_kmh"), description=_say("Track #%d (%s) braked hard, down to %.2f m/s^2.", F.col("track_id"), F.col("class_name"), F.col("measure")),
    )


def acceleration(kin: DataFrame, c: Events = Events()) -> DataFrame:
    """The first point of each track at or above the threshold."""
    g = kin.where(F.col("accel") >= c.accel_mps2).groupBy("track_id").agg(F.min_by(F.struct("class_name", "timestamp_s", "frame_id", "x", "y", "speed_kmh", "accel"), "frame_id").alias("s"))
    g = g.select("track_id", "s.*")
    return _event(
        g, "SUDDEN_ACCELERATION", 0.88, F.when(F.col("accel") > 5.5, "HIGH").otherwise("MEDIUM"), start_s=F.col("timestamp_s"), end_s=F.col("timestamp_s") + 0.5,
        start_frame=F.col("frame_id"), end_frame=F.col("frame_id") + 5, measure=F.col("accel"),
        description=_say("Track #%d (%s) accelerated by %.2f m/s^2.", F.col("track_id"), F.col("class_name"), F.col("accel")),
    )


def middle(points: DataFrame) -> DataFrame:
    """The point in the middle of each track (number n // 2, from 0)."""
    whole = Window.partitionBy("track_id")
    k = points.select("track_id", "x", "y", (F.row_number().over(track_window()) - 1).alias("k"), F.count("*").over(whole).alias("n"))
    return k.where(F.col("k") == F.floor(F.col("n") / 2)).select("track_id", "x", "y")


def stopped(kin: DataFrame, tracks: DataFrame, c: Events = Events()) -> DataFrame:
    """Tracks that stand still long enough."""
    t = tracks.where(F.col("dwell_s") >= c.dwell_s).join(middle(kin), "track_id")
    return _event(
        t, "STOPPED_VEHICLE", 0.95, F.when(F.col("dwell_s") < 15, "MEDIUM").otherwise("HIGH"), measure=F.col("dwell_s"), speed_kmh=F.col("mean_kmh"),
        description=_say("Track #%d (%s) stood for %.1f s.", F.col("track_id"), F.col("class_name"), F.col("dwell_s")),
    )


def wrong_way(kin: DataFrame, tracks: DataFrame, c: Events = Events()) -> DataFrame:
    """Moving vehicles whose mean heading opposes more than a share of all headings of moving vehicles.

    Headings are first counted by value; of the tenths of a degree that lie wholly inside
    the arc opposite to a mean the sum is looked up, and those that the limit cuts are
    compared exactly, value by value, so no mean meets every point or every cell.
    """
    moving = tracks.where((F.col("class_name") != "PEDESTRIAN") & (F.col("mean_kmh") > c.moving_kmh)).select("track_id")
    own = kin.join(moving, "track_id").select("track_id", "heading_deg")
    step, n = 10, 3600
    values = own.groupBy("heading_deg").agg(F.count("*").alias("n")).withColumn("cell", F.pmod(F.floor(F.col("heading_deg") * step), F.lit(n)).cast("int"))
    means = own.groupBy("track_id").agg(F.avg("heading_deg").alias("mean_h"))
    # at most 3600 cells, whatever the input: one array of the counts before each
    grid = kin.sparkSession.range(n).select(F.col("id").cast("int").alias("cell")).join(values.groupBy("cell").agg(F.sum("n").alias("n")), "cell", "left")
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = grid.select("cell", before.alias("before")).agg(F.array_sort(F.collect_list(F.struct("cell", "before"))).alias("s")).select(F.col("s.before").alias("before"))
    totals = values.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("cell").isNotNull(), F.col("n"))), F.lit(0)).alias("round"))
    judged = means.crossJoin(F.broadcast(sums.crossJoin(totals)))
    # headings far enough from a mean are an arc; cells from k to last lie inside, those about its ends are cut
    low, high = (F.col("mean_h") + c.wrong_way_deg) * step, (F.col("mean_h") + 360.0 - c.wrong_way_deg) * step
    judged = judged.select("*", (F.ceil(low) + 1).alias("k"), (F.floor(high) - 2).alias("last"), (F.floor(low) - 2).alias("from"), (F.ceil(high) + 1).alias("to"))
    upto = lambda k: F.floor(k / n) * F.col("round") + F.get("before", F.pmod(k, F.lit(n)).cast("int"))
    some = F.col("last") >= F.col("k")
    surely = F.when(some, upto(F.col("last") + 1) - upto(F.col("k"))).otherwise(F.lit(0))
    ends = F.when(some, F.concat(F.sequence("from", F.col("k") - 1), F.sequence(F.col("last") + 1, "to"))).when(F.col("from") <= F.col("to"), F.sequence("from", "to"))
    outside = F.filter(ends, lambda i: ~some | (F.pmod(i - F.col("k"), F.lit(n)) > F.col("last") - F.col("k")))
    unsure = F.array_distinct(F.transform(outside, lambda i: F.pmod(i, F.lit(n)).cast("int")))
    judged = judged.select("track_id", "mean_h", "total", surely.alias("sure"), unsure.alias("unsure"))
    cut = judged.select("track_id", "mean_h", F.explode("unsure").alias("cell")).join(values, "cell").where(angle_between(F.col("mean_h"), F.col("heading_deg")) >= c.wrong_way_deg)
    extra = cut.groupBy("track_id").agg(F.sum("n").alias("extra"))
    hit = judged.join(extra, "track_id", "left").where(F.col("sure") + F.coalesce("extra", F.lit(0)) > F.col("total") * c.wrong_way_share)
    t = hit.select("track_id", "mean_h").join(tracks, "track_id").join(middle(kin), "track_id")
    return _event(
        t, "WRONG_WAY", 0.91, F.lit("CRITICAL"), measure=F.col("mean_h"), speed_kmh=F.col("mean_kmh"),
        description=_say("Track #%d (%s) moved against the main direction (heading %.1f).", F.col("track_id"), F.col("class_name"), F.col("mean_h")),
    )


def cut_in(kin: DataFrame, c: Events = Events()) -> DataFrame:
    """Fast tracks with a sharp turn: its first sharpest point."""
    sharp = F.struct(F.abs("omega").alias("w"), (-F.col("frame_id")).alias("f"))
    g = kin.groupBy("track_id").agg(F.max_by(F.struct("class_name", "timestamp_s", "frame_id", "x", "y", "speed_kmh", F.abs("omega").alias("w")), sharp).alias("s"), F.avg("speed_mps").alias("mean"))
    g = g.select("track_id", "mean", "s.*").where((F.col("w") > c.cut_in_degps) & (F.col("mean") > c.cut_in_mps))
    return _event(
        g, "CUT_IN", 0.86, F.when(F.col("w") > 40, "HIGH").otherwise("MEDIUM"), start_s=F.col("timestamp_s"), end_s=F.col("timestamp_s") + 1.0,
        start_frame=F.col("frame_id"), end_frame=F.col("frame_id") + 10, measure=F.col("w"),
        description=_say("Track #%d (%s) swerved by %.1f deg/s.", F.col("track_id"), F.col("class_name"), F.col("w")),
    )


def vru(kin: DataFrame, tracks: DataFrame, c: Events = Events()) -> DataFrame:
    """Pedestrians and vehicles, present at the same time, whose paths come close.

    Paths are compared at all times, not only at the same one; repeated positions of a
    track count once.  Tracks are dealt to blocks, and each block of pedestrians meets
    each of vehicles once, as arrays: what is shuffled are paths, never pairs, and a
    pedestrian's row comes with those near it as an array that is unfolded last.
    """
    from kerbside.operators.interactions import _batches
    from kerbside.storage import materialise

    finite = lambda n: F.abs(n) < float("inf")
    spots = kin.where(finite("x") & finite("y")).groupBy("track_id").agg(F.collect_set(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("s"))
    walks = F.col("class_name") == "PEDESTRIAN"
    own = tracks.select("track_id", "class_name", "start_s", "end_s", walks.alias("_walks")).join(spots, "track_id")
    own = materialise(own.where("_walks is not null").select("*", F.col("s.x").alias("xs"), F.col("s.y").alias("ys")).drop("s"), "paths")
    n = {r["_walks"]: r["n"] for r in own.groupBy("_walks").agg(F.count("*").alias("n")).collect()}
    # some blocks of few tracks too, as a pair of blocks is the work of one task
    blocks = {side: max(-(-n.get(side, 0) // PATHS), min(LEAST, -(-n.get(side, 0) // 64))) for side in (True, False)}
    mine = lambda side: F.pmod(F.xxhash64("track_id"), F.lit(max(1, blocks[side])).cast("bigint"))
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, blocks[side]) - 1).cast("bigint")))
    ped = own.where("_walks").select("*", mine(True).alias("_p"), every(False).alias("_v"))
    both = ped.unionByName(own.where("not _walks").select("*", every(True).alias("_p"), mine(False).alias("_v")))
    kinds = dict(own.dtypes)
    limit = c.vru_m

    def run(batches):
        import pyarrow as pa

        yield from _met(pa.Table.from_batches(list(batches)), limit)

    run.__annotations__ = _batches()
    # paths are few beside their pairs: a number of partitions keeps them from being merged by their size
    both = both.repartition(int(kin.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_p", "_v")
    near = both.groupBy("_p", "_v").applyInArrow(run, f"track_id {kinds['track_id']}, near array<struct<veh: {kinds['track_id']}, veh_class: string, d: double>>")
    about = tracks.join(middle(kin), "track_id")
    # a row for each pedestrian and block of vehicles: joined before its pairs are unfolded
    t = near.join(F.broadcast(about.where(walks)) if n.get(True, 0) <= FEW_WALKERS else about, "track_id").select("*", F.inline("near")).drop("near")
    return _event(
        t, "PEDESTRIAN_VEHICLE_CONFLICT", 0.94, F.when(F.col("d") < c.vru_critical_m, "CRITICAL").otherwise("HIGH"), other=F.col("veh"), measure=F.col("d"), speed_kmh=F.col("mean_kmh"),
        description=_say("Pedestrian #%d came close to vehicle #%d (%s, %.2f m).", F.col("track_id"), F.col("veh"), F.col("veh_class"), F.col("d")),
    )


#: Tracks of a block of paths, pairs of tracks compared at once, and pedestrians whose rows may be broadcast.
PATHS, AT_ONCE, FEW_WALKERS = 2048, 1 << 20, 50_000
#: Blocks of each side at least, where it has 64 tracks for each.
LEAST = 4


def _met(own, limit: float):
    """Record batches (track_id, near) of the pedestrians of a table of paths and the vehicles that come close to them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from kerbside.operators.nearby import least

    def paths(t):
        xs, ys = t["xs"].combine_chunks(), t["ys"].combine_chunks()
        group = np.repeat(np.arange(len(t)), pc.list_value_length(xs).to_numpy(zero_copy_only=False).astype(np.int64))
        return group, xs.flatten().to_numpy(zero_copy_only=False), ys.flatten().to_numpy(zero_copy_only=False)

    walkers, others = own.filter(own["_walks"]), own.filter(pc.invert(own["_walks"]))
    if not len(walkers) or not len(others):
        return
    there = paths(others)
    span = lambda t, name: t[name].to_numpy()
    ids, kinds = others["track_id"].combine_chunks(), others["class_name"].combine_chunks()
    step = max(1, AT_ONCE // len(others))
    for k in range(0, len(walkers), step):
        some = walkers.slice(k, step)
        asked = (span(some, "start_s")[:, None] <= span(others, "end_s")[None]) & (span(others, "start_s")[None] <= span(some, "end_s")[:, None])
        d = np.sqrt(least(paths(some), there, asked, limit))
        at, who = np.nonzero(d < limit)
        pair = pa.StructArray.from_arrays([ids.take(pa.array(who)), kinds.take(pa.array(who)), pa.array(d[at, who])], names=["veh", "veh_class", "d"])
        ends = np.searchsorted(at, np.arange(len(some) + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(ends), pair)
        yield pa.RecordBatch.from_arrays([some["track_id"].combine_chunks(), near], ["track_id", "near"])


Detector = Callable[[DataFrame, DataFrame, Events], DataFrame]
_DETECTORS: dict[str, Detector] = {
    "braking": lambda k, t, c: braking(k, c), "acceleration": lambda k, t, c: acceleration(k, c), "stopped": stopped, "wrong_way": wrong_way,
    "cut_in": lambda k, t, c: cut_in(k, c), "vru": vru,
}


def register(name: str, detector: Detector) -> None:
    """Add a detector of points and tracks; it has to return ``COLUMNS``."""
    _DETECTORS[name] = detector


def detect_all(kin: DataFrame, tracks: DataFrame, c: Events = Events(), isolate: bool = False) -> DataFrame:
    """Union of all detectors. With ``isolate`` each is run at once, and one that fails is left out with a warning."""
    import logging

    from kerbside.storage import materialise

    out = None
    for name, detector in _DETECTORS.items():
        try:
            found = detector(kin, tracks, c).select(*COLUMNS)
            found = materialise(found, name) if isolate else found
        except Exception:
            if not isolate:
                raise
            logging.getLogger("kerbside.events").warning("detector %s failed", name, exc_info=True)
            continue
        out = found if out is None else out.unionByName(found)
    return out


#: Prefixes of event ids by type; other types take their own name.
PREFIXES = {
    "SUDDEN_BRAKING": "BRAKE_", "SUDDEN_ACCELERATION": "ACCEL_", "STOPPED_VEHICLE": "STOP_", "WRONG_WAY": "WRONGWAY_", "CUT_IN": "CUTIN_",
    "PEDESTRIAN_VEHICLE_CONFLICT": "VRU_", "UNSUPERVISED_TRAJECTORY_ANOMALY": "ANOMALY_",
}


def with_ids(happened: DataFrame) -> DataFrame:
    """Events with an ``event_id``, numbered within their type by first frame, road users and last frame."""
    known = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    prefix = F.coalesce(known[F.col("event_type")], F.concat("event_type", F.lit("_")))
    return interactions.named(happened, prefix, ["start_frame", "track_id", "other_id", "end_frame"], ["event_type"]).select("event_id", *happened.columns)
