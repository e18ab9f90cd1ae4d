"""Pairs of road users: proximity edges, conflicts and post-encroachment times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.config import Conflict
from kerbside.functions.geometry import angle_between, length


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Rows of ``left`` with rows of ``right`` in the same ``keys`` at most ``radius`` away.

    Both sides carry the cell of a grid as wide as the radius; the left side names the
    nine cells around it, so the join is an equality on keys and cell whatever the
    density, and the distance is tested after it.  The sides come as structs ``a``, ``b``.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    a = left.select(*keys, F.struct(*left.columns).alias("a"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    a = a.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).select(*keys, "a", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"))
    b = right.select(*keys, F.struct(*right.columns).alias("b"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    met = a.join(b, [*keys, "_cx", "_cy"])
    return met.where(length(F.col(f"b.{x}") - F.col(f"a.{x}"), F.col(f"b.{y}") - F.col(f"a.{y}")) <= radius).drop("_cx", "_cy")


def pairs_within(points: DataFrame, radius: float, keys: list[str], name: str, x: str = "x", y: str = "y") -> DataFrame:
    """Each pair of rows in the same ``keys`` at most ``radius`` away once, as structs ``a`` and ``b`` in the order of ``name``.

    The plane is cut into slabs as in ``conflicts``, so that rows are sent once and a quarter on
    average.  A slab returns rows with the places of the pairs among them, which are unfolded
    last: no pair is shuffled, sorted or written.
    """
    place = lambda c: F.col(c).cast("double")
    known = points.where(" and ".join(f"`{c}` is not null" for c in [*keys, name])).where((F.abs(place(x)) < float("inf")) & (F.abs(place(y)) < float("inf")))
    sent = _slabs(known.select(*keys, F.struct(*points.columns).alias("row")), place(f"row.{x}"), radius)
    kinds = dict(sent.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"rows array<{kinds['row']}>", "pairs array<struct<i: int, j: int>>"])

    def run(batches):
        import pyarrow as pa

        from kerbside.operators.nearby import within

        t = pa.Table.from_batches(list(batches)).combine_chunks()
        rows, mine = t["row"].combine_chunks(), t["_own"].to_numpy()
        field = lambda c: rows.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        rank = np.unique(rows.field(name).to_numpy(zero_copy_only=False), return_inverse=True)[1].ravel()
        key = t.select(keys).slice(0, 1)
        for i, j in within(field(x), field(y), radius):
            # a pair of two guests is found where they are at home
            use = (mine[i] | mine[j]) & (rank[i] != rank[j])
            i, j = i[use], j[use]
            if not len(i):
                continue
            first = rank[i] < rank[j]
            i, j = np.where(first, i, j), np.where(first, j, i)
            met = np.zeros(len(rows), bool)
            met[i] = met[j] = True
            at = np.cumsum(met, dtype=np.int32) - 1
            pair = pa.StructArray.from_arrays([pa.array(at[i]), pa.array(at[j])], names=["i", "j"])
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            yield key.append_column("rows", one(rows.take(pa.array(np.flatnonzero(met))))).append_column("pairs", one(pair)).to_batches()[0]

    run.__annotations__ = _batches()
    # rows are few beside their pairs: a number of partitions keeps them from being merged by their size
    sent = sent.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_slab")
    met = sent.groupBy(*keys, "_slab").applyInArrow(run, schema)
    return met.select(*keys, "rows", F.inline("pairs")).select(*keys, F.get("rows", F.col("i")).alias("a"), F.get("rows", F.col("j")).alias("b"))


def _slabs(rows: DataFrame, x: Column, radius: float) -> DataFrame:
    """``rows`` with the slab along x, four radii wide, they are sent to: their own and, at most a radius beyond its start, the one before it as guests."""
    wide = 4 * radius
    slab = F.floor(x / wide).cast("bigint")
    guest = x - slab * wide <= radius * (1 + 1e-9)
    at = lambda n, own: F.struct(n.alias("at"), F.lit(own).alias("own"))
    sent = rows.withColumn("_s", F.explode(F.when(guest, F.array(at(slab, True), at(slab - 1, False))).otherwise(F.array(at(slab, True)))))
    return sent.select("*", F.col("_s.at").alias("_slab"), F.col("_s.own").alias("_own")).drop("_s")


def edges(kin: DataFrame, radius: float = 25.0) -> DataFrame:
    """Unordered pairs of one frame within the radius, with distance, relative and closing speed and heading difference."""
    p = kin.select("frame_id", "timestamp_s", "track_id", "class_name", "x", "y", "vx", "vy", "heading_deg")
    met = pairs_within(p, radius, ["frame_id"], "track_id")
    c: dict[str, Column] = {f"{s}_{n}": F.col(f"{s}.{n}") for s in "ab" for n in ("track_id", "class_name", "x", "y", "vx", "vy", "heading_deg")}
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    dx, dy = c["b_x"] - c["a_x"], c["b_y"] - c["a_y"]
    vx, vy = zero(c["b_vx"]) - zero(c["a_vx"]), zero(c["b_vy"]) - zero(c["a_vy"])
    d = length(dx, dy)
    return met.select(
        "frame_id", F.col("a.timestamp_s").alias("timestamp_s"), c["a_track_id"].alias("track_a"), c["b_track_id"].alias("track_b"),
        c["a_class_name"].alias("class_a"), c["b_class_name"].alias("class_b"), d.alias("distance_m"), length(vx, vy).alias("relative_speed_mps"),
        F.when(d > 1e-4, -(dx * vx + dy * vy) / d).otherwise(0.0).alias("closing_speed_mps"),
        angle_between(zero(c["a_heading_deg"]), zero(c["b_heading_deg"])).alias("heading_diff_deg"),
        dx.alias("dx"), dy.alias("dy"), vx.alias("dvx"), vy.alias("dvy"), ((c["a_x"] + c["b_x"]) / 2.0).alias("mid_x"), ((c["a_y"] + c["b_y"]) / 2.0).alias("mid_y"),
    )


#: Columns of ``conflicts`` and their types; None: that of a column of the points.
CONFLICT = {
    "frame_id": None, "timestamp_s": None, "track_a": "track_id", "track_b": "track_id", "class_a": "class_name", "class_b": "class_name",
    "conflict_type": "string", "severity": "string", "ttc_s": "double", "drac_mps2": "double", "distance_m": "double",
    "relative_speed_mps": "double", "closing_speed_mps": "double", "mid_x": "double", "mid_y": "double",
}
TYPES = ("PEDESTRIAN_VEHICLE", "MOTORCYCLE_VEHICLE", "REAR_END", "MERGING", "CROSSING", "HEAD_ON")
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def _measured(own, columns: list[str], c: Conflict):
    """Record batches of the conflicts among the points of a table: the measures of ``functions.safety`` over arrays.

    A comparison with a number that isn't one holds, as it is the largest in Spark.
    """
    import pyarrow as pa

    from kerbside.operators.nearby import within

    over = lambda v, limit: ~(v < limit)
    number = lambda name: own[name].combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False)
    x, y, vx, vy, heading = (number(n) for n in ("x", "y", "vx", "vy", "heading_deg"))
    mine, track, label = own["_own"].to_numpy(), own["track_id"], own["class_name"].to_pandas().to_numpy()
    rank = np.unique(track.to_numpy(), return_inverse=True)[1]
    walker, rider = label == "PEDESTRIAN", label == "MOTORCYCLE"
    named = lambda names, codes: pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int8)), pa.array(names)).cast(pa.string())
    for i, j in within(x, y, c.radius_m):
        # a pair of two guests is found where they are at home
        use = np.flatnonzero((mine[i] | mine[j]) & (rank[i] != rank[j]))
        i, j = i[use], j[use]
        first = rank[i] < rank[j]
        i, j = np.where(first, i, j), np.where(first, j, i)
        dx, dy, dvx, dvy = x[j] - x[i], y[j] - y[i], vx[j] - vx[i], vy[j] - vy[i]
        d, dot = np.sqrt(dx * dx + dy * dy), dx * dvx + dy * dvy
        gap = dx * dx + dy * dy - c.collision_radius_m * c.collision_radius_m
        if c.drac_medium > 0:
            # a pair that doesn't close has neither a time to collision nor a deceleration, unless it touches
            use = np.flatnonzero(~(dot >= 0) | (gap <= 0) | (d < c.near_m))
            i, j, dx, dy, dvx, dvy, d, dot, gap = (v[use] for v in (i, j, dx, dy, dvx, dvy, d, dot, gap))
        with np.errstate(all="ignore"):
            closing = np.where(d > 1e-4, -dot / d, 0.0)
            a, b = dvx * dvx + dvy * dvy, 2.0 * dot
            speed, disc = np.sqrt(a), b * b - 4.0 * a * gap
            root, base = np.sqrt(np.where(disc > 0, disc, 0.0)), np.where(a < 1e-6, 1.0, 2.0 * a)
            t1, t2 = (-b - root) / base, (-b + root) / base
            inside = lambda t: (t >= 0) & (t <= c.horizon_s)
            ttc = np.where(inside(t1), t1, np.where(inside(t2), t2, np.inf))
            ttc = np.where(gap <= 0, 0.0, np.where((a < 1e-6) | over(b, 0) | (disc < 0), np.inf, ttc))
            drac = np.where(closing <= 0, 0.0, closing * closing / (2.0 * np.maximum(0.1, d - 2.0)))
        use = np.flatnonzero((ttc <= c.ttc_medium_s) | over(drac, c.drac_medium) | ((d < c.near_m) & (over(speed, c.near_speed_mps) & (speed != c.near_speed_mps))))
        if not len(use):
            continue
        i, j, dx, dy, d, speed, closing, ttc, drac = (v[use] for v in (i, j, dx, dy, d, speed, closing, ttc, drac))
        turn = np.fmod(np.abs(heading[i] - heading[j]), 360.0)
        turn = np.where(turn > 180.0, 360.0 - turn, turn)
        half = lambda p, q: (p + q) / 2
        steps = (c.ttc_critical_s, c.drac_critical), (half(c.ttc_critical_s, c.ttc_medium_s), half(c.drac_critical, c.drac_medium)), (c.ttc_medium_s, c.drac_medium)
        make = {
            "frame_id": lambda: own["frame_id"].take(i), "timestamp_s": lambda: own["timestamp_s"].take(i), "track_a": lambda: track.take(i), "track_b": lambda: track.take(j),
            "class_a": lambda: own["class_name"].take(i), "class_b": lambda: own["class_name"].take(j),
            "conflict_type": lambda: named(TYPES, np.select([walker[i] | walker[j], rider[i] | rider[j], turn < 35, turn < 85, turn < 145], range(5), 5)),
            "severity": lambda: named(LEVELS, np.select([(ttc <= t) | over(drac, q) for t, q in steps], range(3), 3)),
            "ttc_s": lambda: pa.array(ttc, mask=np.isinf(ttc)), "drac_mps2": lambda: pa.array(drac), "distance_m": lambda: pa.array(d),
            "relative_speed_mps": lambda: pa.array(speed), "closing_speed_mps": lambda: pa.array(closing),
            "mid_x": lambda: pa.array((x[i] + x[j]) / 2.0), "mid_y": lambda: pa.array((y[i] + y[j]) / 2.0),
        }
        arrays = [make[n]() for n in columns]
        yield pa.RecordBatch.from_arrays([v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in arrays], columns)


def conflicts(kin: DataFrame, c: Conflict = Conflict(), columns: list[str] | None = None) -> DataFrame:
    """Pairs of one frame that are close to a collision, with their measures, type and severity; only ``columns`` where given.

    A frame is cut along x into slabs of four radii; points at most a radius beyond a
    slab's start are guests in the one before it.  Pairs of a slab are tested in blocks
    of arrays and only conflicts leave it: as expressions over a join these measures
    outgrow a compiled method, and each pair was interpreted.
    """
    columns = list(columns or CONFLICT)
    types = dict(kin.dtypes)
    schema = ", ".join(f"`{n}` {types.get(CONFLICT[n] or n, CONFLICT[n])}" for n in columns)
    finite = lambda n: F.abs(n) < float("inf")
    p = kin.select("frame_id", "timestamp_s", "track_id", "class_name", *[F.col(n).cast("double").alias(n) for n in ("x", "y", "vx", "vy", "heading_deg")])
    p = p.where("frame_id is not null and track_id is not null").where(finite("x") & finite("y"))
    p = _slabs(p, F.col("x"), c.radius_m)

    def run(batches):
        import pyarrow as pa

        yield from _measured(pa.Table.from_batches(list(batches)), columns, c)

    run.__annotations__ = _batches()
    return p.groupBy("frame_id", "_slab").applyInArrow(run, schema)


def _batches() -> dict:
    """Annotations of a function from record batches to record batches, by which Spark tells its form."""
    import pyarrow as pa

    return {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def first_conflicts(kin: DataFrame, n: int, c: Conflict = Conflict()) -> DataFrame:
    """The first ``n`` conflicts by frame and road users.

    Conflicts lie within a frame, so frames are searched in order, twice as many each
    time, until enough are found or none is left; later frames form no pairs.
    """
    from kerbside.storage import materialise

    kin = materialise(kin, "points")
    after = kin.select("frame_id").where("frame_id is not null").distinct()
    found, k = None, 1
    while True:
        upto = after.orderBy("frame_id").limit(k).agg(F.max("frame_id").alias("f"), F.count("*").alias("n")).first()
        if upto["n"] == 0:
            break
        here = kin.where(F.col("frame_id") <= upto["f"])
        here = conflicts(here if found is None else here.where(F.col("frame_id") > last), c).orderBy("frame_id", "track_a", "track_b").limit(n)
        found = materialise(here if found is None else found.unionByName(here), "first")
        last = upto["f"]
        after, k = after.where(F.col("frame_id") > last), 2 * k
        if found.count() >= n:
            break
    found = conflicts(kin.limit(0), c) if found is None else found
    return found.orderBy("frame_id", "track_a", "track_b").limit(n)


def named(df: DataFrame, prefix: str | Column, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds ``event_id``: the prefix and the number of the row in a total order, five digits at least.

    Numbers start anew for each value of ``by``, of which there have to be few.  They
    follow from counts by range: rows are range-partitioned by the order, each
    partition numbers its own, and the offset of a partition is the sum of those before
    it.  No task sees more than its range.
    """
    from pyspark.sql.window import Window

    from kerbside.storage import materialise

    by = by or []
    keys = [*by, *order]
    ranged = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()), "numbered")
    own = Window.partitionBy("_p", *by).orderBy(*order)
    sizes = ranged.groupBy("_p", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each partition and group
    numbered = ranged.withColumn("_k", F.row_number().over(own)).join(F.broadcast(offsets), ["_p", *by])
    digits = (F.col("_before") + F.col("_k")).cast("string")
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return numbered.withColumn("event_id", F.concat(prefix, F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), F.lit("0")))).drop("_p", "_k", "_before")


def pet_pairs(points: DataFrame, cell: float = 2.0, limit: float = 5.0) -> DataFrame:
    """Least time between the last visit of one track to a cell and any visit of another, by pair (a before b in id)."""
    at = points.select("track_id", "frame_id", "timestamp_s", F.floor(F.col("x") / cell).cast("bigint").alias("cx"), F.floor(F.col("y") / cell).cast("bigint").alias("cy"))
    last = at.groupBy("cx", "cy", F.col("track_id").alias("track_a")).agg(F.max_by("timestamp_s", "frame_id").alias("ta"))
    other = at.select("cx", "cy", F.col("track_id").alias("track_b"), F.col("timestamp_s").alias("tb"))
    met = last.join(other, ["cx", "cy"]).where("track_a < track_b").withColumn("pet", F.abs(F.col("tb") - F.col("ta"))).where(F.col("pet") <= limit)
    return met.groupBy("track_a", "track_b").agg(F.min("pet").alias("pet_s"))
