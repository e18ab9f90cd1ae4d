"""Mixing sources to target weights, with DataFrame functions only.

The size of a document is its number of words.  Sources in code-point order (null
last) weigh 1, 2, 3, 1, 2, 3, ... and share the total of all sizes in proportion;
no target exceeds ``cap`` times its source's size, and what is cut is shared anew
by weight.  A source's rate is target / size; a document is taken floor(rate)
times, and once more if its hash-seeded uniform number is below the fraction.

Targets by water-filling in one pass: a source is full at the level
cap * size / weight; in ascending order of that level, the first sources are full
and all others share what is left.

Cases: null text has size 0; a source of size 0 has target 0, rate 0 and none of
its documents is taken; rows that repeat an id draw the same number; an empty
table gives an empty result; further columns, of any name, are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeated; fixed by the contract of the query.
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "kerbside-mix"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the id: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows (source, source_size), one for each source.

    The windows have no partition: they run over one aggregated row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn("weight", F.get(values, (F.row_number().over(order) - 1) % len(weights)).cast("bigint"))
    # ascending level cap * size / weight; compared without division
    filled = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    levelled = weighed.select(
        "*",
        F.sum("source_size").over(whole).alias("total"), F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)).alias("full_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    rest, share = F.col("total") - F.col("full_before"), F.col("weights") - F.col("weight_before")
    # full if its cap is at most its share of what the sources before leave
    full = F.lit(cap) * F.col("source_size") * share <= rest * F.col("weight")
    marked = levelled.select("*", full.alias("full"), rest.alias("rest"), share.alias("share"))
    first = F.first(F.when(~F.col("full"), F.struct("rest", "share")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return marked.withColumn("open", first).select(
        "source", "source_size",
        F.when(F.col("full"), (F.lit(cap) * F.col("source_size")).cast("double"))
        .otherwise(F.col("weight") * F.col("open.rest") / F.col("open.share")).alias("target"),
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, its ``size``, ``source_size``, ``target`` and ``copies``."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums, **options).withColumnRenamed("source", "name")
    joined = sized.join(goal, F.col("source").eqNullSafe(F.col("name")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.select("row", "size", "source_size", "target", (whole + (uniform("id") < rate - whole).cast("bigint")).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as its source's rate says, with all columns of ``docs``."""
    chosen = plan(docs, **options).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op9 over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan(docs).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
    )


DIGEST_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM sums),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
    CAST(coalesce(sum(3 * source_size) OVER w, 0) AS BIGINT) AS full_before, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weight_before
  FROM weighed
  WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 3 * source_size * (weights - weight_before) <= (total - full_before) * weight AS is_full FROM levels),
level AS (
  SELECT total - full_before AS rest, weights - weight_before AS share FROM marked WHERE NOT is_full
  ORDER BY CAST(source_size AS DOUBLE) / weight ASC, source ASC NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(weight * (SELECT rest FROM level) AS DOUBLE) / (SELECT share FROM level) END AS target
  FROM marked),
rates AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('kerbside-mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken
FROM rates
"""
