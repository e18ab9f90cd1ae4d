"""Exact set-similarity join of documents by their word n-grams, with set-relation skipping.

A document's set holds the hashes of its distinct ``k``-word shingles.  Two sets
link if ``100 * |A & B| >= percent * |A | B|``.

1. Tokens of a set are ordered by rarity, then by hash.  Rarity comes from two
   sketches of fixed size over the whole corpus: of shingles that recur, and of the
   words in them.  It is part of the token, so the order is one and the same
   everywhere, and any order gives the same links.  Rare tokens come first: edited
   copies differ in their first tokens, and what many documents share comes last.
2. Equal sets form one set, known by a 64-bit value that is checked by a second one.
3. The first ``n - ceil(percent * n / 100) + 1`` tokens of a set enter inverted
   lists.  Only lists with two sets or more are kept.
4. Every list links its members to its leader, the set with the token at the
   smallest position, if positions and sizes allow it.  These pairs are verified.
5. Index-level skipping: the members of a list form blocks of equal size and
   position; a pair of blocks is skipped as a whole if the tokens that follow the
   common one are too few, or if all their members are in one component already.
6. Answer-level skipping: the answers of a leader are used for the sets near it.
   The Jaccard distance is a metric, so with the distances x and y of two sets
   from their leader, the pair cannot link if |x - y| exceeds the limit and links
   without a look at the sets if x + y does not.
7. What is left is verified on the whole sets, and all links are joined by
   distributed union-find.

Before a set is sent to a verification, a digest of 128 bytes is compared: tokens
are dealt to ``PARTS`` parts by hash, and each part has four bits that change with
its tokens.  Parts that differ are at most as many as tokens that differ, so a pair
with more of them than the sizes allow cannot link.

No link is lost: the first common token of two sets that link lies in the prefixes
of both and passes the tests of step 5; pairs skipped in steps 4 to 6 either cannot
link or are connected already.

A token holds 50 bits of a shingle's hash: two of m shingles of a pair of sets share
one by chance with odds of about m**2 / 2**51, and a set's size is then one less.

Cases: null, empty and word-less texts have the empty set and are linked with
nothing; fewer than ``k`` words form one shingle; rows that repeat an id are
members of each other's component only by their texts; ties in rarity are broken
by hash; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.components import connected_components
from kerbside.llm.textvec import BLANK_LOWER, U64, Words, map_batches, mix, ngrams, row_key, slices
from kerbside.storage import drop_materialised, materialise, release

K, PERCENT = 3, 90
#: Counters of the sketch of word counts: its size, whatever the corpus has.
SKETCH_BITS = 18
#: Counters of the sketch of shingles, and how often a task has to see one to report it.
SHINGLE_BITS, SEEN_OFTEN = 24, 3
#: A shingle counts as frequent from so many times the mean counter on, which bounds how many there are.
FREQUENT = 16
#: Bits of a token that hold its rarity: 6 of the shingle's level, 8 of its words'.
RARITY_BITS = 14
#: Bits of the bitmap that spares sets nobody asks for; a full one only costs time.
FILTER_BITS = 25
#: Parts of a digest, of four bits each; a multiple of 16.
PARTS = 256


def _sketch(texts: DataFrame, k: int) -> DataFrame:
    """(kind, bucket, n): words (0) by the leading bits of their hash, and shingles (1) that a task sees often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        recur = np.zeros(1 << SHINGLE_BITS, np.uint16)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), BLANK_LOWER)
                h = words.hashes()
                if not len(h):
                    continue
                total += np.bincount((h >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                at, n = np.unique((ngrams(h, k) >> U64(64 - SHINGLE_BITS)).astype(np.int64), return_counts=True)
                recur[at] = np.minimum(recur[at] + n, 65535)
        for kind, counts in ((0, total), (1, np.where(recur >= SEEN_OFTEN, recur, 0))):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["kind", "bucket", "n"]
            )

    return map_batches(texts, run, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def _levels(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the buckets of both sketches, from 0 (rarest).

    At most 2**SKETCH_BITS words and 2**SHINGLE_BITS / FREQUENT shingles reach the
    driver: no more buckets can hold FREQUENT times the mean.
    """
    counted = materialise(_sketch(texts, k), "sketch")
    mean = (counted.where("kind = 1").agg(F.sum("n")).first()[0] or 0) / (1 << SHINGLE_BITS)
    # Arrow: a row object for each bucket would take hundreds of MB of the driver
    rows = counted.where((F.col("kind") == 0) | (F.col("n") > FREQUENT * mean)).toArrow()
    drop_materialised(counted)
    kinds, buckets, n = (rows.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    word, shingle = np.zeros(1 << SKETCH_BITS, np.uint16), np.zeros(1 << SHINGLE_BITS, np.uint8)
    for kind, out, per, top in ((0, word, 6, 340), (1, shingle, 2, 63)):
        own = kinds == kind
        out[buckets[own]] = np.minimum(top, np.floor(per * np.log2(n[own].astype(np.float64))))
    del rows, kinds, buckets, n
    release(texts.sparkSession)
    return word, shingle


def token_sets(words: Words, levels: tuple[np.ndarray, np.ndarray], k: int = K, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of all texts, one after the other, and the bounds of each text's (n + 1)."""
    h = words.hashes()
    of_words, of_shingles = levels
    rarity = of_words[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64)
    counts = words.counts()
    grams = ngrams(h, k)
    level = np.zeros(len(grams), U64)
    for j in range(k):
        level += rarity[j : j + len(grams)]
    recur = of_shingles[(grams >> U64(64 - SHINGLE_BITS)).astype(np.int64)].astype(U64)
    if seed:
        grams = mix(grams + U64(seed))
    top, low = U64(64 - RARITY_BITS), U64(RARITY_BITS)
    tokens = ((recur << U64(8) | np.minimum(level >> U64(2), U64(255))) << top) | (grams >> low)
    out, bounds = [], np.zeros(len(counts) + 1, np.int64)
    for d, (lo, n) in enumerate(zip(words.first[:-1].tolist(), counts.tolist())):
        if n >= k:
            own = np.unique(tokens[lo : lo + n - k + 1])
        elif n:
            # shorter than a shingle: one token that no longer text has
            own = ngrams(h[lo : lo + n], n) * U64(2 * n + 1) >> low
        else:
            own = np.zeros(0, U64)
        out.append(own)
        bounds[d + 1] = bounds[d] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, U64)), bounds


def _signatures(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit values of each set."""
    sizes = np.diff(bounds)
    out = []
    for role in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.zeros(len(sizes), U64)
        full = sizes > 0
        if full.any():
            sums[full] = np.add.reduceat(mix(tokens + U64(role)), bounds[:-1][full])
        out.append(mix(sums + sizes.astype(U64)))
    return out[0], out[1]


def _digests(tokens: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Digests of the sets ``docs``, shape (sets, PARTS / 16), 16 parts of four bits in each number."""
    sizes = (bounds[1:] - bounds[:-1])[docs]
    at = np.repeat(bounds[:-1][docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    h = mix(tokens[at] + U64(0x5851F42D4C957F2D))
    cell = np.repeat(np.arange(len(docs)), sizes) * PARTS + (h & U64(PARTS - 1)).astype(np.int64)
    sums = np.bincount(cell, ((h >> U64(32)) & U64(15)).astype(np.float64), minlength=len(docs) * PARTS)
    nibbles = (sums.astype(np.int64) & 15).astype(U64).reshape(len(docs), PARTS // 16, 16)
    return np.bitwise_or.reduce(nibbles << (U64(4) * np.arange(16, dtype=U64)), axis=2)


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _prefixes(texts: DataFrame, levels, percent: int, k: int, seed: int) -> DataFrame:
    """A row for each text: id, n, v, check and, at a set's first sight within the task, its prefix and its digest."""
    schema = f"id {texts.schema['id'].dataType.simpleString()}, n bigint, v bigint, check bigint, prefix array<bigint>, digest array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = token_sets(Words(part.column("text"), BLANK_LOWER), levels.value, k, seed)
                sizes = np.diff(bounds)
                v, check = _signatures(tokens, bounds)
                take = np.where(sizes > 0, prefix_length(sizes, percent), 0)
                for d, x in enumerate(v.tolist()):
                    if x in seen:
                        take[d] = 0
                    seen.add(x)
                if len(seen) > 250_000:
                    seen.clear()  # only spares repeats
                at = np.repeat(bounds[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())
                digests = _digests(tokens, bounds, np.flatnonzero(take))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes), pa.array(v.view(np.int64)), pa.array(check.view(np.int64)), _lists(tokens[at], take), _lists(digests.ravel(), np.where(take > 0, PARTS // 16, 0))],
                    names=["id", "n", "v", "check", "prefix", "digest"],
                )

    return map_batches(texts, run, schema)


def _needed(texts: DataFrame, wanted: DataFrame, levels, k: int, seed: int) -> DataFrame:
    """(v, tokens) of the sets whose value is in ``wanted`` (v)."""
    spark = texts.sparkSession
    bits = wanted.select(F.expr(f"v & {(1 << FILTER_BITS) - 1}").alias("b"))
    rows = bits.groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m")).collect()
    flags = np.zeros((1 << FILTER_BITS) // 8 + 8192, np.uint8)
    for r in rows:  # at most 2**FILTER_BITS / 32768 rows of 4 KB
        # a bucket holds 32768 positions, the first bucket those of 1 ... 32768
        flags[(r.k - 1) * 4096 : r.k * 4096] |= np.frombuffer(bytes(r.m), np.uint8)
    shared = spark.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = token_sets(Words(part.column("text"), BLANK_LOWER), levels.value, k, seed)
                v, _ = _signatures(tokens, bounds)
                # bitmap_bit_position counts from 0 for 1, within buckets of 32768
                b = (v & U64((1 << FILTER_BITS) - 1)).astype(np.int64)
                b = np.where(b > 0, b - 1, 0)  # 0 shares the flag of 1
                ask = (flags_of(shared)[b >> 3] >> (b & 7)) & 1
                keep = [d for d, x in enumerate(v.tolist()) if (ask[d] or v[d] & U64((1 << FILTER_BITS) - 1) == 0) and bounds[d + 1] > bounds[d] and not (x in seen or seen.add(x))]
                if len(seen) > 250_000:
                    seen.clear()
                if keep:
                    parts = [tokens[bounds[d] : bounds[d + 1]] for d in keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v[keep].view(np.int64)), _lists(np.concatenate(parts), np.array([len(p) for p in parts]))], names=["v", "tokens"]
                    )

    flags_of = lambda x: x.value
    found = map_batches(texts.select("text"), run, "v bigint, tokens array<bigint>")
    return found.join(wanted.select("v").distinct(), "v", "left_semi").groupBy("v").agg(F.first("tokens").alias("tokens"))


def _least_overlap(a: str, b: str, percent: int) -> Column:
    """Smallest number of common tokens with which sets of these sizes link."""
    return F.expr(f"cast(ceil({percent} * ({a} + {b}) / {100 + percent}D) as bigint)")


def _may_link(percent: int, a: str = "a", b: str = "b") -> Column:
    """Whether sets of these sizes, with their first common token at these positions, can link."""
    need = _least_overlap(f"{a}.n", f"{b}.n", percent)
    fits = (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * percent) & (F.col(f"{b}.n") * 100 >= F.col(f"{a}.n") * percent)
    return fits & (F.col(f"{a}.n") - F.col(f"{a}.pos") >= need) & (F.col(f"{b}.n") - F.col(f"{b}.pos") >= need)


def _may_be_near(pairs: DataFrame, digests: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) that their digests (v, n, digest) allow to link."""
    left, right = (digests.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("digest").alias(f"d_{x}")) for x in "ab")
    met = pairs.join(right, "b").join(left, "a")
    spread = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    changed = F.zip_with("d_a", "d_b", lambda x, y: F.bit_count(spread(x.bitwiseXOR(y)).bitwiseAND(F.lit(0x1111111111111111))))
    differing = F.aggregate(changed, F.lit(0), lambda t, x: t + x)
    allowed = F.col("n_a") + F.col("n_b") - 2 * _least_overlap("n_a", "n_b", percent)
    return met.where(differing <= allowed).select(*pairs.columns)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, na, nb) for pairs of set values."""
    left = sets.select(F.col("v").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("v").alias("b"), F.col("tokens").alias("tb"))
    met = pairs.select("a", "b").join(right, "b").join(left, "a")
    return met.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("common"), F.size("ta").cast("bigint").alias("na"), F.size("tb").cast("bigint").alias("nb"))


def _links(percent: int) -> Column:
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = K, seed: int = 0) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``n_links``: one row for each document.

    ``component_id`` is the smallest id reachable by links, the own one included.
    ``n_links`` counts the links between different sets that were verified; others
    of its component were skipped because it was connected already.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(_levels(texts.select("text"), k))  # 2**SKETCH_BITS numbers of 2 bytes, 2**SHINGLE_BITS of one
    while True:
        rows = materialise(_prefixes(texts, levels, percent, k, seed), "prefixes")
        sets = rows.where("n > 0")
        if sets.groupBy("v").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").isEmpty():
            break
        seed += 1  # two sets share a value: draw other values for all

    # lists with two sets or more; the sort key orders members by position, then by value
    # one shuffle: n and pos share a number, and all that is asked of a list is asked where its members lie
    postings = sets.select("v", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "v", F.expr("shiftleft(n, 32) | cast(pos as bigint)").alias("np"))
    postings = postings.repartition("token").select("token", "v", F.shiftright("np", 32).alias("n"), F.expr("cast(np & 4294967295 as int)").alias("pos"))
    own = Window.partitionBy("token")
    ends = postings.withColumn("key", F.expr("shiftleft(cast(least(pos, 4095) as bigint), 51) | shiftrightunsigned(v, 13)")).select("*", F.min("key").over(own).alias("first"), F.max("key").over(own).alias("last"))
    several = ends.where("first <> last").drop("last").dropDuplicates(["token", "v"])
    # step 4: leaders, of equal keys the smallest value
    leader = F.min(F.when(F.col("key") == F.col("first"), F.struct("v", "n", "pos"))).over(own)
    lists = materialise(several.select("token", "v", "n", "pos", leader.alias("lead")), "lists")

    del several, postings, ends
    release(spark)
    star = lists.select(F.col("lead").alias("a"), F.struct("v", "n", "pos").alias("b")).where(F.col("a.v") != F.col("b.v")).where(_may_link(percent))
    digests = materialise(sets.where(F.size("digest") > 0).select("v", "n", "digest").join(lists.select("v").distinct(), "v", "left_semi").dropDuplicates(["v"]), "digests")
    star = materialise(_may_be_near(star.select(F.col("a.v").alias("a"), F.col("b.v").alias("b")).distinct(), digests, percent), "star")
    asked = star.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    known = materialise(_needed(texts, asked, levels, k, seed), "sets")
    release(spark)
    answers = materialise(_verify(star, known), "answers")
    drop_materialised(known)
    release(spark)
    edges = answers.where(_links(percent)).select("a", "b")
    component = connected_components(edges)

    # steps 5 and 6: blocks of a list that can link and are not one component
    placed = lists.join(component.withColumnRenamed("node", "v"), "v", "left").withColumn("c", F.coalesce("component", "v"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("token")
    open_ = materialise(placed.join(mixed, "token", "left_semi").select("token", "n", "pos", "v", "c"), "open")
    blocks = open_.groupBy("token", "n", "pos").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    block_pairs = (
        blocks.alias("a").join(blocks.alias("b"), "token")
        .where("a.n < b.n or a.n = b.n and a.pos <= b.pos").where(_may_link(percent))
        .where("not (a.c0 = a.c1 and b.c0 = b.c1 and a.c0 = b.c0)")
        .select("token", F.col("a.n").alias("n"), F.col("a.pos").alias("pos"), F.col("b.n").alias("n2"), F.col("b.pos").alias("pos2"))
    )
    second = open_.select("token", F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("v").alias("v2"), F.col("c").alias("c2"))
    rest = (
        block_pairs.join(open_, ["token", "n", "pos"]).join(second, ["token", "n2", "pos2"]).where("c <> c2")
        .select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).distinct()
    )
    judged = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = _may_be_near(rest.join(judged, ["a", "b"], "left_anti"), digests, percent)
    # the nearest leader of each set: its distance as (differing, of all)
    apart = F.struct(
        ((F.col("na") + F.col("nb") - 2 * F.col("common")) / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"), F.col("a").alias("leader")
    )
    nearest = answers.groupBy(F.col("b").alias("v")).agg(F.min(apart).alias("near"))
    limit, slack = (100 - percent) / 100, 1e-9
    near_a, near_b = (nearest.select(F.col("v").alias(x), F.col("near").alias(f"near_{x}")) for x in "ab")
    rest = rest.join(near_a, "a", "left").join(near_b, "b", "left")
    same = F.coalesce(F.col("near_a.leader") == F.col("near_b.leader"), F.lit(False))
    cannot = same & (F.abs(F.col("near_a.d") - F.col("near_b.d")) > limit + slack)
    must = same & (F.col("near_a.d") + F.col("near_b.d") < limit - slack)
    rest = materialise(rest.where(~cannot).select("a", "b", must.alias("must")), "rest")
    drop_materialised(open_)
    drop_materialised(lists)
    release(spark)
    if not rest.isEmpty():
        unsure = rest.where("not must")
        asked = unsure.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        known = materialise(_needed(texts, asked, levels, k, seed), "sets")
        release(spark)
        more = _verify(unsure, known).where(_links(percent)).select("a", "b").unionByName(rest.where("must").select("a", "b"))
        edges = materialise(edges.unionByName(more), "links")
        drop_materialised(known)
        component = connected_components(edges)

    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n_links"))
    placed = (
        rows.select("id", "n", "v").join(component.withColumnRenamed("node", "v"), "v", "left").join(degree, "v", "left")
        .withColumn("c", F.when(F.col("n") > 0, F.coalesce("component", "v")))
    )
    smallest = placed.where("c is not null").groupBy("c").agg(F.min("id").alias("smallest"))
    return placed.join(smallest, "c", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("smallest", "id").alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component: the one with the smallest id, with all its columns.

    Documents without words are linked with nothing and stay.  Rows are told apart by
    id and text: of rows that share both one stays, and of rows that share only the id
    each is judged by its text.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = jaccard_components(rows, "key", "text", **options)
    kept = found.where(F.col("component_id").eqNullSafe(F.col("key"))).select("key").distinct()
    return rows.select("row", "key").dropDuplicates(["key"]).join(kept, "key", "left_semi").select("row.*")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op7 over the whole ``documents``."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")


DIGEST_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN low ON d.doc_id = low.x
"""
