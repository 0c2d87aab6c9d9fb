"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a share of the training words by its weight, at most twice its size. Its documents are taken in
order of a hash: whole passes, then the first ones up to what is missing. Each source has a schedule of weights
over training time; its integral is the source's cumulative demand. A document that stands at the share u of its
source's taken words is placed where the demand reaches u, and documents are range-sorted by that position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.common import WORD, fresh, read, row_key, stored, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5  # of all words
MOST = 2.0  # of a source's or document's size
#: (time, weight) knots from 0 to 1, linear between them, in turn for the sources: early, even, late.
SCHEDULES = (((0.0, 3.0), (0.5, 2.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with nr, weight and target; a row for each source.

    Sources are numbered by code point, null last, and the weights repeat. Where a share exceeds most times its
    source's size, the excess goes to the others by weight until none is above: every target is the lesser of
    its limit and one common level times its weight. The level follows from running sums over the sources in
    order of limit over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nr = F.row_number().over(by_name) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.select("source", "source_size", nr.alias("nr")).withColumn("weight", F.get(listed, F.col("nr") % len(weights)))
    limit = F.col("source_size") * F.lit(float(most))
    every = Window.partitionBy()
    by_level = Window.orderBy(limit / F.col("weight"), "nr")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if this source and those after it stay below their limits; the true one is the first that its own source's limit admits.
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - filled) / left
    rows = rows.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") <= limit)
    true = F.min_by("level", F.struct(limit / F.col("weight"), "nr")).over(Window.partitionBy("below"))
    first = F.max(F.when(F.col("below"), true)).over(every)
    target = F.least(limit, F.coalesce(first * F.col("weight"), limit))
    return rows.select("source", "source_size", "nr", "weight", target.alias("target"))


def schedule_time(u: Column, nr: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which the integral of source nr's schedule reaches the share u of its whole: the inverse, piece by piece."""
    out = None
    for k, knots in enumerate(schedules):
        areas = [(t2 - t1) * (w1 + w2) / 2 for (t1, w1), (t2, w2) in zip(knots, knots[1:], strict=False)]
        total, done, time = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for ((t1, w1), (t2, w2)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
            need = F.greatest(u * total - done, F.lit(0.0))
            slope = (w2 - w1) / (t2 - t1)
            inner = need / w1 if abs(slope) < 1e-12 else (F.sqrt(F.greatest(F.lit(w1 * w1) + 2 * slope * need, F.lit(0.0))) - w1) / slope
            pieces.append(((done + area) / total, F.lit(t1) + inner))
            done += area
        for end, at in reversed(pieces):
            time = F.when(u <= end, at).otherwise(time)
        chosen = F.when(nr % len(schedules) == k, time)
        out = chosen if out is None else F.coalesce(out, chosen)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, schedules: tuple = SCHEDULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, copies, position, positions.

    size is the number of words (null text: 0), taken = size times copies, positions the places of the copies in
    training time, 0 to 1, position the first (null if none). Sources without words take nothing. Repeated rows,
    and documents that share a doc_id, each have copies of their own. Columns of docs to keep come last, all others
    are left out, whatever their names; those to keep must not be named as the added ones. The same input always
    gives the same mix. An empty table gives an empty result.
    """
    order, second, nr = fresh(docs, "h", "h2", "nr_of_row")
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    rows = stored(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id").alias(order), F.xxhash64(text_of()).alias(second), row_key().alias(nr), *keep))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    source = stored(targets(sums.select("source", "source_size"), weights, share, most))
    # A source's order is cut into slices by the top bits of the hash: about the square root of the rows, each of as many.
    n = rows.count()
    bits = max(1, math.ceil(math.log2(max(n, 1)) / 2))
    # Ids of more rows than that, as the null one may be, are ordered by the text and the row too; they are fewer than that.
    often = rows.groupBy(order).count().where(F.col("count") > (1 << bits)).select(order, F.lit(True).alias("often"))
    rows = rows.join(F.broadcast(often), order, "left").withColumn(order, F.when(F.col("often"), F.xxhash64(order, second, nr)).otherwise(F.col(order))).drop("often")
    rows = rows.withColumn("slice", F.shiftright(order, 64 - bits))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")).withColumn("base", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).drop("slice_size")
    known = slices.join(source, slices.source.eqNullSafe(source.source)).drop(source.source)
    inner = Window.partitionBy("source", "slice").orderBy(order, "doc_id", second, "size", nr).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    at = rows.alias("r").join(known.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.slice") == F.col("k.slice")))
    start = F.col("k.base") + F.col("r.inner")
    at = at.select(*[f"r.{c}" for c in keep], "r.doc_id", "r.size", "k.source_size", "k.target", "k.nr", start.alias("start"))
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - passes * F.col("source_size")
    extra = (F.col("start") + F.col("size") / 2 < rest).cast("long")
    at = at.withColumn("copies", F.when(F.col("source_size") > 0, F.least(passes + extra, F.lit(int(most)))).otherwise(F.lit(0)).cast("long"))
    share_of = lambda k: F.least(F.lit(1.0), (F.col("start") + k * F.col("source_size") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)))
    places = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>")), lambda k: schedule_time(share_of(k), F.col("nr"), schedules))
    at = at.withColumn("positions", places)
    return at.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies", F.get("positions", F.lit(0)).alias("position"), "positions", *keep)


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: a row for each copy, in order of training position, with docs' own columns.

    Each row of docs has its own copies, by a key stored with it: ids may be null or repeated. A null text is empty
    and an empty table gives an empty result.
    """
    mine, place = fresh(docs, "row_nr", "place")
    held = stored(docs.withColumn(mine, row_key()))
    plan = mixed(held, **how, keep=(mine,)).where("copies > 0").select(mine, F.explode("positions").alias(place))
    out = held.join(plan, mine)
    return out.repartitionByRange(place, "doc_id").sortWithinPartitions(place, "doc_id").select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("positions")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
