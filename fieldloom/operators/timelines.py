"""Joins along a time line: as-of (the last row at or before a time) and points in intervals.

Neither compares all pairs: the as-of join carries the last value along one sorted line, the interval join
meets in buckets. Times may be timestamps (with or without zone), dates or numbers, of one type on both sides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from .validate import free

#: Rows of a key that one task may carry a value along; larger keys are cut by time.
PIECE_ROWS = 4_000_000
#: Keys or pieces that are cut at a time, at most; each holds over 1/HOT of all rows.
HOT = 1024
#: Time ranges that a piece is cut into.
SLOTS = 64
#: Widths of buckets of neighbouring levels.
FACTOR = 16


def position(column: Column, kind: T.DataType) -> Column:
    """A time as a double that rises with it: microseconds, days or the number itself."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    raise TypeError(f"{kind.simpleString()} is no time")


def _cut(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, bool]:
    """rows (keys, t, ...) with `piece`, and whether any key was cut.

    Pieces of a key follow each other in time; none has over `limit` rows, or 1/HOT of all if that is
    more, unless they are of one time. Keys and pieces above the limit, fewer than HOT, are found by
    counting and broadcast; what is still too large is cut again within its own range.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("piece", F.array().cast("array<bigint>"))
    probe = rows.select(*keys, "t", "piece")
    limit = max(limit, probe.count() // HOT)
    cut = False
    while True:
        groups = probe.groupBy(*keys, "piece").agg(F.count("*").alias("rows"), F.min("t").alias("low"), F.max("t").alias("high"))
        large = groups.where((F.col("rows") > limit) & (F.col("low") < F.col("high"))).drop("rows")
        found = large.collect()  # fewer than HOT
        if not found:
            return rows, cut
        cut = True
        hot = F.broadcast(spark.createDataFrame(found, large.schema))
        slot = F.floor((F.col("t") - F.col("low")) * SLOTS / (F.col("high") - F.col("low"))).cast("bigint")

        def with_slots(df: DataFrame, how: str) -> DataFrame:
            out = df.join(hot, [*keys, "piece"], how)
            return out.withColumn("piece", F.when(F.col("low").isNull(), F.col("piece")).otherwise(F.concat("piece", F.array(slot)))).drop("low", "high")

        rows = with_slots(rows, "left")
        probe = with_slots(probe, "inner").select(*keys, "t", "piece")


def asof_join(left: DataFrame, right: DataFrame, on: tuple[str, str], take: Mapping[str, str], by: Sequence[tuple[str, str]] = (), ties: Sequence[str] = (), strict: bool = False, within: float | None = None, limit: int = PIECE_ROWS) -> DataFrame:
    """Each row of left with columns of the last row of right at or before its time, of equal keys.

    on: the time columns of left and right; by: pairs of key columns; take: new name -> column of right.
    strict: before, not at. ties: columns of right that order rows of one time, the largest is last
    (without them any one is taken). within: the match is at most so far back (microseconds, days or units).

    Every row of left stays, once; without a match the new columns are NULL, as they are for a NULL key or
    time. Right rows of NULL key or time match nothing. A new name that left has raises. Empty tables are fine.

    Both sides go through one shuffle by key and are sorted once; the last right row is carried along. A key of
    over `limit` rows is cut by time into pieces, and each piece starts with the last right row of those before
    it, so no key, nor the whole line where there is none, is one task's.
    """
    free(left, *take)
    kind = left.schema[on[0]].dataType
    if right.schema[on[1]].dataType != kind:
        raise TypeError("times must be of one type")
    keys = [f"k{i}" for i in range(len(by) or 1)]
    pairs = [(F.col(a), F.col(b)) for a, b in by] or [(F.lit(0), F.lit(0))]
    got = F.struct(F.col(on[1]).alias("time"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(take.values())))
    tie = F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(ties)))
    mine = left.select(*(a.alias(k) for k, (a, _) in zip(keys, pairs)), F.col(on[0]).alias("at"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row"))
    theirs = right.select(*(b.alias(k) for k, (_, b) in zip(keys, pairs)), F.col(on[1]).alias("at"), got.alias("got"), tie.alias("tie"))
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in [*keys, "at"]))
    types = {f.name: f.dataType for f in theirs.schema}
    empty = [F.lit(None).cast(types["got"].fields[i + 1].dataType).alias(name) for i, name in enumerate(take)]

    theirs = theirs.where(known).withColumn("row", F.lit(None).cast(mine.schema["row"].dataType))
    placed = mine.where(known).withColumns({"got": F.lit(None).cast(types["got"]), "tie": F.lit(None).cast(types["tie"])})
    line = placed.unionByName(theirs).withColumn("t", position(F.col("at"), kind))
    line, cut = _cut(line, keys, limit)
    if cut:
        line = line.unionByName(_heads(line, keys))
    # at one time: left rows first where only earlier ones count
    later = F.when(F.col("got").isNull(), F.lit(1)).otherwise(F.lit(2 if strict else 0))
    order = W.partitionBy(*keys, "piece").orderBy("at", later, "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = line.withColumn("last", F.last("got", ignorenulls=True).over(order)).where("row is not null")
    if within is not None:
        near = F.col("t") - position(F.col("last.time"), kind) <= within
        found = found.withColumn("last", F.when(near, F.col("last")))
    matched = found.select("row.*", *(F.col(f"last.v{i}").alias(name) for i, name in enumerate(take)))
    return matched.unionByName(mine.where(~known).select("row.*", *empty))


def _heads(line: DataFrame, keys: list[str]) -> DataFrame:
    """For each piece of a cut key the last right row of the pieces before it, as a row of that piece."""
    last = F.max_by(F.struct("at", "got", "tie"), F.when(F.col("got").isNotNull(), F.struct("at", "tie")))
    pieces = line.where(F.size("piece") > 0).groupBy(*keys, "piece").agg(last.alias("last"))
    before = W.partitionBy(*keys).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    heads = pieces.withColumn("head", F.last("last", ignorenulls=True).over(before)).where("head is not null")
    return heads.select(*keys, "piece", "head.*", F.lit(None).cast(line.schema["row"].dataType).alias("row"), F.lit(None).cast("double").alias("t"))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, bounds: tuple[str, str], by: Sequence[tuple[str, str]] = (), width: float | None = None) -> DataFrame:
    """All pairs of a point and an interval that holds it, [start, end), of equal keys: columns of both sides.

    by: pairs of key columns (points', intervals'). NULL keys, times or bounds and intervals that don't end
    after their start match nothing; repeated rows pair each. Columns of one name on both sides raise.

    An interval lies in at most two buckets of its own level, whose width is the first of
    width * FACTOR ** level that is not below its length: one that is a thousand times longer than the rest
    makes no more rows than they do. A point looks once into each level that occurs. width: of level 0, by
    default the intervals' median length. The join is an equi-join on key, level and bucket with a test of
    what is left; where many intervals hold many points, adaptive execution splits what is skewed.
    """
    free(points, *intervals.columns)
    kinds = points.schema[at].dataType, *(intervals.schema[b].dataType for b in bounds)
    if len(set(kinds)) > 1:
        raise TypeError("times must be of one type")
    t, start, end = (position(F.col(c), kinds[0]) for c in (at, *bounds))
    spans = intervals.where(F.col(bounds[0]) < F.col(bounds[1])).withColumns({"__start": start, "__end": end})
    length = F.col("__end") - F.col("__start")
    if width is None:
        width = spans.agg(F.percentile_approx(length, 0.5)).first()[0] or 1.0
    level = F.greatest(F.lit(0), F.ceil(F.log(length / width) / F.log(F.lit(float(FACTOR))) - 1e-9)).cast("int")
    # a level's width may fall short by what the logarithm rounds off: then the next
    level = F.when(length > F.lit(width) * F.pow(F.lit(float(FACTOR)), level), level + 1).otherwise(level)
    spans = spans.withColumn("__level", level)
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())  # logarithm of the longest by the shortest: some dozens at most

    def bucket(x: Column, lev: Column) -> Column:
        return F.floor(x / (F.lit(width) * F.pow(F.lit(float(FACTOR)), lev))).cast("bigint")

    lev = F.col("__level")
    spans = spans.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col("__start"), lev), bucket(F.col("__end"), lev)))))
    looks = F.array(*(F.struct(F.lit(x).alias("level"), bucket(F.col("__t"), F.lit(x)).alias("bucket")) for x in levels)).cast("array<struct<level:int,bucket:bigint>>")
    seen = points.withColumn("__t", t).withColumn("__look", F.explode(looks))
    same = [F.col(f"p.{a}") == F.col(f"i.{b}") for a, b in by]
    p, i = seen.alias("p"), spans.alias("i")
    on = [F.col("p.__look.level") == F.col("i.__level"), F.col("p.__look.bucket") == F.col("i.__bucket"), *same, F.col(f"p.{at}") >= F.col(f"i.{bounds[0]}"), F.col(f"p.{at}") < F.col(f"i.{bounds[1]}")]
    return p.join(i, reduce(Column.__and__, on)).select(*(F.col(f"p.`{c}`") for c in points.columns), *(F.col(f"i.`{c}`") for c in intervals.columns))
