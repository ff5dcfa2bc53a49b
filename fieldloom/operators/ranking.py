"""The first rows of each group, with all that tie with the last of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .validate import free

#: Parts that a group's rows are dealt to.
PARTS = 16


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", parts: int = PARTS) -> DataFrame:
    """The rows of each group whose rank by `order` is at most k, with that rank; ties at any place all stay.

    order: sort expressions, such as F.desc("value"); what they say of NULLs holds. Rows rank 1 + those that come before
    them, so ties share a rank and the next is higher by their number. NULL keys are a group, repeated rows rank each. A
    column of df named as the rank raises. k below 1 and an empty table give no rows.

    A group is dealt to `parts` parts by its rows' hash, and only ranks up to k in a part are kept: Spark limits groups
    in each task before the shuffle, so that of a hot group k rows and ties a task go on. The order's values that are left, at most
    k * parts different ones a group, are counted and give the ranks, which go back to the parts. So a group of which a
    third of the table ties is still many tasks' work. The table is read twice, for the counts and for the rows.
    """
    free(df, rank, "__fl_part", "__fl_order", "__fl_local", "__fl_ranks")
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(parts)).cast("int")
    keys = [F.col(f"`{c}`") for c in by]
    local = F.rank().over(W.partitionBy(*keys, "__fl_part").orderBy(*order))
    kept = df.withColumn("__fl_part", part).withColumn("__fl_local", local).where(F.col("__fl_local") <= k)
    # in a part, rows of one local rank tie: of equal order, whatever the expressions are
    names = [f"k{i}" for i in range(len(by))]
    values = kept.groupBy(*(c.alias(n) for c, n in zip(keys, names)), "__fl_part", "__fl_local").agg(F.count("*").alias("rows"), F.first(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("row"))
    values = values.select(*names, "__fl_part", "__fl_local", "rows", "row.*")
    along = W.partitionBy(*names).orderBy(*order)
    before = F.coalesce(F.sum("rows").over(along.rangeBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    ties = F.sum("rows").over(W.partitionBy(*names, "__fl_tie"))
    ranked = values.withColumn("__fl_tie", F.dense_rank().over(along)).withColumn(rank, before - ties + 1).where(F.col(rank) <= k)
    ranked = ranked.select(*names, F.col("__fl_part").alias("p"), F.col("__fl_local").alias("l"), rank)
    same = [c.eqNullSafe(F.col(n)) for c, n in zip(keys, names)]
    on = reduce(Column.__and__, same, (F.col("__fl_part") == F.col("p")) & (F.col("__fl_local") == F.col("l")))
    return kept.join(ranked, on).select(*(F.col(f"`{c}`") for c in df.columns), rank)
