"""Tables as multisets: what two runs share, gained and lost, repeated rows counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .validate import free


def row_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(columns..., kept, lost, gained) for each different row of either table, how often it is in both, in `before`
    only and in `after` only.

    kept is INTERSECT ALL, lost is before EXCEPT ALL after, gained the other way round, all by one aggregation with
    partial sums: copies are counted before the shuffle, so that a row that a third of a table repeats is no hot key.
    NULLs are equal to each other. Columns are met by name; the tables must have the same ones, none of them
    named as a count. Two empty tables give no rows.
    """
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError("tables have different columns")
    free(before, "kept", "lost", "gained")
    both = before.withColumns({"__fl_b": F.lit(1), "__fl_a": F.lit(0)}).unionByName(after.withColumns({"__fl_b": F.lit(0), "__fl_a": F.lit(1)}))
    names = [F.col(f"`{c}`") for c in before.columns]
    counts = both.groupBy(*names).agg(F.sum("__fl_b").alias("__fl_b"), F.sum("__fl_a").alias("__fl_a"))
    b, a = F.col("__fl_b"), F.col("__fl_a")
    return counts.select(*names, F.least(b, a).alias("kept"), F.greatest(b - a, F.lit(0)).alias("lost"), F.greatest(a - b, F.lit(0)).alias("gained"))


def repeated(counts: DataFrame, column: str) -> DataFrame:
    """Each row of row_changes as often as `column` says, without the counts: the rows of that set operation."""
    return counts.where(F.col(column) > 0).withColumn("__fl_copy", F.explode(F.sequence(F.lit(1), F.col(column)))).drop("__fl_copy", "kept", "lost", "gained")
