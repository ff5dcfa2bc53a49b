"""Aggregates that are kept as mergeable sketches: distinct counts (HLL) and quantiles (KLL).

A table of sketches holds one row for each part (a day, say) and group. What is asked of any set of parts,
groups or both is a merge of those rows; the rows of the source are read once, when their part is sketched.
Merging is associative and commutative, so sketches of sketches are as good as those of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Binary logarithm of an HLL sketch's registers; a KLL sketch's size.
LG, K = 12, 400


def distinct_error(lg: int = LG) -> float:
    """Three standard errors of a distinct count, relative to it."""
    return 3 * 1.04 / 2 ** (lg / 2)


def sketched(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str] = {}, quantiles: Mapping[str, str] = {}, lg: int = LG, k: int = K) -> DataFrame:
    """keys, n and a sketch for each name of `distinct` and `quantiles`, which say the column it is of.

    Partial sketches are made before the shuffle: what is shuffled is a sketch for each task and group,
    so that a hot group is no hot task. Nulls are in no sketch, but count in n; null keys are a group. Repeated
    rows count each in n and quantiles. Without keys there is one row, also of an empty table. Columns of
    distinct: integers, strings, binaries; of quantiles: numbers. A name given twice raises.
    """
    names = [*keys, "n", *distinct, *quantiles]
    if len({x.lower() for x in names}) < len(names):
        raise ValueError(f"names must differ: {', '.join(names)}")
    hll = [F.hll_sketch_agg(F.col(c), lg).alias(name) for name, c in distinct.items()]
    kll = [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(name) for name, c in quantiles.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *hll, *kll)


def merged(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """sketches' rows merged by keys: the same columns, whatever parts and groups the rows were of.

    Null sketches are left out, null keys are a group. A row that is there twice adds to n and quantiles
    twice, not to distinct counts: parts must not overlap. Other columns are dropped.
    """
    return sketches.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.hll_union_agg(name).alias(name) for name in distinct), *(F.kll_merge_agg_double(name).alias(name) for name in quantiles)
    )


def estimates(sketches: DataFrame, distinct: Sequence[str] = (), quantiles: Mapping[str, Mapping[str, float]] = {}) -> DataFrame:
    """sketches with distinct counts in place of the sketches, and for each quantile sketch the values at the
    ranks asked for, by name: {"value": {"median": 0.5}}. Null where a quantile sketch holds no value."""
    out = sketches.select("*", *(F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(rank))).alias(name) for s, asked in quantiles.items() for name, rank in asked.items()))
    for name in distinct:
        out = out.withColumn(name, F.hll_sketch_estimate(name))
    return out.drop(*quantiles)


def store(sketches: DataFrame, path: str, part: str) -> DataFrame:
    """Writes sketches to the table at path, one folder for each value of `part`, and returns that table.

    Parts that sketches has take the place of the same parts there, others stay: a part that is sketched
    again counts once. An empty DataFrame leaves the table as it is. All rows of a part must come together.
    """
    spark: SparkSession = sketches.sparkSession
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return spark.read.schema(sketches.schema).parquet(path)
