"""Tables in a folder, and a sink that keeps valid and invalid rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.validate import VIOLATIONS, free, with_violations


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """folder/name.parquet, a file or a folder of them; only `columns`, if given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_split(df: DataFrame, form, path: str, mode: str = "errorifexists", violations: str = VIOLATIONS, valid: str = "valid") -> None:
    """One pass and one write: path/valid=true and path/valid=false; violations go along.

    violations, valid: the names of the two added columns; a column of df of such a name raises.
    """
    free(df, valid)
    with_violations(df, form, column=violations).withColumn(valid, F.size(violations) == 0).write.mode(mode).partitionBy(valid).parquet(path)
