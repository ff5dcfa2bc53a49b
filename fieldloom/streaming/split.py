"""A stream's valid and invalid rows, written apart. The rules are stateless: no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import VIOLATIONS, free, with_violations


def start_split(stream: DataFrame, form, path: str, checkpoint: str, once: bool = False, violations: str = VIOLATIONS, valid: str = "valid") -> StreamingQuery:
    """Starts a query that appends to path/valid=true and path/valid=false; `once` takes what is there and ends.

    violations, valid: the names of the two added columns; a column of the stream of such a name raises.
    """
    free(stream, valid)
    marked = with_violations(stream, form, column=violations).withColumn(valid, F.size(violations) == 0)
    writer = marked.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(valid).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
