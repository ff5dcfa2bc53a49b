"""Event-time windows over streams: tumbling, sliding, session. The same call works on batch DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def event_windows(df: DataFrame, time: str, figures: Sequence[Column], late: str, size: str | None = None, slide: str | None = None, gap: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, window_start, window_end, figures) for each key and window.

    size: tumbling windows, with slide sliding ones; gap: sessions, which end `gap` after their last row.
    late: how far rows may come behind the latest time seen. A stream drops rows whose windows are closed
    by then and, in append mode, hands a window on, and forgets its state, once its end is not after the
    watermark. Rows without a time are in no window, rows of null key in windows of their own; repeated
    rows count each. Partial sums of a hot key are made before the shuffle, except in sessions.
    """
    if (size is None) == (gap is None) or (slide and gap):
        raise ValueError("either size, perhaps with slide, or gap")
    window = F.session_window(time, gap) if gap else F.window(time, size, slide)
    grouped = df.withWatermark(time, late).groupBy(*keys, window.alias("__window")).agg(*figures)
    names = [c for c in grouped.columns if c not in keys and c != "__window"]
    return grouped.select(*keys, F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *names)


def append_all(result: DataFrame, path: str, checkpoint: str, timeout: float | None = None) -> StreamingQuery:
    """Takes all there is now in micro-batches, then lets what the last watermark closes out; to Parquet in `path`.

    Started again on the same checkpoint it goes on where it ended, each row written once.
    """
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    return query
