"""Keyed state with timers: runs of consecutive rows that break a rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "times array<bigint>, ids array<bigint>, flags array<boolean>, first bigint, last bigint, rows bigint"


def broken_runs(stream: DataFrame, key: str, time: str, row_id: str, broken: Column, expiry: int, late: str) -> DataFrame:
    """(key, run_start, run_end, n): each run of rows of one key, in order of (time, row_id), that break a rule.

    A run ends with the first row that keeps the rule, or when the next one that breaks it is over `expiry`
    seconds after the last, or when that long has passed without any: a timer on the watermark.

    Rows wait in the key's state until the watermark, in milliseconds, has passed them, and are taken in
    order then: the result is the same however the stream is cut into batches, but for rows that come after
    their time has passed (`late`), which are dropped. State: 17 bytes for each waiting row of the key and
    one open run; a key with neither is forgotten. Rows of null time are left out; null keys are a key;
    repeated rows count each. A NULL `broken` keeps the rule.
    """
    spark = stream.sparkSession
    kind = stream.schema[key].dataType.simpleString()
    wait = int(expiry) * 1_000_000
    tz = spark.conf.get("spark.sql.session.timeZone")

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, flags, first, last, n = state.get if state.exists else ([], [], [], None, None, 0)
        rows = list(zip(times or [], ids or [], flags or []))
        if not state.hasTimedOut:
            for part in parts:
                rows += zip(part["us"].tolist(), part["id"].tolist(), part["broken"].tolist())
        rows.sort()
        passed = state.getCurrentWatermarkMs()
        out, at = [], 0
        while at < len(rows) and rows[at][0] // 1000 < passed:
            t, _, bad = rows[at]
            if n and (not bad or t - last > wait):
                out.append((first, last, n))
                n = 0
            if bad:
                first, last, n = (t if not n else first), t, n + 1
            at += 1
        rows = rows[at:]
        if n and (last + wait) // 1000 < passed and (not rows or rows[0][0] - last > wait):
            out.append((first, last, n))
            n = 0
        if rows or n:
            state.update(([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], first if n else None, last if n else None, n))
            due = [rows[0][0]] if rows else []
            if n:
                due.append(last + wait)
            state.setTimeoutTimestamp(max(min(due) // 1000, passed + 1))
        elif state.exists:
            state.remove()
        if out:
            starts, ends = (pd.to_datetime([r[i] for r in out], unit="us", utc=True).tz_convert(tz).tz_localize(None) for i in (0, 1))
            yield pd.DataFrame({"key": [k[0]] * len(out), "run_start": starts, "run_end": ends, "n": [r[2] for r in out]})

    narrow = stream.where(F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("us"), F.col(row_id).cast("bigint").alias("id"), F.coalesce(broken, F.lit(False)).alias("broken"))
    found = narrow.withWatermark("time", late).groupBy("key").applyInPandasWithState(step, f"key {kind}, run_start timestamp, run_end timestamp, n bigint", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("key", key)
