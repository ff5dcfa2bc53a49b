"""Event-time windows and keyed state: late rows, restarts, and the batch result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldloom.streaming.runs import broken_runs
from fieldloom.streaming.windows import append_all, event_windows

T0 = datetime(2024, 3, 1)
SCHEMA = "id bigint, user string, at timestamp, value double"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_late_rows_are_dropped_and_closed_windows_handed_on(spark, tmp_path):
    figures = [F.count("*").alias("n")]
    source, rows, state = tmp_path / "in", str(tmp_path / "rows"), str(tmp_path / "state")
    write(spark, [(1, "a", at(1), 1.0), (2, "a", at(9), 1.0), (3, None, at(2), 1.0), (4, "a", None, 1.0)], source, "1")
    windows = lambda: event_windows(stream(spark, source), "at", figures, "10 minutes", size="10 minutes", keys=["user"])
    append_all(windows(), rows, state, 120)
    assert spark.read.schema(windows().schema).parquet(rows).count() == 0  # the watermark is at -1 minutes
    write(spark, [(5, "a", at(45), 1.0), (6, "a", at(5), 1.0)], source, "2")  # 5 is within ten minutes of 9: it counts
    append_all(windows(), rows, state, 120)
    write(spark, [(7, "a", at(3), 1.0), (8, "a", at(36), 1.0)], source, "3")  # the watermark is at 35: 3 is late, 36 is not
    query = append_all(windows(), rows, state, 120)
    assert sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators) == 1
    write(spark, [(9, "a", at(100), 1.0)], source, "4")
    append_all(windows(), rows, state, 120)
    got = sorted((r["user"] or "", r["window_start"], r["n"]) for r in spark.read.parquet(rows).collect())
    assert got == [("", at(0), 1), ("a", at(0), 3), ("a", at(30), 1), ("a", at(40), 1)]


def test_kinds_of_windows_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), at(i + rng.randint(0, 5)), float(i)) for i in range(300)]
    for part in range(3):
        write(spark, rows[part * 100 : part * 100 + 100], tmp_path / "in", str(part))
    batch = spark.createDataFrame(rows, SCHEMA)
    closed = max(r[2] for r in rows) - timedelta(minutes=20)
    for name, window in (("tumbling", {"size": "15 minutes"}), ("sliding", {"size": "30 minutes", "slide": "10 minutes"}), ("session", {"gap": "4 minutes"})):
        make = lambda df: event_windows(df, "at", [F.count("*").alias("n"), F.max("value").alias("top")], "20 minutes", keys=["user"], **window)  # noqa: E731, B023
        append_all(make(stream(spark, tmp_path / "in")), str(tmp_path / name), str(tmp_path / f"{name}-state"), 120)
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))
        assert got == sorted(map(tuple, make(batch).where(F.col("window_end") <= F.lit(closed)).collect())) and got
    for wrong in ({}, {"size": "1 hour", "gap": "1 hour"}, {"gap": "1 hour", "slide": "1 hour"}):
        with pytest.raises(ValueError):
            event_windows(batch, "at", [F.count("*")], "1 hour", **wrong)


def expected(rows, expiry, passed):
    """Runs by a loop over each user's rows that the watermark has passed."""
    out, users = [], {r[1] for r in rows}
    for user in users:
        mine = sorted((r[2], r[0], r[3] > 5) for r in rows if r[1] == user and r[2] is not None and r[2] < passed)
        run = None
        for t, _, bad in mine:
            if run and (not bad or t - run[1] > expiry):
                out.append((user, *run))
                run = None
            if bad:
                run = (run[0] if run else t, t, run[2] + 1 if run else 1)
        if run and run[1] + expiry < passed:
            out.append((user, *run))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cuts", [1, 4])
def test_runs_with_timers_and_a_restart_for_each_file(spark, tmp_path, cuts):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "b", None]), at(i), rng.choice([1.0, 9.0, 9.0])) for i in range(200)]
    rows += [(500 + i, "a", at(60 + i // 2), 9.0) for i in range(6)]  # ties, in the order of ids
    rows.sort(key=lambda r: r[2])
    rows += [(300, "gone", at(100), 9.0), (301, "late", None, 9.0)]
    rng.shuffle(early := rows[:60])
    parts = [early + rows[60:]] if cuts == 1 else [early, rows[60:120], rows[120:180], rows[180:]]
    if cuts > 1:
        parts[1], parts[3] = parts[1] + parts[3][-2:], parts[3][:-2]
    source, out, state = tmp_path / "in", str(tmp_path / "rows"), str(tmp_path / "state")
    for i, part in enumerate(parts):
        write(spark, part, source, str(i))
        found = broken_runs(stream(spark, source), "user", "at", "id", F.col("value") > 5, 600, "30 minutes")
        append_all(found, out, state, 180)  # each time a new query on the old checkpoint
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)
    passed = max(r[2] for r in rows if r[2]) - timedelta(minutes=30)
    assert got == expected(rows, timedelta(seconds=600), passed) and ("gone", at(100), at(100), 1) in got
