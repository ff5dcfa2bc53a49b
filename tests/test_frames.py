"""Frames, islands, top rows and multisets against plain Python, with hot keys cut small; JSON of odd texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldloom.operators.frames import frame_figures, islands
from fieldloom.operators.json_fields import json_fields
from fieldloom.operators.multisets import repeated, row_changes
from fieldloom.operators.ranking import top_rows

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    """A hot key with dense and empty stretches, ties and repeated rows; rows with no place on a line."""
    rng = random.Random(3)
    times = [rng.choice([rng.randrange(400), rng.randrange(5000)]) for _ in range(700)]
    out = [("hot" if i % 3 else f"k{i % 7}", float(t), rng.randrange(50)) for i, t in enumerate(times)]
    return out + out[:40] + [(None, 5.0, 1), ("hot", None, 2), ("hot", NAN, 3), ("k1", INF, 4), ("k1", -INF, 5), ("far", -7.0, None), ("far", -4.0, 6)]


@pytest.fixture(scope="module")
def line(spark, rows):
    return spark.createDataFrame(rows, "key string, at double, v int").repartition(4).cache()


def placed(r):
    return r[0] is not None and r[1] is not None and abs(r[1]) < INF


@pytest.mark.parametrize("limit", [20, 10**6])
@pytest.mark.parametrize("back", [1, 60, 3000])
def test_frames(line, rows, back, limit):
    got = frame_figures(line, "at", back, {"n": F.count("*"), "total": F.sum("v"), "least": F.min("v")}, ["key"], limit=limit)
    expected = []
    for r in rows:
        seen = [x[2] for x in rows if placed(r) and placed(x) and x[0] == r[0] and r[1] - back <= x[1] <= r[1]]
        known = [v for v in seen if v is not None]
        expected.append((*r, len(seen) if seen else None, sum(known) if known else None, min(known) if known else None))
    assert Counter(map(repr, map(tuple, got.collect()))) == Counter(map(repr, expected))


@pytest.mark.parametrize("limit", [20, 10**6])
@pytest.mark.parametrize("gap", [0, 2, 9, 400])
@pytest.mark.parametrize("by", [["key"], []])
def test_islands(line, rows, gap, limit, by):
    got = islands(line, "at", gap, {"total": ("sum", "v"), "top": ("max", "v")}, by, limit=limit)
    lines = {}
    for r in rows:
        if r[1] is not None and abs(r[1]) < INF and (r[0] is not None or not by):
            lines.setdefault(r[0] if by else (), []).append(r)
    expected = []
    for key, found in lines.items():
        found.sort(key=lambda r: r[1])
        runs = [[found[0]]]
        for r in found[1:]:
            if r[1] - runs[-1][-1][1] <= gap:
                runs[-1].append(r)
            else:
                runs.append([r])
        for run in runs:
            v = [r[2] for r in run if r[2] is not None]
            expected.append((*([key] if by else []), run[0][1], run[-1][1], len(run), sum(v) if v else None, max(v) if v else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_frames_of_odd_tables(spark, line):
    none = spark.createDataFrame([], "key string, at timestamp, v int")
    assert frame_figures(none, "at", 5, {"n": F.count("*")}, ["key"]).count() == 0
    assert islands(none, "at", 5, by=["key"]).count() == 0
    for bad in ({"V": F.count("*")}, {"__fl_t": F.count("*")}):
        with pytest.raises(ValueError):
            frame_figures(line, "at", 5, bad, ["key"])
    with pytest.raises(ValueError):
        frame_figures(line, "at", 0, {"n": F.count("*")})
    with pytest.raises(ValueError):
        islands(line.withColumnRenamed("key", "n"), "at", 5, by=["n"])
    with pytest.raises(ValueError):
        islands(line, "at", 5, {"mean": ("avg", "v")})
    dotted = line.withColumnsRenamed({"key": "a.b", "at": "c d"})
    assert frame_figures(dotted, "c d", 5, {"n": F.count("*")}, ["a.b"]).count() == line.count()
    assert islands(dotted, "c d", 5, by=["a.b"]).columns == ["a.b", "start", "end", "n"]


def test_a_hot_key_is_in_many_tasks(spark):
    df = spark.range(20_000).select((F.col("id") % 1000).cast("double").alias("at"), F.lit("one").alias("key"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = frame_figures(df, "at", 10, {"n": F.count("*")}, ["key"], limit=500)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and sum(sizes) == 20_000 and max(sizes) < 15_000


@pytest.mark.parametrize("k", [0, 1, 3, 10, 500])
def test_top_rows(line, rows, k):
    got = top_rows(line, ["key"], [F.desc_nulls_last("v")], k, parts=5)
    value = lambda r: -1 if r[2] is None else r[2]
    expected = [(*r, n) for r in rows if (n := 1 + sum(x[0] == r[0] and value(x) > value(r) for x in rows)) <= k]
    assert Counter(map(repr, map(tuple, got.collect()))) == Counter(map(repr, expected))


def test_top_rows_plan_and_odd_tables(spark, line):
    got = top_rows(line, ["key"], [F.desc("v"), F.col("at")], 3)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert top_rows(line.limit(0), ["key"], [F.desc("v")], 3).count() == 0
    assert top_rows(line, [], [F.desc("v")], 1).select("v").distinct().count() == 1
    with pytest.raises(ValueError):
        top_rows(line, ["key"], [F.desc("v")], 3, rank="V")
    tied = spark.range(3000).select(F.lit("one").alias("key"), F.lit(1).alias("v"), "id")
    assert top_rows(tied, ["key"], [F.desc("v")], 2).where("rank = 1").count() == 3000


def test_multisets(spark):
    rng = random.Random(8)
    make = lambda n: [(rng.choice(["a", "b", None]), rng.choice([1.0, None, NAN])) for _ in range(n)]
    one, two = make(60) + [("only", 1.0)], make(45)
    before, after = spark.createDataFrame(one, "x string, y double"), spark.createDataFrame(two, "x string, y double").select("y", "x")
    b, a = Counter(map(repr, one)), Counter(map(repr, two))
    counts = row_changes(before, after)
    got = {repr((r["x"], r["y"])): (r["kept"], r["lost"], r["gained"]) for r in counts.collect()}
    assert got == {r: (min(b[r], a[r]), max(b[r] - a[r], 0), max(a[r] - b[r], 0)) for r in b | a}
    for column, expected in (("kept", b & a), ("lost", b - a), ("gained", a - b)):
        assert Counter(repr((r["x"], r["y"])) for r in repeated(counts, column).collect()) == expected
    assert Counter(map(repr, map(tuple, before.exceptAll(after.select("x", "y")).collect()))) == b - a
    assert row_changes(before.limit(0), before.limit(0)).count() == 0
    with pytest.raises(ValueError):
        row_changes(before, after.drop("x"))
    with pytest.raises(ValueError):
        row_changes(before.withColumnRenamed("x", "Kept"), after.withColumnRenamed("x", "Kept"))


TEXTS = {
    '{"k": 3, "s": "x"}': (3, "x", None),
    '{"s": "x"}': (None, "x", None),
    '{"k": null, "s": "é"}': (None, "é", None),
    '{"k": "no", "s": "x"}': (None, "x", "mistyped"),
    '{"k": {"j": 1}, "s": "x"}': (None, "x", "mistyped"),
    '{"k": 3, "s": "x"': (None, None, "malformed"),
    "{'k': 3}": (None, None, "malformed"),
    "": (None, None, "malformed"),
    "  ": (None, None, "malformed"),
    '{"k": 3, "k": 4}': (None, None, "malformed"),
    "[1, 2]": (None, None, None),
    "7": (None, None, None),
    None: (None, None, None),
}


def test_json(spark):
    long = '{"k": 1, "s": "' + "y" * 300_000 + '"}'
    df = spark.createDataFrame([(t, i) for i, t in enumerate([*TEXTS, long])] + [("", 99)], "text string, place int")
    got = json_fields(df, "text", {"k": ("$.k", "bigint"), "s": ("$.s", "string")}).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["text"] == long:
            assert (r["k"], len(r["s"]), r["fault"]) == (1, 300_000, None)
        else:
            assert (r["k"], r["s"], r["fault"]) == TEXTS[r["text"]], r["text"]
    assert json_fields(df.limit(0), "text", {}).columns == ["text", "place", "fault"]
    with pytest.raises(ValueError):
        json_fields(df, "text", {"Place": ("$.p", "int")})


@pytest.mark.parametrize("back", [1, 60, 3000])
@pytest.mark.parametrize("by", [["key"], []])
def test_named_figures_of_frames(line, rows, back, by):
    figures = {"n": ("count", None), "some": ("count", "v"), "total": ("sum", "v"), "least": ("min", "v"), "top": ("max", "v"), "kinds": ("distinct", "v")}
    got = frame_figures(line, "at", back, figures, by)
    expected = []
    for r in rows:
        if r[1] is None or not abs(r[1]) < INF or (by and r[0] is None):
            expected.append((*r, *[None] * 6))
            continue
        seen = [x[2] for x in rows if x[1] is not None and abs(x[1]) < INF and (not by or x[0] == r[0]) and r[1] - back <= x[1] <= r[1]]
        v = [x for x in seen if x is not None]
        expected.append((*r, len(seen), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None), len(set(v))))
    assert Counter(map(repr, map(tuple, got.collect()))) == Counter(map(repr, expected))
    assert frame_figures(line.limit(0), "at", back, figures, by).count() == 0


def test_frames_of_many_rows_take_time_in_proportion(spark, line):
    """200,000 rows of one frame: read again for each row they would be 20,000,000,000."""
    df = spark.range(200_000).select(F.lit("one").alias("key"), F.col("id").cast("double").alias("at"), (F.col("id") % 1000).alias("v"))
    got = frame_figures(df, "at", 10**6, {"n": ("count", None), "kinds": ("distinct", "v"), "least": ("min", "v")}, ["key"])
    assert got.where("n = at + 1 and kinds = least(n, 1000) and least = 0").count() == 200_000
    for bad in ({"n": ("mean", "v")}, {"n": ("sum", None)}, {"n": ("count", None), "m": F.count("*")}, {"__fl_a0": ("count", None)}):
        with pytest.raises(ValueError):
            frame_figures(line, "at", 5, bad, ["key"])
