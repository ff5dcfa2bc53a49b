"""As-of and interval joins against brute force, with hot keys, ties, nulls and one very long interval."""

import random
from datetime import date, datetime, timedelta

import pytest
from fieldloom.operators import timelines
from fieldloom.operators.timelines import asof_join, interval_join

LEFT, RIGHT = "id int, k string, at timestamp_ntz", "k string, time timestamp_ntz, no int, note string"
T0 = datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(left, right, keyed, strict, within):
    out = []
    for i, k, at in left:
        best = None
        for rk, t, no, note in right:
            if at is None or t is None or (keyed and (k is None or rk != k)):
                continue
            if (t < at if strict else t <= at) and (within is None or at - t <= timedelta(microseconds=within)) and (best is None or (t, no) > best[:2]):
                best = (t, no, note)
        out.append((i, k, at, best and best[1], best and best[2]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(3)
    when = lambda: None if rng.random() < 0.03 else T0 + timedelta(seconds=int(rng.paretovariate(0.4)) % 5000)  # noqa: E731  bursts near the start
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None, "left only"])
    left = [(i, key(), when()) for i in range(300)] + [(7, "hot", T0), (7, "hot", T0)]
    right = [(k if (k := key()) != "left only" else "right only", when(), i, f"n{i % 5}" if i % 7 else None) for i in range(300)]
    return left, right


@pytest.mark.parametrize("limit", [10, 10**6])
@pytest.mark.parametrize("keyed,strict,within", [(True, False, None), (True, True, 40e6), (False, False, None), (False, True, None)])
def test_asof_equals_brute_force(spark, lines, monkeypatch, limit, keyed, strict, within):
    monkeypatch.setattr(timelines, "HOT", 10**6)
    monkeypatch.setattr(timelines, "SLOTS", 3)  # several rounds of cuts
    left, right = lines
    df = asof_join(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT), ("at", "time"), {"no": "no", "note": "note"}, by=[("k", "k")] if keyed else (), ties=["no"], strict=strict, within=within, limit=limit)
    assert sorted(map(tuple, df.collect()), key=repr) == brute(left, right, keyed, strict, within)
    assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def test_pieces_are_bounded_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(timelines, "HOT", 10**6)
    rng = random.Random(8)
    rows = spark.createDataFrame([(0 if i % 3 else i, 1000.0 * rng.random() ** 6) for i in range(3000)] + [(0, 5.0)] * 90, "k0 int, t double")
    cut, any_cut = timelines._cut(rows, ["k0"], 60)
    assert any_cut and cut.count() == 3090
    pieces = sorted((tuple(r["piece"]), r["low"], r["high"], r["n"]) for r in cut.where("k0 = 0").groupBy("piece").agg({"t": "min"}).withColumnRenamed("min(t)", "low").join(cut.where("k0 = 0").groupBy("piece").agg({"t": "max"}).withColumnRenamed("max(t)", "high"), "piece").join(cut.where("k0 = 0").groupBy("piece").count().withColumnRenamed("count", "n"), "piece").collect())
    assert all(a[2] <= b[1] for a, b in zip(pieces, pieces[1:]))
    assert all(n <= 60 or low == high for _, low, high, n in pieces)
    assert {tuple(r["piece"]) for r in cut.where("k0 <> 0").collect()} == {()}


def test_asof_empty_tables_kinds_and_clashes(spark, lines):
    left, right = spark.createDataFrame(lines[0], LEFT), spark.createDataFrame(lines[1], RIGHT)
    assert asof_join(left.limit(0), right, ("at", "time"), {"no": "no"}).count() == 0
    got = asof_join(left, right.limit(0), ("at", "time"), {"no": "no"})
    assert got.count() == left.count() and got.where("no is not null").count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right, ("at", "time"), {"K": "no"})
    with pytest.raises(TypeError):
        asof_join(left, right, ("at", "no"), {"x": "no"})
    days = spark.createDataFrame([(date(2024, 1, 5), 1), (date(2024, 1, 9), 2)], "d date, v int")
    assert [r["w"] for r in asof_join(days, days, ("d", "d"), {"w": "v"}, strict=True).orderBy("d").collect()] == [None, 1]
    numbers = spark.createDataFrame([(1.5, 1), (2.5, 2)], "x double, v int")
    assert [r["w"] for r in asof_join(numbers, numbers, ("x", "x"), {"w": "v"}, strict=True, within=0.5).orderBy("x").collect()] == [None, None]


def test_intervals_equal_brute_force(spark):
    rng = random.Random(6)
    points = [(i, rng.choice("ab") if i % 9 else None, T0 + timedelta(seconds=rng.randint(0, 4000)) if i % 11 else None) for i in range(400)] + [(1, "a", T0)] * 2
    spans = []
    for i in range(200):
        start = T0 + timedelta(seconds=rng.randint(-50, 4000))
        spans.append((i, rng.choice("ab"), start, start + timedelta(seconds=rng.choice([0, -3, 1, 2, 5, 16, 17]))))
    spans += [(900, "a", T0, T0 + timedelta(seconds=3600)), (901, "b", None, T0), (902, None, T0, T0 + timedelta(hours=1)), (903, "a", T0 - timedelta(days=400), T0 + timedelta(days=400))]
    p, s = spark.createDataFrame(points, "id int, k string, at timestamp_ntz"), spark.createDataFrame(spans, "no int, key string, low timestamp_ntz, high timestamp_ntz")
    for by in ([("k", "key")], ()):
        want = sorted(((*a, *b) for a in points for b in spans if a[2] and b[2] and b[2] <= a[2] < b[3] and (not by or a[1] and a[1] == b[1])), key=repr)
        got = interval_join(p, s, "at", ("low", "high"), by=by)
        assert sorted(map(tuple, got.collect()), key=repr) == want
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert interval_join(p, s.limit(0), "at", ("low", "high")).count() == 0
    assert interval_join(p.limit(0), s, "at", ("low", "high")).count() == 0
    with pytest.raises(ValueError):
        interval_join(p, s.withColumnRenamed("no", "id"), "at", ("low", "high"))


def test_a_very_long_interval_makes_few_rows(spark):
    spans = spark.createDataFrame([(float(i), i + 1.0) for i in range(50)] + [(0.0, 1000.0)], "low double, high double")
    points = spark.range(50).selectExpr("id + 0.5D as x")
    joined = interval_join(points, spans, "x", ("low", "high"))
    assert joined.count() == 100
    exploded = [line for line in plan_of(joined).splitlines() if "Generate explode" in line]
    assert len(exploded) == 2
    levels = {r[0] for r in joined.selectExpr("high - low").distinct().collect()}
    assert levels == {1.0, 1000.0}


@pytest.mark.parametrize("ratio", [1, 15.99, 16, 16.01, 255, 256, 257, 4096])
def test_lengths_at_the_levels_edges(spark, ratio):
    spans = spark.createDataFrame([(float(s), s + ratio * 0.5) for s in range(-20, 20)], "low double, high double")
    points = spark.createDataFrame([(x * 0.37,) for x in range(-200, 200)], "x double")
    want = sum(a <= x * 0.37 < a + ratio * 0.5 for x in range(-200, 200) for a in map(float, range(-20, 20)))
    assert interval_join(points, spans, "x", ("low", "high"), width=0.5).count() == want
