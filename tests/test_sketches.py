"""Sketches against exact figures: bounds, merges in any order, parts sketched anew, odd rows."""

import random
from bisect import bisect_left, bisect_right

import pytest
from fieldloom.operators.sketches import distinct_error, estimates, merged, sketched, store

ASKED = {"amount": {"median": 0.5, "high": 0.95}}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i % 6, "hot" if i % 3 else f"g{i % 4}", f"u{int(rng.paretovariate(0.6)) % 9000}", rng.lognormvariate(0, 2)) for i in range(30_000)]
    return out + [(1, None, None, None), (2, "bare", None, None), (2, "bare", None, None)]


@pytest.fixture(scope="module")
def sketches(spark, rows):
    df = spark.createDataFrame(rows, "day int, kind string, who string, paid double").repartition(5)
    return sketched(df, ["day", "kind"], {"users": "who"}, {"amount": "paid"}).cache()


def near(got, rows):
    """Whether estimates are within the bounds of what rows hold."""
    users, paid = {r[2] for r in rows if r[2] is not None}, sorted(r[3] for r in rows if r[3] is not None)
    assert got["n"] == len(rows)
    assert abs(got["users"] - len(users)) <= distinct_error() * len(users)
    for name, rank in ASKED["amount"].items():
        if not paid:
            assert got[name] is None
        else:
            assert bisect_left(paid, got[name]) / len(paid) - 0.02 <= rank <= bisect_right(paid, got[name]) / len(paid) + 0.02


def test_groups_are_within_bounds(sketches, rows):
    for r in estimates(merged(sketches, ["kind"], ["users"], ["amount"]), ["users"], ASKED).collect():
        near(r, [x for x in rows if x[1] == r["kind"]])
    (whole,) = estimates(merged(sketches, [], ["users"], ["amount"]), ["users"], ASKED).collect()
    near(whole, rows)


def test_merges_are_associative(sketches, rows):
    odd, even = sketches.where("day % 2 = 1"), sketches.where("day % 2 = 0")
    parts = [merged(odd, ["kind"], ["users"], ["amount"]), merged(even, ["kind"], ["users"], ["amount"])]
    got = []
    for first, second in (parts, parts[::-1]):
        (r,) = estimates(merged(first.unionByName(second), [], ["users"], ["amount"]), ["users"], ASKED).collect()
        near(r, rows)
        got.append((r["n"], r["users"]))
    (flat,) = estimates(merged(sketches, [], ["users"], ["amount"]), ["users"], ASKED).collect()
    assert got == [(flat["n"], flat["users"])] * 2


def test_parts_are_replaced(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "day int, kind string, who string, paid double")
    make = lambda which: sketched(df.where(which), ["kind", "day"], {"users": "who"}, {"amount": "paid"})
    path = str(tmp_path / "store")
    store(make("day < 4"), path, "day")
    store(make("day >= 3"), path, "day")  # day 3 again
    kept = store(make("day = 99"), path, "day")  # nothing
    (r,) = estimates(merged(kept, [], ["users"], ["amount"]), ["users"], ASKED).collect()
    near(r, rows)


def test_odd_tables(spark, sketches):
    by = {r["kind"]: r for r in estimates(merged(sketches, ["kind"], ["users"], ["amount"]), ["users"], ASKED).collect()}
    assert (by["bare"]["n"], by["bare"]["users"], by["bare"]["median"]) == (2, 0, None)
    assert by[None]["n"] == 1
    none = spark.createDataFrame([], "kind string, who string, paid double")
    assert sketched(none, ["kind"], {"users": "who"}).count() == 0
    (r,) = estimates(sketched(none, [], {"users": "who"}, {"amount": "paid"}), ["users"], ASKED).collect()
    assert tuple(r) == (0, 0, None, None)
    with pytest.raises(ValueError):
        sketched(none, ["kind"], {"N": "who"})
