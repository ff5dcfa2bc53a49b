"""Edge rows of the predicates and text helpers."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import at_least_nonword, default_verb, escape_selector, filled, first_filled, first_known, model_prefix, number_of, split_items, whole_match, with_model_prefix


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value,pattern,expected",
    [("ab", "ab", True), ("xab", "ab", False), ("abx", "ab", False), ("ab", "a|ab", False), ("ab\n", "ab", False), ("", "a", True), (None, "a", True), ("b", "a*", False), ("aXb", "(a)(X)(b)", True)],
)
def test_whole_match(spark, value, pattern, expected):
    assert one(spark, whole_match(F.col("v"), pattern), v=value) is expected


def test_whole_match_of_a_needed_field(spark):
    assert one(spark, whole_match(F.col("v"), "a", optional=False), v=None) is False
    assert one(spark, whole_match(F.col("v"), "a", optional=False), v="a") is True


@pytest.mark.parametrize(
    "value,least,expected",
    [("a!b?", "2", True), ("a!b?", "3", False), ("abc", "1", False), ("a_b", "1", False), ("é", "1", True), ("!", "", False), ("!", None, False), ("abc", "0", False), ("a!", "0", True), ("a!", "x", False), (None, "1", False), ("\U0001f600", "2", False), ("!!", 2, True), ("!", " ", True), ("a", " ", False), ("!" * 16, "0x10", True), ("!" * 15, "0x10", False), ("!!", "1_0", False), ("!" * 20, "inf", False), ("!!", "1e0", True), ("!", "Infinity", False)],
)
def test_at_least_nonword(spark, value, least, expected):
    assert one(spark, at_least_nonword(F.col("v"), least), v=value) is expected


@pytest.mark.parametrize(
    "text,expected",
    [("", 0), (" \n", 0), ("0x10", 16), ("0B11", 3), ("0o7", 7), ("+5", 5), (" .5 ", 0.5), ("5.", 5), ("1e2", 100), ("-Infinity", float("-inf")), ("1_0", None), ("inf", None), ("nan", None), ("0x", None), ("0x1_0", None), ("-0x1", None), ("1 2", None), ("١", None)],
)
def test_numbers_as_scripts_read_them(text, expected):
    got = number_of(text)
    assert got != got if expected is None else got == expected


@pytest.mark.parametrize("value,expected", [("  a , b,c  ", ["a", "b", "c"]), ("a,", ["a", ""]), ("", [""]), (" a　,﻿b\n", ["a", "b"]), (None, None), (" , ", ["", ""]), ("a b , , \x85c", ["a b", "", "\x85c"]), ("x" + " " * 200_000 + "y", ["x" + " " * 200_000 + "y"])])
def test_split_items(spark, value, expected):
    assert one(spark, split_items(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value,expected", [("a[b].c", r"a\[b\]\.c"), ("x_y-z", "x_y-z"), ("a\\b", "a\\\\b"), ("$1", r"\$1"), ("", "")])
def test_escape_selector(spark, value, expected):
    assert one(spark, escape_selector(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value,expected", [("A.B.c", "A.B."), ("c", ""), ("a\n.b", "a\n."), ("", "")])
def test_model_prefix(spark, value, expected):
    assert one(spark, model_prefix(F.col("v")), v=value) == expected


@pytest.mark.parametrize("value,prefix,expected", [("*.x", "P.", "P.x"), ("*.*.z", "P.", "P.*.z"), ("x*.y", "P.", "x*.y"), ("*.x", "$&", "$&x")])
def test_with_model_prefix(spark, value, prefix, expected):
    assert one(spark, with_model_prefix(F.col("v"), F.col("p")), v=value, p=prefix) == expected


def test_fallbacks(spark):
    assert one(spark, first_filled(F.col("a"), F.col("b")), a="", b="h") == "h"
    assert one(spark, first_filled(F.col("a"), F.col("b")), a="0", b="h") == "0"
    assert one(spark, first_filled(F.col("a"), F.col("b")), a=None, b=None) == ""
    assert one(spark, default_verb(F.col("a")), a="") == "GET"
    assert one(spark, default_verb(F.col("a")), a="POST") == "POST"
    assert one(spark, first_known(F.col("a"), F.col("b")), a=None, b="t") == "t"
    assert one(spark, first_known(F.col("a"), F.col("b")), a="", b="t") == ""
    assert [one(spark, filled(F.col("a")), a=x) for x in (None, "", "t")] == [False, False, True]
