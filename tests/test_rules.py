"""The registry, the compiler and the operators that apply a form."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import Registry, default_registry, invalid_rows, rule_report, rule_totals, valid_rows, with_violations
from fieldloom.plans import Form, column_of, compile_field, compile_form, compile_forms
from fieldloom.sources import read_table, write_split
from fieldloom.streaming import start_split


def rules(kind="text", name="f", **attributes):
    return compile_field(name, {f"data-val-{k.replace('_', '-')}": v for k, v in attributes.items()}, kind=kind)


def test_bounds():
    assert rules(length="m", length_min="0")[0] == {"minlength": "0", "__dummy__": True}
    assert rules(length="m", length_min="", length_max="5")[0]["maxlength"] == "5"
    assert rules(length="m", length_min="1", length_max="5")[0]["rangelength"] == ("1", "5")
    assert rules(length="m")[0] == {"__dummy__": True}
    assert rules(maxlength="m", maxlength_max="5")[0]["maxlength"] == "5"
    for wrong in ({"minlength": "", "minlength_max": "2"}, {"maxlength": "", "maxlength_min": "1", "maxlength_max": "2"}):
        with pytest.raises(ValueError):
            rules(**wrong)


def test_messages_are_optional():
    assert rules(required="") == ({"required": True, "__dummy__": True}, {})
    assert rules(required="fill it")[1] == {"required": "fill it"}


def test_special_adapters():
    assert "required" not in rules(kind="checkbox", required="")[0]
    assert rules(name="A.b", equalto="", equalto_other="*.c")[0]["equalTo"] == "A.c"
    assert rules(name="b", equalto="", equalto_other="*.c")[0]["equalTo"] == "c"
    assert list(rules(password="p", password_min="8", password_regex="x")[0]) == ["minlength", "regex", "__dummy__"]
    assert rules(fileextensions="", fileextensions_extensions="a,b")[0]["extension"] == "a,b"
    assert rules(email="e")[0]["email"] is True
    old = compile_field("f", {"data-val-extension": "", "data-val-extension-extension": "png"}, default_registry(has_extension_rule=False))
    assert old[0]["accept"] == "png"


def test_registry_is_open():
    own = Registry().add_flag("even").add_value("step", "by").add("three", lambda o: o.put("three", o.params), ("a",))
    got, _ = compile_field("f", {"data-val-even": "", "data-val-step": "", "data-val-step-by": "2", "data-val-three": "", "data-val-three-a": "x"}, own)
    assert got == {"even": True, "step": "2", "three": {"a": "x"}, "__dummy__": True}
    with pytest.raises(ValueError):
        Registry().add_value("x", "")


FIELDS = [
    {"name": "code", "data-val": "true", "data-val-required": "need", "data-val-regex": "shape", "data-val-regex-pattern": "[a-z]+-[0-9]+"},
    {"name": "n", "data-val": "true", "data-val-range": "size", "data-val-range-min": "1", "data-val-range-max": "5"},
    {"name": "other", "data-val": "true", "data-val-equalto": "", "data-val-equalto-other": "code"},
    {"name": "off", "data-val-required": ""},
    {"name": "loose", "data-val": "true", "form": "", "data-val-required": ""},
]


def test_form_over_rows(spark):
    form = compile_form(FIELDS)
    assert list(form.rules) == ["code", "n", "other"]
    df = spark.createDataFrame([(1, "a-1", "3", "a-1"), (2, None, "9", ""), (3, "a", "x", "b"), (4, "b-2", None, None)], "id int, code string, n string, other string")
    got = {r["id"]: {(v["field"], v["rule"]) for v in r["violations"]} for r in with_violations(df, form).collect()}
    assert got == {1: set(), 2: {("code", "required"), ("code", "regex"), ("n", "range")}, 3: {("code", "regex"), ("n", "range"), ("other", "equalTo")}, 4: set()}
    assert {r["id"] for r in valid_rows(df, form).collect()} == {1, 4}
    assert {r["id"] for r in invalid_rows(df, form).collect()} == {2, 3}
    assert {(r["field"], r["rule"], r["checked"], r["broken"]) for r in rule_report(df, form).collect()} == {("code", "required", 4, 1), ("code", "regex", 4, 2), ("n", "range", 4, 2), ("other", "equalTo", 4, 1)}
    assert with_violations(df, Form()).where(F.size("violations") > 0).count() == 0


def test_unknown_rules_need_a_builder(spark):
    form = compile_form([{"name": "code", "data-val": "true", "data-val-even": ""}], Registry().add_flag("even"))
    df = spark.createDataFrame([("a@b",), ("a",)], "code string")
    with pytest.raises(KeyError):
        valid_rows(df, form)
    assert valid_rows(df, form, {"even": lambda v, a, o: F.coalesce(v.contains("@"), F.lit(False))}).count() == 1


def test_a_builder_that_gives_null_breaks_nothing(spark):
    """Each row is valid or invalid, and it has violations in just the second case."""
    form = compile_form([{"name": "code", "data-val": "true", "data-val-even": "odd"}], Registry().add_flag("even"))
    df = spark.createDataFrame([("ab",), ("a",), (None,)], "code string")
    own = {"even": lambda v, a, o: F.when(v == "ab", True).when(v == "a", False)}
    assert [r["code"] for r in invalid_rows(df, form, own).collect()] == ["a"]
    assert {r["code"] for r in valid_rows(df, form, own).collect()} == {"ab", None}
    assert with_violations(df, form, own).where(F.size("violations") > 0).count() == 1
    assert rule_report(df, form, own).first()["broken"] == 1


def test_a_regex_needs_a_pattern(spark):
    for attributes in ({}, {"data-val-regex-pattern": ""}):
        form = compile_form([{"name": "code", "data-val": "true", "data-val-regex": "", **attributes}])
        with pytest.raises(ValueError):
            valid_rows(spark.createDataFrame([("None",)], "code string"), form)


BUILT = [
    ("digits", {}, ["0123", "", None], ["1.2", "-1", "１", "1\n"]),
    ("number", {}, ["1", "-1.5", "+.5e3", "2.", "", None], [".", "1,000", "e5", "NaN", "1 "]),
    ("date", {}, ["2024-02-29", "", None], ["2023-02-29", "2024-2-9", "2024-01-01T00:00:00", "x"]),
    ("email", {}, ["a@b.c", "a.b+c@x-y.example.org", "", None], ["a@b", "a b@c.d", "a@@b.c", "a@.c", "@b.c", "a@b.c\n"]),
    ("url", {}, ["http://ex.org", "HTTPS://ex.org:8/a?b#c", "", None], ["ftp://ex.org", "http:///a", "http://ex.org/a b", "//ex.org"]),
    ("creditcard", {}, ["4111 1111-1111 1111", "", None], ["4111111111111112", "41111111", "4111x11111111111", "٤١١١١١١١١١١١١١١١"]),
    ("fileextensions", {"extensions": "png, .jpg|tar"}, ["a.PNG", "a.b.jpg", "x.tar", "", None], ["png", "a.pngx", "a.png/b", "a."]),
    ("accept", {"mimtype": "image/*,text/plain"}, ["image/png", "Text/Plain", "", None], ["text/html", "imagery/png", "x"]),
]


@pytest.mark.parametrize("rule,params,good,bad", BUILT, ids=[b[0] for b in BUILT])
def test_built_in_readings(spark, rule, params, good, bad):
    form = compile_form([{"name": "v", "data-val": "true", f"data-val-{rule}": "", **{f"data-val-{rule}-{k}": v for k, v in params.items()}}])
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert sorted(map(repr, (r["v"] for r in valid_rows(df, form).collect()))) == sorted(map(repr, good))
    assert sorted(r["v"] for r in invalid_rows(df, form).collect()) == sorted(bad)


NUMBERS = [
    ("min", "5", ["5", "7.5", "+6", "1e3", "", None], ["4", "5d", "5f", "NaN", "Infinity", "inf", " 6", "0x10", "x"]),
    ("max", "5", ["5", "-7.5", "", None], ["6", "1d", "NaN", "-Infinity", "1_0"]),
    ("range", ("5", "10"), ["5", "10.0", "", None], ["5d", "11", "NaN", "4.999"]),
    ("range", ("0x5", " 10 "), ["5", "10", None], ["4", "11"]),
    ("rangelength", ("0x1", "2e0"), ["a", "ab", "", None], ["abc"]),
]


@pytest.mark.parametrize("rule,bounds,good,bad", NUMBERS)
def test_bounds_take_numbers_alone(spark, rule, bounds, good, bad):
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    kept = df.where(column_of("v", rule, bounds, True)).collect()
    assert sorted(map(repr, (r["v"] for r in kept))) == sorted(map(repr, good))


@pytest.mark.parametrize("rule,bounds", [("min", "1_0"), ("max", "nan"), ("range", ("1", "five")), ("minlength", "1_0"), ("maxlength", "1.5"), ("rangelength", ("1", "Infinity"))])
def test_bounds_that_are_none_raise(spark, rule, bounds):
    with pytest.raises(ValueError):
        column_of("v", rule, bounds, True)


def test_equalto_needs_another_field(spark):
    for attributes in ({}, {"equalto_other": ""}, {"equalto_other": "*."}):
        with pytest.raises(ValueError):
            rules(equalto="", **attributes)
    df = spark.createDataFrame([("a", "a"), ("a", "b")], ["odd`name", "x.y"])
    form = compile_form([{"name": "odd`name", "data-val": "true", "data-val-equalto": "", "data-val-equalto-other": "x.y"}])
    assert valid_rows(df, form).count() == 1
    form = compile_form([{"name": "x.y", "data-val": "true", "data-val-equalto": "", "data-val-equalto-other": "odd`name"}])
    assert valid_rows(df, form).count() == 1


def test_forms_are_kept_apart(spark):
    forms = compile_forms([
        {"name": "a", "form": "one", "data-val": "true", "data-val-digits": ""}, {"name": "b", "form": "two", "data-val": "true", "data-val-required": "need"},
        {"name": "c", "form": "", "data-val": "true", "data-val-required": ""}, {"name": "a", "form": "two", "data-val": "true", "data-val-email": ""}, {"name": "d", "form": "three"},
    ])
    assert {n: {c: list(r) for c, r in f.rules.items()} for n, f in forms.items()} == {"one": {"a": ["digits", "__dummy__"]}, "two": {"b": ["required", "__dummy__"], "a": ["email", "__dummy__"]}}
    assert forms["two"].messages == {"b": {"required": "need"}, "a": {}}
    df = spark.createDataFrame([("1", None), ("a@b.c", "x"), (None, "")], "a string, b string")
    assert [valid_rows(df, forms[n]).count() for n in ("one", "two")] == [2, 1]
    assert df.where(column_of("a", "__dummy__", True, True)).count() == 3


def test_columns_of_the_user_are_not_replaced(spark, tmp_path):
    form = compile_form(FIELDS[:1])
    df = spark.createDataFrame([("a-1", "mine", "his")], "code string, Violations string, valid string")
    with pytest.raises(ValueError):
        with_violations(df, form)
    for names in ({}, {"violations": "v"}, {"valid": "w"}):
        with pytest.raises(ValueError):
            write_split(df, form, str(tmp_path / "no"), **names)
    write_split(df, form, str(tmp_path / "yes"), violations="v", valid="w")
    assert spark.read.parquet(str(tmp_path / "yes" / "w=true")).select("Violations", "valid").first() == ("mine", "his")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "yes" / "w=true"))
    with pytest.raises(ValueError):
        start_split(stream, form, str(tmp_path / "s"), str(tmp_path / "c"))


def test_plan_is_a_projection(spark, data):
    form = compile_form([{"name": "c_name", "data-val": "true", "data-val-regex": "", "data-val-regex-pattern": "C.*"}])
    plan = valid_rows(read_table(spark, data, "customer", ["c_custkey", "c_name"]), form)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "c_acctbal" not in plan


def test_split_batch_and_stream(spark, data, tmp_path):
    form = compile_form([{"name": "c_mktsegment", "data-val": "true", "data-val-regex": "", "data-val-regex-pattern": "[A-G][A-Z]+"}])
    df = read_table(spark, data, "customer")
    write_split(df, form, str(tmp_path / "batch"))
    stream = spark.readStream.schema(df.schema).parquet(f"{data}/customer*.parquet")
    start_split(stream, form, str(tmp_path / "stream"), str(tmp_path / "state"), once=True).awaitTermination(120)
    for valid in ("true", "false"):
        a, b = (spark.read.parquet(str(tmp_path / kind / f"valid={valid}")).select("c_custkey").orderBy("c_custkey").collect() for kind in ("batch", "stream"))
        assert a == b and a


def test_rule_totals_tell_null_groups(spark):
    form = compile_form([{"name": "n", "data-val": "true", "data-val-range": "", "data-val-range-min": "1", "data-val-range-max": "5"}])
    df = spark.createDataFrame([("a", 1, 3.0), ("a", None, 9.0), (None, 1, 9.0), (None, None, 2.0), (None, None, 7.0)], "k string, j int, n double")
    got = {(r["k"], r["j"], r["grouping_id"]): (r["checked"], r["broken"]) for r in rule_totals(df, form, ["k", "j"]).collect()}
    assert got == {("a", 1, 0): (1, 0), ("a", None, 0): (1, 1), (None, 1, 0): (1, 1), (None, None, 0): (2, 1), ("a", None, 1): (2, 1), (None, None, 1): (3, 2), (None, None, 3): (5, 3)}
    apart = rule_totals(df, form, ["k", "j"], [["j"], []])
    assert {(r["j"], r["grouping_id"], r["checked"]) for r in apart.collect()} == {(1, 2, 2), (None, 2, 3), (None, 3, 5)}
    plan = apart._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.index("partial_count_if" if "partial_count_if" in plan else "partial_count(")  # groups are expanded, not rows
    assert rule_totals(df.limit(0), form, ["k"]).count() == 0 and rule_totals(df, compile_form([]), ["k"]).count() == 0
    for by, sets in ((["rule"], None), (["k"], [["j"]])):
        with pytest.raises(ValueError):
            rule_totals(df.withColumn("rule", F.lit(1)), form, by, sets)
