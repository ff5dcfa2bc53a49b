"""Applying a compiled form to a DataFrame, batch or streaming: projections and filters only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

VIOLATIONS = "violations"


def _checks(form, builders) -> list[tuple[str, str, Column]]:
    from ..plans.compiler import column_of

    return [
        (name, rule, column_of(name, rule, argument, "required" not in rules, builders))
        for name, rules in form.rules.items()
        for rule, argument in rules.items()
        if rule != "__dummy__"
    ]


def free(df: DataFrame, *names: str) -> None:
    """Raises where df has a column of one of these names, in whatever case: it would be replaced."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"column {', '.join(sorted(taken))} is there already; name another")


def with_violations(df: DataFrame, form, builders: Mapping | None = None, column: str = VIOLATIONS) -> DataFrame:
    """df with an array of (field, rule, message) of the rules a row breaks; empty if it breaks none.

    A column of that name in df raises.
    """
    free(df, column)
    broken = [
        F.when(~ok, F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"), F.lit(form.messages.get(name, {}).get(rule, "")).alias("message")))
        for name, rule, ok in _checks(form, builders)
    ]
    if not broken:
        return df.withColumn(column, F.expr("cast(array() as array<struct<field:string,rule:string,message:string>>)"))
    return df.withColumn(column, F.array_compact(F.array(*broken)))


def _all_hold(form, builders) -> Column:
    out = F.lit(True)
    for _, _, ok in _checks(form, builders):
        out = out & ok
    return out


def valid_rows(df: DataFrame, form, builders: Mapping | None = None) -> DataFrame:
    """The rows that break no rule, as they are: nulls as the rules say, repeated rows stay, no column is added."""
    return df.where(_all_hold(form, builders))


def invalid_rows(df: DataFrame, form, builders: Mapping | None = None) -> DataFrame:
    """The rows that break some rule: just those that valid_rows leaves out, since no rule is NULL."""
    return df.where(~_all_hold(form, builders))


def rule_report(df: DataFrame, form, builders: Mapping | None = None) -> DataFrame:
    """(field, rule, checked, broken): one pass, partial sums, one row for each rule."""
    checks = _checks(form, builders)
    sums = df.agg(F.count("*").alias("n"), *(F.count_if(~ok).alias(f"c{i}") for i, (_, _, ok) in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"), F.col("n").alias("checked"), F.col(f"c{i}").alias("broken")) for i, (name, rule, _) in enumerate(checks)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def rule_totals(df: DataFrame, form, by: Sequence[str], sets: Sequence[Sequence[str]] | None = None, builders: Mapping | None = None) -> DataFrame:
    """(by..., grouping_id, field, rule, checked, broken) for each group of each grouping set; by default the rollup of by.

    Rows are counted once, by all of `by`; the sets are sums over those groups, so that what is expanded for each
    set is groups and never rows. grouping_id has a bit for each column of by, the first the highest, set where
    the column is summed over: that tells its NULL from a NULL in the data, which is a group of its own.
    An empty table or a form without rules gives no rows; columns of by named like the others raise.
    """
    own = {"grouping_id", "field", "rule", "checked", "broken"} & {c.lower() for c in by}
    if own:
        raise ValueError(f"column {', '.join(sorted(own))} of by has the name of a result")
    sets = [list(by[:i]) for i in range(len(by), -1, -1)] if sets is None else [list(s) for s in sets]
    if unknown := {c for s in sets for c in s} - set(by):
        raise ValueError(f"column {', '.join(sorted(unknown))} is not in by")
    checks = _checks(form, builders)
    if not checks:
        return df.select(*by).where("false").selectExpr("*", "cast(0 as bigint) grouping_id", "'' field", "'' rule", "cast(0 as bigint) checked", "cast(0 as bigint) broken")
    keys = [F.col(c).alias(f"__fl_by{i}") for i, c in enumerate(by)]
    counted = df.groupBy(*keys).agg(F.count("*").alias("__fl_n"), *(F.count_if(~ok).alias(f"__fl_c{i}") for i, (_, _, ok) in enumerate(checks)))
    key = {c: F.col(f"__fl_by{i}") for i, c in enumerate(by)}
    sums = counted.groupingSets([[key[c] for c in s] for s in sets], *key.values()).agg(F.grouping_id().alias("grouping_id"), F.sum("__fl_n").alias("n"), *(F.sum(f"__fl_c{i}").alias(f"c{i}") for i in range(len(checks))))
    rows = F.array(*(F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"), F.col("n").alias("checked"), F.col(f"c{i}").alias("broken")) for i, (name, rule, _) in enumerate(checks)))
    return sums.select(*(k.alias(c) for c, k in key.items()), "grouping_id", F.explode(rows).alias("r")).select(*(F.col(f"`{c}`") for c in by), "grouping_id", "r.*")
