"""JSON in a column of texts, as columns of types; what is not as declared is kept and told apart."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .validate import free


def json_fields(df: DataFrame, column: str, fields: Mapping[str, tuple[str, str]], fault: str = "fault") -> DataFrame:
    """df with a column for each field and one that says what is wrong.

    fields: new name -> (path, type), such as ("$.k", "bigint"). A field that is absent or null is NULL, without fault.
    fault: NULL, 'malformed' where the text is no JSON (an empty one, an object that names a key twice), or 'mistyped' where
    some field's value is not of its type; that field is NULL then and the others have their values. A NULL text has neither
    fields nor fault. All rows stay, once, as they are. A name that df has raises.

    Texts are parsed once a row, in the JVM; no shuffle and no Python.
    """
    free(df, *fields, fault, "__fl_json")
    found = df.withColumn("__fl_json", F.try_parse_json(f"`{column}`"))
    v = F.col("__fl_json")
    there = {name: F.try_variant_get(v, path, "variant") for name, (path, _) in fields.items()}
    got = {name: F.try_variant_get(v, path, kind) for name, (path, kind) in fields.items()}
    wrong = [there[n].isNotNull() & ~F.is_variant_null(there[n]) & got[n].isNull() for n in fields]
    told = F.when(F.col(f"`{column}`").isNotNull() & v.isNull(), "malformed").when(reduce(Column.__or__, wrong, F.lit(False)), "mistyped")
    return found.select(*(F.col(f"`{c}`") for c in df.columns), *(c.alias(name) for name, c in got.items()), told.alias(fault))
