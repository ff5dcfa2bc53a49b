"""Text helpers for field names, attribute lists and fallbacks. NULL in, NULL out, unless said."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as JavaScript's \s has it, and the characters a selector needs escaped.
JS_SPACE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SELECTOR_SIGNS = r"""[!"#$%&'()*+,./:;<=>?@\[\\\]^`{|}~]"""


def split_items(value: Column) -> Column:
    """The items of a comma list, blanks around items gone; trailing empty items stay.

    Trimming item by item reads each character a bounded number of times, whatever runs of blanks there are.
    """
    return F.transform(F.split(value, ","), lambda item: F.btrim(item, F.lit(JS_SPACE)))


def escape_selector(value: Column) -> Column:
    """A backslash before each character that selectors treat as syntax."""
    return F.regexp_replace(value, f"({SELECTOR_SIGNS})", r"\\$1")


def model_prefix(name: Column) -> Column:
    """What stands up to and with the last dot; empty without a dot."""
    return F.regexp_extract(name, r"(?s)^.*\.", 0)


def with_model_prefix(value: Column, prefix: Column) -> Column:
    """A leading `*.` becomes the prefix, taken literally; other values stay."""
    return F.when(F.startswith(value, F.lit("*.")), F.concat(prefix, F.substr(value, F.lit(3)))).otherwise(value)


def first_filled(*values: Column) -> Column:
    """The first value that is neither NULL nor empty, else the empty string ("0" is filled)."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def default_verb(value: Column, verb: str = "GET") -> Column:
    """The value, or the default where it is NULL or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(verb))


def first_known(*values: Column) -> Column:
    """The first value that is not NULL; an empty string counts."""
    return F.coalesce(*values)
