"""Predicates whose meaning is settled. None of them is ever NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import JS_SPACE

_DECIMAL = re.compile(r"[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
_BASES = {"0x": 16, "0o": 8, "0b": 2}


def number_of(text: str) -> float:
    """The number that a comparison in a browser's script takes a text for; NaN if it is none.

    White space around is dropped and nothing at all is 0; decimal numerals, `Infinity`, and whole
    numbers after 0x, 0o and 0b count. `1_0`, `inf` and `nan` are no numbers there.
    """
    text = text.strip(JS_SPACE)
    if not text:
        return 0.0
    if _DECIMAL.fullmatch(text):
        return float(text)
    if base := _BASES.get(text[:2].lower()):
        if re.fullmatch(r"[0-9A-Za-z]+", text[2:]):
            try:
                return float(int(text[2:], base))
            except ValueError:
                pass
    return float("nan")


def filled(value: Column) -> Column:
    """Neither NULL nor empty."""
    return value.isNotNull() & (value != "")


def whole_match(value: Column, pattern: str | Column, optional: bool = True) -> Column:
    """The pattern's leftmost match spans the value. That is less than an anchored match: `a|ab` finds
    `a` in `ab`, and fails. NULL and empty values pass where the field is optional."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hit = F.coalesce(F.regexp_substr(value, pattern) == value, F.lit(False))
    return ~filled(value) | hit if optional else hit


def at_least_nonword(value: Column, least: object) -> Column:
    """At least `least` characters other than A-Z, a-z, 0-9 and _, and at least one.

    An unset, empty or non-numeric `least` is never met; "0", or a text of blanks, asks for one. Texts
    are read as number_of() does. Characters above U+FFFF count once. `least` is a number, its text, or
    a column of numbers.
    """
    count = F.regexp_count(value, F.lit(r"\W"))
    if isinstance(least, Column):
        return F.coalesce(count >= F.greatest(least, F.lit(1)), F.lit(False))
    bound = number_of(str(least)) if least is not None and str(least) != "" else float("nan")
    if bound != bound:
        return F.lit(False)
    return F.coalesce(count >= F.lit(max(bound, 1.0)), F.lit(False))
