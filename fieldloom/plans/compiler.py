"""Compiles fields with `data-val-*` attributes to rules, and rules to Spark columns.

A rule becomes one boolean expression; Catalyst does the rest. Only `regex`, `nonalphamin` and the rule
that always holds have a settled meaning. What the other builders below take their rules to mean is
this library's own choice, since no specification says it; pass `builders` to choose otherwise.

- `required`: neither NULL nor empty. `minlength`, `maxlength`, `rangelength`: characters.
- `min`, `max`, `range`: the value as a double, if it is a `number`; no other value is within bounds. Bounds are
  read as number_of() does; a bound that is no number raises, as does a length that is not whole.
  `equalTo`: the other column's value; NULL there is empty.
- `digits`: ASCII digits alone. `number`: a decimal numeral, with a sign or an exponent if it likes.
- `date`: a day of the calendar written yyyy-mm-dd. `email`: one `@`, a dot in what follows it, no blanks.
- `url`: http or https, `//`, a host, no blanks. `creditcard`: 12 to 19 digits, blanks and hyphens aside,
  whose Luhn sum is right.
- `extension`: a file name that ends in one of a list, whatever the case. `accept`: a media type out of a
  list, in which `image/*` names all of a kind.

All but `required` and `nonalphamin` hold for an empty value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..functions import at_least_nonword, filled, number_of, whole_match
from ..operators.adapters import Options, Registry, default_registry

#: (value, argument, whether the field may be empty) -> boolean column
Builder = Callable[[Column, object, bool], Column]


_NUMERAL = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _number(value: Column) -> Column:
    """The value of a decimal numeral; NULL for all else that a cast would take, such as `5d` or `NaN`."""
    return F.when(value.rlike(rf"\A{_NUMERAL}\z"), value.try_cast("double"))


def _bound(argument: object) -> float:
    bound = number_of(str(argument))
    if bound != bound:
        raise ValueError(f"{argument!r} is no bound: not a number")
    return bound


def _size(argument: object) -> int:
    size = _bound(argument)
    if not size.is_integer():
        raise ValueError(f"{argument!r} is no bound of a length: not whole")
    return int(size)


def _named(column: object) -> Column:
    return F.col("`{}`".format(str(column).replace("`", "``")))


def _length(value: Column) -> Column:
    return F.char_length(value)


def _like(pattern: str) -> Builder:
    return lambda v, a, o: _if_filled(v, v.rlike(rf"\A(?:{pattern})\z"))


def _listed(argument: object) -> list[str]:
    """The items of an attribute's list, which commas or bars part."""
    return [x for item in str(argument or "").replace("|", ",").split(",") if (x := item.strip().lower().lstrip("."))]


def _pattern(value: Column, argument: object, optional: bool) -> Column:
    if not argument:
        raise ValueError("a regex rule needs a pattern")
    return whole_match(value, str(argument), optional)


def _card(value: Column, argument: object, optional: bool) -> Column:
    digits = F.translate(value, " -", "")
    return _if_filled(value, digits.rlike(r"\A[0-9]{12,19}\z") & F.call_function("luhn_check", digits))


def _date(value: Column, argument: object, optional: bool) -> Column:
    return _if_filled(value, value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & value.try_cast("date").isNotNull())


def _extension(value: Column, argument: object, optional: bool) -> Column:
    return _if_filled(value, F.lower(F.regexp_extract(value, r"\.([^./\\]+)\z", 1)).isin(_listed(argument) or [""]) & value.contains("."))


def _media(value: Column, argument: object, optional: bool) -> Column:
    kinds = _listed(argument)
    own = F.lower(F.btrim(value))
    ok = own.isin([k for k in kinds if not k.endswith("/*")] or [""])
    for k in kinds:
        if k.endswith("/*"):
            ok = ok | own.startswith(k[:-1])
    return _if_filled(value, ok)


def _if_filled(value: Column, test: Column) -> Column:
    return ~filled(value) | F.coalesce(test, F.lit(False))


BUILDERS: dict[str, Builder] = {
    "__dummy__": lambda v, a, o: F.lit(True),
    "regex": _pattern,
    "nonalphamin": lambda v, a, o: at_least_nonword(v, a),
    "required": lambda v, a, o: filled(v),
    "minlength": lambda v, a, o: _if_filled(v, _length(v) >= _size(a)),
    "maxlength": lambda v, a, o: _if_filled(v, _length(v) <= _size(a)),
    "rangelength": lambda v, a, o: _if_filled(v, _length(v).between(_size(a[0]), _size(a[1]))),
    "min": lambda v, a, o: _if_filled(v, _number(v) >= _bound(a)),
    "max": lambda v, a, o: _if_filled(v, _number(v) <= _bound(a)),
    "range": lambda v, a, o: _if_filled(v, _number(v).between(_bound(a[0]), _bound(a[1]))),
    "digits": _like("[0-9]+"),
    "number": _like(_NUMERAL),
    "date": _date,
    "email": _like(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+"),
    "url": _like(r"(?i:https?)://[^\s/?#]+(?:[/?#]\S*)?"),
    "creditcard": _card,
    "extension": _extension,
    "accept": _media,
    "equalTo": lambda v, a, o: _if_filled(v, v == F.coalesce(_named(a).cast("string"), F.lit(""))),
}


@dataclass(frozen=True)
class Form:
    """Rules and messages by field; fields are column names."""

    rules: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    messages: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


def compile_field(name: str, attributes: Mapping[str, str], registry: Registry | None = None, kind: str = "text") -> tuple[dict, dict]:
    """Rules and messages of one field. An adapter acts if `data-val-<name>` is there, be it empty."""
    rules: dict[str, object] = {}
    messages: dict[str, str] = {}
    for adapter in registry or default_registry():
        at = f"data-val-{adapter.name}"
        if at in attributes:
            adapter.adapt(Options(name, attributes[at], {p: attributes.get(f"{at}-{p}") for p in adapter.params}, kind, rules, messages))
    rules["__dummy__"] = True
    return rules, messages


def compile_form(fields: Sequence[Mapping[str, str]], registry: Registry | None = None) -> Form:
    """A form out of field attributes, each with `name` and perhaps `type`.

    Fields without `data-val` = "true", or with `form` = "" (in no form), are left out. All others make one
    form here, whatever form they name; compile_forms keeps forms apart.
    """
    found = compile_forms(fields, registry).values()
    return Form({n: r for f in found for n, r in f.rules.items()}, {n: m for f in found for n, m in f.messages.items()})


def compile_forms(fields: Sequence[Mapping[str, str]], registry: Registry | None = None) -> dict[str, Form]:
    """The forms of a page by name, in the order of their first fields, each compiled once.

    A field's form is its `form` attribute, "form" where it has none; "" is no form.
    """
    registry = registry or default_registry()
    forms: dict[str, Form] = {}
    for f in fields:
        if f.get("data-val") == "true" and (name := f.get("form", "form")):
            form = forms.setdefault(name, Form({}, {}))
            form.rules[f["name"]], form.messages[f["name"]] = compile_field(f["name"], f, registry, f.get("type", "text").lower())
    return forms


def column_of(name: str, rule: str, argument: object, optional: bool, builders: Mapping[str, Builder] | None = None) -> Column:
    """The rule's boolean column over the field's column, never NULL: where a builder gives NULL, the rule holds."""
    builder = {**BUILDERS, **(builders or {})}.get(rule)
    if builder is None:
        raise KeyError(f"field {name}: rule {rule} has no builder; pass one in `builders`")
    return F.coalesce(builder(_named(name).cast("string"), argument, optional), F.lit(True))
