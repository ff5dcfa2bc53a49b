"""Adapters turn the attributes of a field into rules: the extension point of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field


@dataclass
class Options:
    """What an adapter sees of one field, and the rules and messages it writes."""

    name: str
    message: str
    params: Mapping[str, str | None]
    kind: str = "text"
    rules: dict[str, object] = field(default_factory=dict)
    messages: dict[str, str] = field(default_factory=dict)

    def put(self, rule: str, value: object) -> None:
        """A rule always; its message only where there is one."""
        self.rules[rule] = value
        if self.message:
            self.messages[rule] = self.message


@dataclass(frozen=True)
class Adapter:
    name: str
    params: tuple[str, ...]
    adapt: Callable[[Options], None]


class Registry:
    """Adapters in the order they were added; every add returns the registry."""

    def __init__(self) -> None:
        self._adapters: list[Adapter] = []

    def __iter__(self) -> Iterator[Adapter]:
        return iter(self._adapters)

    def add(self, name: str, adapt: Callable[[Options], None], params: tuple[str, ...] = ()) -> "Registry":
        self._adapters.append(Adapter(name, tuple(params), adapt))
        return self

    def add_flag(self, name: str, rule: str | None = None) -> "Registry":
        """A rule without argument."""
        return self.add(name, lambda o: o.put(rule or name, True))

    def add_value(self, name: str, attribute: str, rule: str | None = None) -> "Registry":
        """A rule whose argument is one attribute, which must be named."""
        if not attribute:
            raise ValueError(f"adapter {name}: the attribute must be named")
        return self.add(name, lambda o: o.put(rule or name, o.params.get(attribute)), (attribute,))

    def add_bounds(self, name: str, low: str | None = None, high: str | None = None, both: str | None = None, attributes: tuple[str, str] = ("min", "max")) -> "Registry":
        """Rules of a least, a largest, or both; "0" is set, an empty text is not.

        A bound for which no rule was named raises, where it is used.
        """
        least, most = attributes

        def adapt(o: Options) -> None:
            a, b = o.params.get(least) or None, o.params.get(most) or None
            if a is None and b is None:
                return
            rule = both if a and b else low if a else high
            if rule is None:
                raise ValueError(f"field {o.name}: adapter {name} has no rule for {', '.join(k for k, v in ((least, a), (most, b)) if v)}")
            o.put(rule, (a, b) if a and b else a or b)

        return self.add(name, adapt, attributes)


def _required(o: Options) -> None:
    if o.kind != "checkbox":  # a box that must be ticked is another matter
        o.put("required", True)


def _equal(o: Options) -> None:
    other = o.params.get("other") or ""
    if other.startswith("*."):
        other = o.name[: o.name.rfind(".") + 1] + other[2:]
    if not other:
        raise ValueError(f"field {o.name}: equalto names no other field")
    o.put("equalTo", other)


def _password(o: Options) -> None:
    for attribute, rule in (("min", "minlength"), ("nonalphamin", "nonalphamin"), ("regex", "regex")):
        if o.params.get(attribute):
            o.put(rule, o.params[attribute])


def _file_types(o: Options) -> None:
    o.put("extension", o.params.get("extensions"))


def default_registry(has_extension_rule: bool = True) -> Registry:
    """The built-in adapters. `remote`, a call for each row, is left out."""
    r = Registry()
    if has_extension_rule:
        r.add_value("accept", "mimtype").add_value("extension", "extension")
    else:
        r.add_value("extension", "extension", "accept")
    r.add_value("regex", "pattern")
    for flag in ("creditcard", "date", "digits", "email", "number", "url"):
        r.add_flag(flag)
    r.add_bounds("length", "minlength", "maxlength", "rangelength").add_bounds("range", "min", "max", "range")
    r.add_bounds("minlength", low="minlength").add_bounds("maxlength", low="minlength", high="maxlength")
    r.add("equalto", _equal, ("other",)).add("required", _required)
    r.add("password", _password, ("min", "nonalphamin", "regex")).add("fileextensions", _file_types, ("extensions",))
    return r
