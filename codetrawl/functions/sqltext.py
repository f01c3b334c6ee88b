"""Spark SQL expressions as text.

A scan compiles some three dozen rules into one projection. As Column objects that is many
thousand calls into the JVM before anything runs; as text it is one ``expr`` per projection.
"""

from __future__ import annotations

from .text import pattern


class Sql:
    def __init__(self, text: str):
        self.text = text

    def __and__(self, other: Sql) -> Sql:
        return Sql(f"({self.text} and {other.text})")

    def __or__(self, other: Sql) -> Sql:
        return Sql(f"({self.text} or {other.text})")

    def __invert__(self) -> Sql:
        return Sql(f"(not {self.text})")

    def equals(self, value: str) -> Sql:
        return Sql(f"({self.text} = {lit(value).text})")

    def contains(self, word: str) -> Sql:
        return call("contains", self, lit(word))

    def contains_any(self, words) -> Sql:
        return Sql("(" + " or ".join(self.contains(word).text for word in words) + ")")

    def matches(self, regex: str) -> Sql:
        return call("rlike", self, lit(pattern(regex)))

    def extract(self, regex: str, group: int) -> Sql:
        return call("regexp_extract", self, lit(pattern(regex)), lit(group))

    def replaced(self, regex: str, by: str) -> Sql:
        return call("regexp_replace", self, lit(regex), lit(by))


class Case(Sql):
    """A CASE without ELSE; ``when`` adds a branch, ``otherwise`` closes it."""

    def __init__(self, branches: list[tuple[Sql, Sql]]):
        self._branches = branches
        super().__init__(self._text("null"))

    def _text(self, default: str) -> str:
        return "case " + " ".join(f"when {c.text} then {v.text}" for c, v in self._branches) + f" else {default} end"

    def when(self, condition: Sql, value: Sql) -> Case:
        return Case([*self._branches, (condition, value)])

    def otherwise(self, value: Sql) -> Sql:
        return Sql(self._text(value.text))


def when(condition: Sql, value: Sql) -> Case:
    return Case([(condition, value)])


def lit(value) -> Sql:
    if isinstance(value, bool):
        return Sql("true" if value else "false")
    if isinstance(value, int):
        return Sql(str(value))
    return Sql("'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'")


def call(function: str, *arguments: Sql) -> Sql:
    return Sql(f"{function}({', '.join(a.text for a in arguments)})")


def present_names(column: Sql, pairs) -> Sql:
    """Names of the (name, marker) pairs whose marker is contained, in list order."""
    lowered = call("lower", column)
    found = call("array", *[when(lowered.contains(marker.lower()), lit(name)) for name, marker in pairs])
    return call("array_compact", found)
