"""Label maps: canonical form, text form, restriction and merging."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def canonical(labels: Column) -> Column:
    """Entries in key order: a form that can be grouped, joined and compared."""
    return F.array_sort(F.map_entries(labels))


def text(labels: Column) -> Column:
    """`a=1,b=2` in key order."""
    return F.array_join(F.transform(canonical(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def selector_text(labels: Column) -> Column:
    """`{a="1", b="2"}` in key order."""
    inner = F.array_join(F.transform(canonical(labels), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ", ")
    return F.concat(F.lit("{"), inner, F.lit("}"))


def value(labels: Column, name: str) -> Column:
    """A label's value, '' where it is missing."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def only(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(names)) if names else empty()


def without(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(names)) if names else labels


def empty() -> Column:
    return F.create_map().cast("map<string,string>")


def merged(*maps: Column) -> Column:
    """Later maps win."""
    return F.map_concat(*maps)


def make(**entries: Column | str) -> Column:
    parts = []
    for key, v in entries.items():
        parts += [F.lit(key), v if isinstance(v, Column) else F.lit(v)]
    return F.create_map(*parts)


def matches(labels: Column, name: str, op: str, wanted: str) -> Column:
    """A label matcher; regular expressions match the whole value."""
    have = value(labels, name)
    if op == "=":
        return have == wanted
    if op == "!=":
        return have != wanted
    found = F.rlike(have, F.lit(rf"\A(?:{wanted})\z"))
    return found if op == "=~" else ~found


def check_regex(pattern: str) -> str:
    """Patterns that linear-time engines refuse are refused here too."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
    try:
        re.compile(re.sub(r"\(\?P?<", "(?P<", pattern))
    except re.error as error:
        raise ValueError(f"not a regular expression: {pattern!r} ({error})") from error
    return pattern
