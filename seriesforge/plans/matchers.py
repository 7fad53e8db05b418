"""Label matchers: values, regular expressions and their predicates on a label map."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import QueryError, label

#: An alternation of at most so many literals becomes a set of values.
MOST_LITERALS = 10
_META = set("\\.+*?()|[]{}^$")


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str

    def matches_empty(self) -> bool:
        return self.test("")

    def test(self, text: str) -> bool:
        if self.op in ("=", "!="):
            return (text == self.value) == (self.op == "=")
        return bool(re.fullmatch(f"(?s:{self.value})", text)) == (self.op == "=~")

    def __str__(self) -> str:
        return f'{self.name}{self.op}"{self.value}"'


def check_regex(pattern: str) -> None:
    """Refuses what isn't a regular expression or what RE2 lacks: look-around, back references, possessive and atomic groups."""
    if re.search(r"\(\?(?:[=!>]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern) or re.search(r"[*+?}]\+", pattern):
        raise QueryError(f"unsupported regular expression: {pattern}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"bad regular expression {pattern!r}: {e}") from e


def _split_top(pattern: str) -> list[str]:
    """The alternatives at the top level."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


def literal_set(pattern: str) -> list[str] | None:
    """The values of an anchored alternation of literals, with one group and a common prefix or suffix at most; else None."""
    pattern = pattern.removeprefix("^")
    if pattern.endswith("$") and not pattern.endswith("\\$"):
        pattern = pattern[:-1]
    group = re.fullmatch(r"((?:[^\\()|\[\]{}.*+?^$]|\\[^a-zA-Z0-9])*)\((?:\?:)?((?:[^()\\]|\\.)*)\)((?:[^\\()|\[\]{}.*+?^$]|\\[^a-zA-Z0-9])*)", pattern)
    parts = [group[1] + p + group[3] for p in _split_top(group[2])] if group else _split_top(pattern)
    if len(parts) > MOST_LITERALS:
        return None
    values = []
    for part in parts:
        plain, i = [], 0
        while i < len(part):
            if part[i] == "\\" and i + 1 < len(part) and not part[i + 1].isalnum():
                i += 1
            elif part[i] in _META:
                return None
            plain.append(part[i])
            i += 1
        values.append("".join(plain))
    return values


def predicate(m: Matcher, labels: Column | None = None) -> Column:
    """True where the label matches; a missing label counts as empty, expressions are anchored."""
    value = label(F.col("labels") if labels is None else labels, m.name)
    if m.op in ("=", "!="):
        return value == m.value if m.op == "=" else value != m.value
    check_regex(m.value)
    known = literal_set(m.value)
    if known is not None:
        hit = value.isin(*known)
    else:
        hit = value.rlike("^(?s:" + m.value + ")\\z")
    return hit if m.op == "=~" else ~hit


def all_of(matchers, labels: Column | None = None) -> Column:
    """Every matcher; without matchers nothing is selected."""
    if not matchers:
        return F.lit(False)
    out = predicate(matchers[0], labels)
    for m in matchers[1:]:
        out &= predicate(m, labels)
    return out


def check_selective(matchers) -> None:
    if all(m.matches_empty() for m in matchers):
        raise QueryError("a selector needs a matcher that doesn't match the empty string")


def parse_matcher(text: str) -> Matcher:
    m = re.fullmatch(r'\s*([a-zA-Z_:][\w:]*)\s*(=~|!~|!=|=)\s*"?(.*?)"?\s*', text, re.S)
    if not m:
        raise QueryError(f"not a matcher: {text!r}")
    return Matcher(m[1], m[2], m[3])


def quoted_alternation(values) -> str:
    """An expression that matches just these values."""
    return "|".join("".join("\\" + c if c in _META else c for c in v) for v in values)
