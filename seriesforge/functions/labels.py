"""label_replace and label_join."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import QueryError, label
from ..plans.matchers import check_regex
from ..plans.parser import LABEL_NAME


def _set(labels: Column, name: str, value: Column) -> Column:
    """labels with name set to value; an empty value removes it."""
    rest = F.map_filter(labels, lambda k, _: k != name)
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def check_name(name: str) -> None:
    if not LABEL_NAME.fullmatch(name):
        raise QueryError(f"invalid label name {name!r}")


def label_replace(labels: Column, target: str, template: str, source: str, pattern: str) -> Column:
    """Sets target to the template's expansion where the whole source value matches."""
    check_name(target)
    check_regex(pattern)
    anchored = f"^(?s:{pattern})\\z"
    value = label(labels, source)
    groups = re.compile(pattern).groups
    names = re.compile(pattern).groupindex
    parts = []
    for text, braced, plain in re.findall(r"([^$]+)|\$\{(\w+)\}|\$(\w+)", template.replace("$$", "\0")):
        group = braced or plain
        if text:
            parts.append(F.lit(text.replace("\0", "$")))
        elif group.isdigit() and int(group) <= groups:
            parts.append(F.regexp_extract(value, anchored, int(group)))
        elif group in names:
            parts.append(F.regexp_extract(value, anchored.replace("(?P<", "(?<"), names[group]))
    expanded = F.concat(*parts) if parts else F.lit("")
    return F.when(value.rlike(anchored.replace("(?P<", "(?<")), _set(labels, target, expanded)).otherwise(labels)


def label_join(labels: Column, target: str, separator: str, sources: list[str]) -> Column:
    check_name(target)
    for s in sources:
        check_name(s)
    joined = F.concat_ws(separator, *(label(labels, s) for s in sources)) if sources else F.lit("")
    return _set(labels, target, joined)
