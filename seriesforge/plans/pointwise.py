"""Expressions whose vectors all come from one selector: one read and a chain of columns, no join on labels.

``ln(events) + sqrt(events) * 2`` matches each series with itself, so both sides stand in the same row.
This holds where the selector fixes the metric's name (label sets stay unique when the name goes) and where
operators match on all labels and keep every row: arithmetic, ``bool`` comparisons and functions of values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.scalar import DATES, MATH, clamp
from . import parser as P


def selector_of(node, fold: Callable) -> P.Selector | None:
    """The one selector that an expression reads, if it can be evaluated in columns."""
    found: set[P.Selector] = set()
    if _walk(node, found, fold) and len(found) == 1:
        return next(iter(found))
    return None


def _walk(node, found: set, fold: Callable) -> bool:
    match node:
        case P.Number():
            return True
        case P.Selector():
            if node.range_ms is not None or not node.name:
                return False
            found.add(node)
            return True
        case P.Unary(_, e):
            return _walk(e, found, fold)
        case P.Binary(op, left, right, bool_, matching):
            plain = matching == P.Matching() and op not in P.SET_OPS and (bool_ or op not in P.COMPARISONS)
            return plain and _walk(left, found, fold) and _walk(right, found, fold)
        case P.Call("time" | "pi", ()):
            return True
        case P.Call("timestamp", (P.Selector() as s,)):
            return _walk(s, found, fold)
        case P.Call(name, args) if args and _is_vector(args[0]):
            if (name in MATH or name in DATES) and len(args) == 1:
                return _walk(args[0], found, fold)
            bounds = [fold(a) for a in args[1:]]
            if None in bounds:
                return False
            counted = {"round": (0, 1), "clamp": (2,), "clamp_min": (1,), "clamp_max": (1,)}.get(name, ())
            empty = name == "clamp" and len(bounds) == 2 and bounds[0] > bounds[1]  # gives no rows
            return len(bounds) in counted and not empty and _walk(args[0], found, fold)
    return False


def _is_vector(node) -> bool:
    """Whether the expression reads a selector; functions of vectors refuse scalars."""
    match node:
        case P.Selector():
            return True
        case P.Unary(_, e):
            return _is_vector(e)
        case P.Binary(_, left, right):
            return _is_vector(left) or _is_vector(right)
        case P.Call(name, args) if name not in ("time", "pi"):
            return any(_is_vector(a) for a in args)
    return False


def evaluate(df: DataFrame, node, fold: Callable) -> tuple[DataFrame, Column]:
    """df has (value, ts, step_ms): adds a column for each operation, so no expression is repeated in another."""

    def add(df: DataFrame, value: Column) -> tuple[DataFrame, Column]:
        name = f"x{len(df.columns)}"
        return df.withColumn(name, value.cast("double")), F.col(name)

    match node:
        case P.Number(value):
            return df, F.lit(float(value))
        case P.Selector():
            return df, F.col("value")
        case P.Unary(_, e):
            df, a = evaluate(df, e, fold)
            return add(df, -a)
        case P.Binary(op, left, right):
            df, a = evaluate(df, left, fold)
            df, b = evaluate(df, right, fold)
            return add(df, ieee.compare(op, a, b) if op in P.COMPARISONS else ieee.arithmetic(op, a, b))
        case P.Call("time", ()):
            return df, F.col("step_ms").cast("double") / 1000.0
        case P.Call("pi", ()):
            return df, F.lit(fold(node))
        case P.Call("timestamp", _):
            return df, F.col("ts")
    name = node.func
    df, a = evaluate(df, node.args[0], fold)
    bounds = [fold(x) for x in node.args[1:]]
    if name == "round":
        return add(df, ieee.round_to(a, bounds[0] if bounds else 1.0))
    if name.startswith("clamp"):
        low, high = {"clamp": lambda: bounds, "clamp_min": lambda: (bounds[0], None), "clamp_max": lambda: (None, bounds[0])}[name]()
        return add(df, clamp(a, None if low is None else F.lit(low), None if high is None else F.lit(high)))
    return add(df, (MATH.get(name) or DATES[name])(a))
