"""Arithmetic and comparisons with IEEE rules, which SQL's differ from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import INF, NAN


def _double(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def div(a: Column, b: Column) -> Column:
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, NAN).otherwise(F.try_mod(a, b))


ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": div,
    "%": mod,
    "^": F.pow,
    "atan2": F.atan2,
}


def arithmetic(op: str, a, b) -> Column:
    return ARITHMETIC[op](_double(a), _double(b))


def compare(op: str, a, b) -> Column:
    """NaN equals nothing and is in no order."""
    a, b = _double(a), _double(b)
    number = ~F.isnan(a) & ~F.isnan(b)
    if op == "!=":
        return ~number | (a != b)
    return number & {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def nan_max(value: Column) -> Column:
    """The greatest number; NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.max(value))


def nan_min(value: Column) -> Column:
    """The least number; NaN only if there is nothing else (NaN sorts last)."""
    return F.min(value)


def log(value: Column, base: float | None = None) -> Column:
    """The logarithm with -Inf at 0 and NaN below."""
    safe = F.when(value > 0, value)
    out = F.ln(safe) if base is None else (F.log2(safe) if base == 2 else F.log10(safe))
    return F.when(F.isnan(value) | (value < 0), NAN).when(value == 0, -INF).otherwise(out)


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < INF)


def whole(value: Column, how) -> Column:
    """floor or ceil as a double; values without a fraction, and NaN and Inf, as they are."""
    return F.when(is_finite(value) & (F.abs(value) < 2.0**53), how(F.when(is_finite(value) & (F.abs(value) < 2.0**53), value)).cast("double")).otherwise(value)


def round_to(value: Column, to=1.0) -> Column:
    """To the nearest multiple of ``to``, halves up."""
    inverse = div(F.lit(1.0), _double(to))
    return div(whole(value * inverse + 0.5, F.floor), inverse)


def format_float(value: Column) -> Column:
    """The shortest decimal text without exponent."""
    small = F.abs(value) < 1e15
    whole_number = F.when(is_finite(value) & small, value)
    text = value.cast("string")
    plain = F.regexp_replace(F.regexp_replace(F.when(is_finite(value) & (F.abs(value) < 1e18), value).cast("decimal(38,19)").cast("string"), r"0+$", ""), r"\.$", "")
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == INF, "+Inf")
        .when(value == -INF, "-Inf")
        .when(small & (value == F.floor(whole_number).cast("double")), F.floor(whole_number).cast("string"))
        .when(text.contains("E"), F.coalesce(plain, text))
        .otherwise(text)
    )
