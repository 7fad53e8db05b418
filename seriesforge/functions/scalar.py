"""Functions of one value: mathematics, clamping, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import INF, NAN
from . import ieee


def _date(part):
    """A part of the UTC date of a value in seconds; NaN stays NaN."""
    def of(value: Column) -> Column:
        fits = ieee.is_finite(value) & (F.abs(value) < 2.5e11)
        moment = F.timestamp_seconds(F.floor(F.when(fits, value)))
        return F.when(fits, part(moment).cast("double")).otherwise(NAN)

    return of


def _keep_nan(f):
    return lambda v: F.when(F.isnan(v), NAN).otherwise(f(v))


def _inside(f, low: float, high: float):
    """NaN outside [low, high]."""
    return lambda v: F.when((v >= low) & (v <= high) & ~F.isnan(v), f(v)).otherwise(NAN)


#: Functions of one vector that only change its values.
MATH = {
    "abs": F.abs,
    "ceil": lambda v: ieee.whole(v, F.ceil),
    "floor": lambda v: ieee.whole(v, F.floor),
    "exp": F.exp,
    "sqrt": F.sqrt,
    "ln": ieee.log,
    "log2": lambda v: ieee.log(v, 2),
    "log10": lambda v: ieee.log(v, 10),
    "sgn": _keep_nan(lambda v: F.signum(v)),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": _inside(F.asin, -1, 1),
    "acos": _inside(F.acos, -1, 1),
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": _inside(F.acosh, 1, INF),
    "atanh": lambda v: F.when(v == 1, INF).when(v == -1, -INF).otherwise(_inside(F.atanh, -1, 1)(v)),
    "deg": F.degrees,
    "rad": F.radians,
}

DATES = {
    "minute": _date(F.minute),
    "hour": _date(F.hour),
    "day_of_week": _date(lambda t: F.dayofweek(t) - 1),
    "day_of_month": _date(F.dayofmonth),
    "day_of_year": _date(F.dayofyear),
    "days_in_month": _date(lambda t: F.dayofmonth(F.last_day(t))),
    "month": _date(F.month),
    "year": _date(F.year),
}


def clamp(value: Column, low: Column | None, high: Column | None) -> Column:
    """NaN in any argument gives NaN."""
    out = value
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    if high is not None:
        out = F.when(F.isnan(out), out).when(out > high, high).otherwise(out)
    for bound in (low, high):
        if bound is not None:
            out = F.when(F.isnan(bound), NAN).otherwise(out)
    return F.when(F.isnan(value), NAN).otherwise(out)
