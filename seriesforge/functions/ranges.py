"""Functions over the samples of a window: one native aggregation per (series, step).

Rows are samples with ``ts_ms, value, prev_ts_ms, prev_value, step_ms`` and ``at_ms``,
the window's end; the window is (at_ms - range, at_ms].
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INF, NAN
from . import ieee



def _value() -> Column:
    return F.col("value")


def _ts() -> Column:
    return F.col("ts_ms")


#: Sees both samples of a pair in the window.
NEEDS_PREVIOUS = {"rate", "increase", "resets", "changes"}


@dataclass(frozen=True)
class Window:
    """The range and the window end, a column of each group."""

    range_ms: int
    at_ms: Column


def _in_window(w: Window) -> Column:
    return F.col("prev_ts_ms").isNotNull() & (F.col("prev_ts_ms") > w.at_ms - w.range_ms)


def _first(c: Column) -> Column:
    return F.min_by(c, _ts())


def _last(c: Column) -> Column:
    return F.max_by(c, _ts())


def extrapolate(w: Window, n: Column, first_ts: Column, last_ts: Column, first: Column, last: Column, resets: Column | None, per_second: bool) -> Column:
    """The gain between the first and last sample, stretched towards the window's edges; with ``resets`` it is a counter's."""
    at = F.min(w.at_ms)
    seconds = lambda c: c.cast("double") / 1000.0
    gained = last - first if resets is None else last - first + resets
    sampled = seconds(last_ts - first_ts)
    average = sampled / F.greatest(n - 1, F.lit(1)).cast("double")
    to_start, to_end = seconds(first_ts - (at - w.range_ms)), seconds(at - last_ts)
    limit = average * 1.1
    to_start = F.when(to_start >= limit, average / 2).otherwise(to_start)
    if resets is not None:  # a counter can't have been below zero
        zero = sampled * F.try_divide(first, gained)
        to_start = F.when((gained > 0) & (first >= 0) & (zero < to_start), zero).otherwise(to_start)
    to_end = F.when(to_end >= limit, average / 2).otherwise(to_end)
    factor = F.try_divide(sampled + to_start + to_end, sampled)
    if per_second:
        factor = factor / (w.range_ms / 1000.0)
    return F.when((n >= 2) & (sampled > 0), gained * factor)


def _extrapolated(counter: bool, per_second: bool) -> Callable[[Window], Column]:
    def of(w: Window) -> Column:
        fell = F.sum(F.when(_in_window(w) & (_value() < F.col("prev_value")), F.col("prev_value")))
        resets = F.coalesce(fell, F.lit(0.0)) if counter else None
        return extrapolate(w, F.count(_value()), F.min(_ts()), F.max(_ts()), _first(_value()), _last(_value()), resets, per_second)

    return of


def _instant(per_second: bool) -> Callable[[Window], Column]:
    """From the two last samples."""
    def of(w: Window) -> Column:
        pair = F.max_by(F.struct("ts_ms", "value", "prev_ts_ms", "prev_value"), _ts())
        step = (pair["ts_ms"] - pair["prev_ts_ms"]).cast("double") / 1000.0
        inside = pair["prev_ts_ms"] > F.min(w.at_ms) - w.range_ms
        if per_second:
            gained = F.when(pair["value"] < pair["prev_value"], pair["value"]).otherwise(pair["value"] - pair["prev_value"])
            return F.when(inside & (step > 0), F.try_divide(gained, step))
        return F.when(inside, pair["value"] - pair["prev_value"])

    return of


def _regression(w: Window) -> tuple[Column, Column]:
    """Slope and the value at the window's end, times in seconds from there."""
    x = (_ts() - w.at_ms).cast("double") / 1000.0
    constant = F.min(_value()) == F.max(_value())
    slope = F.when(constant, 0.0).otherwise(F.regr_slope(_value(), x))
    level = F.when(constant, F.min(_value())).otherwise(F.regr_intercept(_value(), x))
    return F.when(F.count(_value()) >= 2, slope), F.when(F.count(_value()) >= 2, level)


def predict_linear(w: Window, seconds: Column) -> Column:
    slope, level = _regression(w)
    return level + slope * seconds


def quantile(phi: float, value: Column | None = None) -> Column:
    """Linear interpolation between ranks; infinite outside 0 to 1."""
    if phi != phi:
        return F.max(F.lit(NAN))
    if phi < 0 or phi > 1:
        return F.max(F.lit(-INF if phi < 0 else INF))
    return F.percentile(_value() if value is None else value, F.lit(phi))


def distances(rows: DataFrame) -> DataFrame:
    """The rows of windows by distinct value: its count ``n`` and its distance from the window's median."""
    labels = [F.any_value("labels").alias("labels")] if "labels" in rows.columns else []
    counts = rows.groupBy("series_id", "step_ms", "value").agg(F.count("value").alias("n"), *labels)
    medians = counts.groupBy("series_id", "step_ms").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("median"))
    return counts.join(medians, ["series_id", "step_ms"]).withColumn("distance", F.abs(_value() - F.col("median")))


def mad(_: Window) -> Column:
    """Median of the distances from the median."""
    return F.percentile("distance", F.lit(0.5), F.col("n"))


def double_exponential(smoothing: float, trend: float) -> Callable[[Window], Column]:
    """Holt-Winters without seasons, over the samples in time order."""
    def of(_: Window) -> Column:
        values = F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))), lambda x: x["value"])
        start = F.struct(F.get(values, 0).alias("level"), (F.get(values, 1) - F.get(values, 0)).alias("slope"))

        def step(state: Column, x: Column) -> Column:
            level = smoothing * x + (1 - smoothing) * (state["level"] + state["slope"])
            slope = trend * (level - state["level"]) + (1 - trend) * state["slope"]
            return F.struct(level.alias("level"), slope.alias("slope"))

        out = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step, lambda s: s["level"])
        return F.when(F.count(_value()) >= 2, out)

    return of


#: name -> aggregate of a window; null means no result at this step.
FUNCTIONS: dict[str, Callable[[Window], Column]] = {
    "avg_over_time": lambda w: F.avg(_value()),
    "min_over_time": lambda w: ieee.nan_min(_value()),
    "max_over_time": lambda w: ieee.nan_max(_value()),
    "sum_over_time": lambda w: F.sum(_value()),
    "count_over_time": lambda w: F.count(_value()).cast("double"),
    "stddev_over_time": lambda w: F.stddev_pop(_value()),
    "stdvar_over_time": lambda w: F.var_pop(_value()),
    "last_over_time": lambda w: _last(_value()),
    "first_over_time": lambda w: _first(_value()),
    "present_over_time": lambda w: F.max(F.lit(1.0)),
    "mad_over_time": mad,
    "ts_of_last_over_time": lambda w: F.max(_ts()).cast("double") / 1000.0,
    "rate": _extrapolated(True, True),
    "increase": _extrapolated(True, False),
    "delta": _extrapolated(False, False),
    "irate": _instant(True),
    "idelta": _instant(False),
    "deriv": lambda w: _regression(w)[0],
    "resets": lambda w: F.coalesce(F.sum(F.when(_in_window(w) & (_value() < F.col("prev_value")), 1.0)), F.lit(0.0)),
    "changes": lambda w: F.coalesce(F.sum(F.when(_in_window(w) & (_value() != F.col("prev_value")), 1.0)), F.lit(0.0)),
}
KEEPS_NAME = {"last_over_time", "first_over_time"}
NEEDS_PREVIOUS |= {"irate", "idelta"}
#: Sees values with their distance from the window's median.
NEEDS_DISTANCES = {"mad_over_time"}
