"""Range functions by panes: samples are aggregated once to stretches that windows consist of.

Where windows overlap, a sample lies in range / step of them. A pane is as long as the greatest common
divisor of range and step, so each window is a whole number of panes and only panes are repeated.
Rows of panes are (series_id, ts_ms, ...) with ts_ms the pane's end: (ts_ms - pane, ts_ms].
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Grid
from . import ieee, ranges

#: Shorter panes would hold hardly more than a sample.
LEAST_MS = 60_000


@dataclass(frozen=True)
class Paned:
    """Aggregates of a pane's samples, and of a window's panes."""

    parts: Callable[[], dict[str, Column]]
    whole: Callable[[ranges.Window], Column]
    pairs: bool = False


def _simple(part: Callable[[Column], Column], whole: Callable[[Column], Column]) -> Paned:
    return Paned(lambda: {"value": part(F.col("value"))}, lambda _: whole(F.col("value")))


_sum = lambda c: F.coalesce(F.sum(c), F.lit(0.0))


def _pairs(event: Callable[[Column, Column], Column], amount: Callable[[Column], Column], whole: Callable[[ranges.Window, Column], Column]) -> Paned:
    """With what pairs of neighbours add up to: inside a pane, and between it and the one before."""

    def parts() -> dict[str, Column]:
        at = F.struct(F.col("ts_ms").alias("ts_ms"), F.col("value").alias("value"))
        before = F.col("prev_value")
        inside = _sum(F.when(F.col("prev_ts_ms").isNotNull() & event(before, F.col("value")), amount(before)))
        return {"inside": inside, "n": F.count("value"), "first": F.min_by(at, F.col("ts_ms")), "last": F.max_by(at, F.col("ts_ms"))}

    def of(w: ranges.Window) -> Column:
        before = F.col("before.value")
        edge = F.when((F.col("before.ts_ms") > w.at_ms - w.range_ms) & event(before, F.col("first.value")), amount(before))
        return whole(w, F.sum("inside") + _sum(edge))

    return Paned(parts, of, pairs=True)


def _rate(counter: bool, per_second: bool) -> Callable[[ranges.Window, Column], Column]:
    def of(w: ranges.Window, resets: Column) -> Column:
        first, last = F.min_by(F.col("first"), F.col("ts_ms")), F.max_by(F.col("last"), F.col("ts_ms"))
        return ranges.extrapolate(w, F.sum("n"), first["ts_ms"], last["ts_ms"], first["value"], last["value"], resets if counter else None, per_second)

    return of


_fell = lambda before, now: now < before
_changed = lambda before, now: now != before
_one = lambda _: F.lit(1.0)
_same = lambda before: before

PANED: dict[str, Paned] = {
    "sum_over_time": _simple(F.sum, F.sum),
    "count_over_time": _simple(lambda c: F.count(c).cast("double"), F.sum),
    "min_over_time": _simple(ieee.nan_min, ieee.nan_min),
    "max_over_time": _simple(ieee.nan_max, ieee.nan_max),
    "avg_over_time": Paned(lambda: {"value": F.sum("value"), "n": F.count("value")}, lambda _: F.try_divide(F.sum("value"), F.sum("n"))),
    "present_over_time": _simple(lambda _: F.max(F.lit(1.0)), F.max),
    "last_over_time": _simple(lambda c: F.max_by(c, F.col("ts_ms")), lambda c: F.max_by(c, F.col("ts_ms"))),
    "first_over_time": _simple(lambda c: F.min_by(c, F.col("ts_ms")), lambda c: F.min_by(c, F.col("ts_ms"))),
    "rate": _pairs(_fell, _same, _rate(True, True)),
    "increase": _pairs(_fell, _same, _rate(True, False)),
    "delta": _pairs(_fell, _same, _rate(False, False)),
    "resets": _pairs(_fell, _one, lambda _, n: n),
    "changes": _pairs(_changed, _one, lambda _, n: n),
}


def pane_ms(function: str, grid: Grid, range_ms: int) -> int | None:
    """The length of a pane, or None where each sample may as well go to its windows."""
    if function not in PANED or grid.count == 1 or range_ms <= grid.step_ms:
        return None
    pane = math.gcd(range_ms, grid.step_ms)
    return pane if pane >= LEAST_MS else None


def to_panes(samples: DataFrame, function: str, grid: Grid, offset_ms: int, pane: int) -> DataFrame:
    """A row for each series and pane with samples. Neighbours meet within a pane; across panes each gets its predecessor's last sample."""
    kind = PANED[function]
    after = F.pmod(F.col("ts_ms") - F.lit(grid.start_ms - offset_ms), F.lit(pane))
    rows = samples.withColumn("pane_ms", F.when(after == 0, F.col("ts_ms")).otherwise(F.col("ts_ms") - after + F.lit(pane)))
    if kind.pairs:
        w = W.partitionBy("series_id", "pane_ms").orderBy("ts_ms")
        rows = rows.withColumns({"prev_ts_ms": F.lag("ts_ms").over(w), "prev_value": F.lag("value").over(w)})
    out = rows.groupBy("series_id", "pane_ms").agg(*(c.alias(name) for name, c in kind.parts().items())).withColumnRenamed("pane_ms", "ts_ms")
    if kind.pairs:
        out = out.withColumn("before", F.lag("last").over(W.partitionBy("series_id").orderBy("ts_ms")))
    return out
