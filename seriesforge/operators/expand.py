"""Samples to evaluation steps without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Grid


def with_previous(rows: DataFrame) -> DataFrame:
    """Adds to the rows of a window the sample before within the same window.

    The aggregation by series and step that follows needs no further shuffle, and no task
    sees more of a series than a window.
    """
    w = W.partitionBy("series_id", "step_ms").orderBy("ts_ms")
    return rows.withColumns({"prev_ts_ms": F.lag("ts_ms").over(w), "prev_value": F.lag("value").over(w)})


def expand(samples: DataFrame, grid: Grid, range_ms: int, offset_ms: int = 0) -> DataFrame:
    """A row for each sample and step whose window (at - range, at] holds it; at = step - offset.

    Adds step_ms and at_ms. A sample is repeated about range / step times.
    """
    start = grid.start_ms - offset_ms
    last = start + (grid.count - 1) * grid.step_ms
    inside = samples.where((F.col("ts_ms") > start - range_ms) & (F.col("ts_ms") <= last))
    if grid.count == 1:
        return inside.withColumns({"step_ms": F.lit(grid.start_ms).cast("long"), "at_ms": F.lit(start).cast("long")})
    step, ts = grid.step_ms, F.col("ts_ms")
    # whole-number division rounding up, also below zero
    up = lambda x: (x + F.lit(step - 1) - F.pmod(x + F.lit(step - 1), F.lit(step))) / F.lit(step)
    low = F.greatest(F.lit(0), up(ts - start).cast("long"))
    high = F.least(F.lit(grid.count - 1), (up(ts + F.lit(range_ms) - start) - 1).cast("long"))
    out = inside.withColumn("low", low).withColumn("high", high).where("high >= low")
    out = out.withColumn("k", F.explode(F.sequence("low", "high"))).drop("low", "high")
    return out.withColumns({"step_ms": F.lit(grid.start_ms) + F.col("k") * step, "at_ms": F.lit(start) + F.col("k") * step}).drop("k")
