"""Five-minute rollup: min, max, avg and count of each series and bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..model import DAY_MS, NAN, ROLLUP_MS

#: Which rollup column stands for the samples under a function; all others use the average.
COLUMN_OF = {
    "min": "min", "min_over_time": "min",
    "max": "max", "max_over_time": "max", "rate": "max", "irate": "max", "increase": "max", "resets": "max",
    "count": "cnt", "count_over_time": "cnt",
}
#: Days are split in so many shards by series id, and are rolled up once they ended this long ago.
SHARDS, DELAY_MS = 60, 8 * 3_600_000


def bucket(ts, resolution_ms: int = ROLLUP_MS):
    return ts - F.pmod(ts, F.lit(resolution_ms))


def rollup(samples: DataFrame, resolution_ms: int = ROLLUP_MS) -> DataFrame:
    """(series_id, bucket_ms, min, max, avg, cnt). Stale samples don't count; min and max pass over NaN unless
    all values are, avg is NaN if any is."""
    value = F.col("value")
    return (
        samples.where("NOT is_stale")
        .groupBy("series_id", bucket(F.col("ts_ms"), resolution_ms).alias("bucket_ms"))
        .agg(ieee.nan_min(value).alias("min"), ieee.nan_max(value).alias("max"), F.avg(value).alias("avg"), F.count(value).cast("double").alias("cnt"))
    )


def merge(parts: DataFrame) -> DataFrame:
    """Rollup rows of one bucket from several parts, such as hot and cold, as one."""
    weighted = F.sum(F.col("avg") * F.col("cnt"))
    total = F.sum("cnt")
    return parts.groupBy("series_id", "bucket_ms").agg(ieee.nan_min(F.col("min")).alias("min"), ieee.nan_max(F.col("max")).alias("max"), F.when(total > 0, F.try_divide(weighted, total)).otherwise(NAN).alias("avg"), total.alias("cnt"))


def as_samples(rolled: DataFrame, function: str) -> DataFrame:
    """The rollup column that stands for the function, as samples at the buckets' starts."""
    return rolled.select("series_id", F.col("bucket_ms").alias("ts_ms"), F.col(COLUMN_OF.get(function, "avg")).alias("value"), F.lit(False).alias("is_stale"))


def with_function(samples: DataFrame, function: str, resolution_ms: int = ROLLUP_MS) -> DataFrame:
    """Samples aggregated to the resolution under a function."""
    return as_samples(rollup(samples, resolution_ms), function)


def day_range(from_ms: int, to_ms: int) -> tuple[int, int]:
    """Whole days from the first to the last named, as a half-open range."""
    return from_ms - from_ms % DAY_MS, to_ms - to_ms % DAY_MS + DAY_MS


def rollup_days(samples: DataFrame, from_ms: int, to_ms: int, ids: DataFrame | None = None) -> DataFrame:
    """The rollup of whole days, of all series or of the ids given; with its day, for a partitioned rewrite."""
    low, high = day_range(from_ms, to_ms)
    chosen = samples.where((F.col("ts_ms") >= low) & (F.col("ts_ms") < high))
    if ids is not None:
        chosen = chosen.join(ids.select("series_id").distinct(), "series_id", "left_semi")
    return rollup(chosen).withColumn("day_ms", F.col("bucket_ms") - F.pmod("bucket_ms", F.lit(DAY_MS)))


def due_days(day_ms: int, now_ms: int) -> bool:
    """Whether a day can be rolled up: it ended more than the delay ago."""
    return day_ms + DAY_MS + DELAY_MS < now_ms


def rollup_shard(samples: DataFrame, shard: int, day_ms: int, shards: int = SHARDS) -> DataFrame:
    """One unit of the daily job: a day of the series of one shard."""
    return rollup_days(samples.where(F.pmod("series_id", F.lit(shards)) == shard), day_ms, day_ms)
