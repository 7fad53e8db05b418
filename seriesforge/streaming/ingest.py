"""Streams of samples: hot buffer, flush and the five-minute rollup.

Input rows are (series_id, ts, value, is_stale) with ``ts`` a timestamp.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions import ieee
from ..operators.dedup import dedup_samples, flush_time_s
from ..sources.samples import write_samples

#: Later than this, samples are stored but no longer rolled up.
LATE = "8 hours"
BUCKET = "5 minutes"


def streaming_rollup(samples: DataFrame, late: str = LATE) -> DataFrame:
    """(series_id, bucket_ms, min, max, avg, cnt) of a stream; buckets are final once the watermark has passed them.

    The state is the mergeable parts of each bucket, so late samples within the delay count.
    """
    value = F.col("value")
    rolled = (
        samples.where("NOT is_stale")
        .withWatermark("ts", late)
        .groupBy("series_id", F.window("ts", BUCKET))
        .agg(ieee.nan_min(value).alias("min"), ieee.nan_max(value).alias("max"), F.avg(value).alias("avg"), F.count(value).cast("double").alias("cnt"))
    )
    return rolled.select("series_id", F.unix_millis("window.start").alias("bucket_ms"), "min", "max", "avg", "cnt")


def append_hot(samples: DataFrame, hot_path: str, checkpoint: str, trigger: str = "15 seconds") -> DataStreamWriter:
    """Each micro-batch as one idempotent folder of the hot buffer: a batch that is run again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("series_id", F.unix_millis("ts").alias("ts_ms"), "value", "is_stale").withColumn("seq", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(f"{hot_path}/batch={batch_id}")

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=trigger)


def flush_due(hot: DataFrame, now_s: int, batch_s: int = 900) -> DataFrame:
    """Hot samples whose series is due: spread by id over a batch, or with more samples than seconds in one."""
    state = hot.groupBy("series_id").agg(F.min("ts_ms").alias("first_ms"), F.count(F.lit(1)).alias("n"))
    due = state.where((flush_time_s(F.col("series_id"), F.floor(F.col("first_ms") / 1000), batch_s) <= now_s) | (F.col("n") > batch_s))
    return hot.join(due.select("series_id"), "series_id", "left_semi")


def flush(hot: DataFrame, cold_path: str, now_s: int, batch_s: int = 900, write: Callable[[DataFrame, str], None] = write_samples) -> DataFrame:
    """Writes the due samples that are older than one batch, one for each time, and returns what stays hot: newer points and the series not due.

    A sample is written when it leaves the buffer, and only then; a flush that is run again
    repeats its rows, which reads merge.
    """
    old = F.col("ts_ms") <= (now_s - batch_s) * 1000
    due = flush_due(hot, now_s, batch_s)
    write(dedup_samples(due.where(old), "seq" if "seq" in hot.columns else None), cold_path)
    waiting = hot.join(due.select("series_id").distinct(), "series_id", "left_anti").where(old)
    return hot.where(~old).unionByName(waiting)


def start_rollup(samples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The rollup as a file sink, exactly once."""
    return streaming_rollup(samples).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
