"""The events and lineitem tables as stores of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NAME, Store, labels_key


def table_store(rows: DataFrame, metric: str, labels: Sequence[str], ts: Column, value: Column) -> Store:
    """A store whose series are the combinations of some columns; ids are hashes, so no numbering is needed."""
    series_id = F.xxhash64(*labels)
    pairs = [F.lit(NAME), F.lit(metric), *(x for c in labels for x in (F.lit(c), F.col(c).cast("string")))]
    # integral division of microseconds, as the oracle does it
    ms = F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")
    series = rows.select(*labels).distinct().select(series_id.alias("series_id"), F.create_map(*pairs).alias("labels"))
    samples = rows.select(series_id.alias("series_id"), ms.alias("ts_ms"), value.cast("double").alias("value"), F.lit(False).alias("is_stale"))
    return Store(series=series.withColumn("labels_key", labels_key(F.col("labels"))), samples=samples, merged=True)


def events_store(spark: SparkSession, sf_dir: str, labels: Sequence[str] = ("event_type",), metric: str = "events") -> Store:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table_store(spark.read.parquet(f"{sf_dir}/events.parquet"), metric, labels, F.col("ts"), F.col("value"))
