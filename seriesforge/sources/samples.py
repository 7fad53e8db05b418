"""Samples in files: partitioned storage, fixed-schema Parquet, JSON query results, CSV dumps; ingest of raw rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DAY_MS, LABELS, RAW_PARTITION_DAYS, ROLLUP_PARTITION_DAYS, labels_key
from .wide import apply_nan_policy

#: The bits of the NaN that marks the end of a series.
STALE_BITS = 0x7FF0000000000002
FIXED = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("labels", LABELS), T.StructField("value", T.DoubleType())])
QUERY_RESULT = "status string, data struct<resultType: string, result: array<struct<metric: map<string,string>, values: array<array<string>>, value: array<string>>>>"


# -- ingest


def mark_stale(df: DataFrame) -> DataFrame:
    """Adds is_stale from the bits of the value; the one place where they are read, as SQL merges all NaNs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("value").fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8").view("<u8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits == STALE_BITS)], names=[*batch.schema.names, "is_stale"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("is_stale", T.BooleanType())]))


def prepare_write(rows: DataFrame, tenant: str | None = None, tenant_label: str = "__account_id", virtual: tuple[str, ...] = ()) -> DataFrame:
    """rows(labels, ...) as they are stored: the tenant's label set, virtual and empty labels dropped; bad names refused.

    Names may not hold '|'; label values aren't checked.
    """
    labels = F.map_filter("labels", lambda k, v: (F.coalesce(v, F.lit("")) != "") & ~k.isin(*virtual, *([tenant_label] if tenant else [])))
    if tenant:
        labels = F.map_concat(labels, F.create_map(F.lit(tenant_label), F.lit(tenant)))
    bad = F.exists(F.map_keys("labels"), lambda k: k.contains("|") | (k == "")) | F.coalesce(F.try_element_at("labels", F.lit("__name__")), F.lit("")).contains("|")
    checked = F.when(bad, F.raise_error(F.lit("invalid label name")).cast(LABELS)).otherwise(labels)
    return rows.withColumn("labels", checked).withColumn("labels_key", labels_key(F.col("labels")))


# -- partitioned storage


def base_day5(ts_ms):
    width = RAW_PARTITION_DAYS * DAY_MS
    return ts_ms - F.pmod(ts_ms, F.lit(width))


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by five-day partitions, sorted by series and time in each file.

    Rows are dealt by partition and a salt of the series, so that one partition isn't one task.
    """
    keyed = samples.withColumn("base_day5", base_day5(F.col("ts_ms")))
    dealt = keyed.repartition("base_day5", F.pmod(F.xxhash64("series_id"), F.lit(64))).sortWithinPartitions("base_day5", "series_id", "ts_ms")
    dealt.write.mode(mode).partitionBy("base_day5").option("compression", "zstd").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_rollup(rolled: DataFrame, path: str) -> None:
    """Replaces the 80-day partitions that the rows touch; a rewrite of one needs all its rows."""
    width = ROLLUP_PARTITION_DAYS * DAY_MS
    keyed = rolled.withColumn("base_day80", F.col("bucket_ms") - F.pmod("bucket_ms", F.lit(width)))
    dealt = keyed.repartition("base_day80", F.pmod(F.xxhash64("series_id"), F.lit(64))).sortWithinPartitions("series_id", "bucket_ms")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("base_day80").parquet(path)


# -- exchange


def to_fixed(samples: DataFrame, series: DataFrame, policy: str = "keep") -> DataFrame:
    """(timestamp, labels, value)."""
    named = apply_nan_policy(samples, policy).join(series.select("series_id", "labels"), "series_id")
    return named.select(F.col("ts_ms").alias("timestamp"), "labels", "value")


def from_fixed(rows: DataFrame, start_ms: int | None = None, end_ms: int | None = None, policy: str = "keep") -> DataFrame:
    out = rows
    if start_ms is not None:
        out = out.where(F.col("timestamp") >= start_ms)
    if end_ms is not None:
        out = out.where(F.col("timestamp") <= end_ms)
    long = out.select("labels", labels_key(F.col("labels")).alias("labels_key"), F.col("timestamp").alias("ts_ms"), "value", F.lit(False).alias("is_stale"))
    return apply_nan_policy(long, policy)


def export_batches(start_ms: int, end_ms: int, batch_ms: int = DAY_MS) -> list[tuple[int, int]]:
    """Half-open batches of a range, so that no sample is in two."""
    return [(at, min(at + batch_ms, end_ms)) for at in range(start_ms, end_ms, batch_ms)]


def from_query_json(df: DataFrame, ignore_labels: tuple[str, ...] = (), add_ms: int = 0) -> DataFrame:
    """Samples of query results (matrix or vector): rows of QUERY_RESULT."""
    series = df.select(F.explode("data.result").alias("r"))
    points = F.concat(F.coalesce("r.values", F.array().cast("array<array<string>>")), F.when(F.col("r.value").isNotNull(), F.array("r.value")).otherwise(F.array().cast("array<array<string>>")))
    rows = series.select("r.metric", F.explode(points).alias("p"))
    labels = F.map_filter("metric", lambda k, _: ~k.isin(*ignore_labels))
    text = F.get("p", 1)
    value = F.when(text == "NaN", float("nan")).when(text.isin("+Inf", "Inf"), float("inf")).when(text == "-Inf", float("-inf")).otherwise(F.expr("try_cast(get(p, 1) AS double)"))
    ms = F.round(F.get("p", 0).cast("double") * 1000).cast("long") + F.lit(add_ms)
    out = rows.select(labels.alias("labels"), ms.alias("ts_ms"), value.alias("value"))
    return out.select("labels", labels_key(F.col("labels")).alias("labels_key"), "ts_ms", "value", F.lit(False).alias("is_stale"))


def read_query_json(spark: SparkSession, path: str, **options) -> DataFrame:
    return from_query_json(spark.read.schema(QUERY_RESULT).json(path), **options)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def stale_value() -> float:
    return float(np.array([STALE_BITS], dtype="<u8").view("<f8")[0])
