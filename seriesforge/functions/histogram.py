"""histogram_quantile over classic ``le`` buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INF, NAME, NAN, drop_labels, label, with_labels


def _upper(le: Column) -> Column:
    return F.when(F.lower(le).isin("+inf", "inf"), INF).otherwise(F.expr("try_cast(le_text AS DOUBLE)"))


def _interpolated(phi: Column, buckets: Column) -> Column:
    """buckets: array of struct(le, n), sorted by le, n rising."""
    last = F.size(buckets) - 1
    total = F.get(buckets, last)["n"]
    rank = phi * total
    found = F.array_position(F.transform(buckets, lambda b: b["n"] >= rank), True).cast("int") - 1
    at = F.when(found < 0, last).otherwise(F.least(found, last))
    here = F.get(buckets, at)
    before = F.get(buckets, F.greatest(at - 1, F.lit(0)))
    first = at == 0
    low = F.when(first, 0.0).otherwise(before["le"])
    below = F.when(first, 0.0).otherwise(before["n"])
    inside = low + (here["le"] - low) * F.try_divide(rank - below, here["n"] - below)
    return (
        F.when((F.get(buckets, last)["le"] != INF) | (last < 1) | (total == 0) | F.isnan(total), NAN)
        .when(F.isnan(phi), NAN)
        .when(phi < 0, -INF)
        .when(phi > 1, INF)
        .when(at == last, F.get(buckets, last - 1)["le"])
        .when(first & (here["le"] <= 0), here["le"])
        .otherwise(inside)
    )


def histogram_quantile(vector: DataFrame, phi: Column) -> DataFrame:
    """One value for each label set without le; series without a readable le are left out."""
    with_le = vector.withColumn("le_text", label(F.col("labels"), "le"))
    with_le = with_le.withColumn("le", _upper(F.col("le_text"))).where("le IS NOT NULL")
    rest = with_labels(with_le, drop_labels(F.col("labels"), NAME, "le"))
    same = rest.groupBy("labels_key", "step_ms", "le").agg(F.sum("value").alias("n"), F.any_value("labels").alias("labels"))
    grouped = same.groupBy("labels_key", "step_ms").agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("buckets"), F.any_value("labels").alias("labels"))
    # counts can fall a little between scrapes of different buckets: each is at least the one before
    return grouped.select("labels", "labels_key", "step_ms", _interpolated(phi, _monotonic(F.col("buckets"))).alias("value"))


def _monotonic(buckets: Column) -> Column:
    return F.transform(buckets, lambda b, i: F.struct(b["le"].alias("le"), F.array_max(F.transform(F.slice(buckets, 1, i + 1), lambda x: x["n"])).alias("n")))
