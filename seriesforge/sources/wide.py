"""Wide tables: a timestamp column and a column of values for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import QueryError, labels_key
from ..plans.parser import parse

#: What happens to NaN values: keep them, drop stale ones, drop ordinary ones, or turn ordinary ones to stale.
NAN_POLICIES = ("keep", "drop_stale", "drop_nan", "drop_all", "to_stale")


def apply_nan_policy(samples: DataFrame, policy: str = "keep") -> DataFrame:
    stale, nan = F.col("is_stale"), F.isnan("value") & ~F.col("is_stale")
    match policy:
        case "keep":
            return samples
        case "drop_stale":
            return samples.where(~stale)
        case "drop_nan":
            return samples.where(~nan)
        case "drop_all":
            return samples.where(~F.isnan("value"))
        case "to_stale":
            return samples.withColumn("is_stale", stale | F.isnan("value"))
    raise QueryError(f"unknown policy {policy!r}")


def to_wide(samples: DataFrame, series: DataFrame, policy: str = "keep", columns: list[str] | None = None, repeats: bool = False) -> DataFrame:
    """timestamp and ``{labels}`` columns. The columns' names come from the catalog, so pivoting needs no extra pass over samples.

    Of the samples of a series at one time the largest counts, NaN as the largest of all, as SQL's max has it.
    With ``repeats`` none is left out: further samples of a series at one time lie in further rows of that time.
    """
    names = columns or [r[0] for r in series.select("labels_key").distinct().orderBy("labels_key").collect()]
    named = apply_nan_policy(samples, policy).join(series.select("series_id", "labels_key"), "series_id")
    by = [F.col("ts_ms").alias("timestamp")]
    if repeats:  # dealt by time, as the window and both aggregations of the pivot then need no other shuffle
        named = named.repartition("ts_ms").withColumn("repeat", F.row_number().over(W.partitionBy("ts_ms", "labels_key").orderBy("value")))
        by.append(F.col("repeat"))
    wide = named.groupBy(*by).pivot("labels_key", names).agg(F.max("value"))
    return wide.select("timestamp", *(F.col(f"`{n.replace('`', '``')}`").alias("{" + n + "}") for n in names))


def column_labels(name: str) -> dict[str, str]:
    """The labels of a column: a selector of equality matchers."""
    tree = parse(name)
    if any(m.op != "=" for m in tree.matchers):
        raise QueryError(f"not a label set: {name!r}")
    return {m.name: m.value for m in tree.matchers if m.value}


def from_wide(wide: DataFrame, start_ms: int | None = None, end_ms: int | None = None, policy: str = "keep") -> DataFrame:
    """labels, labels_key, ts_ms, value, is_stale. Values must be doubles; nulls are absent samples."""
    values = [f for f in wide.schema.fields if f.name != "timestamp"]
    for f in values:
        if f.dataType.simpleString() != "double":
            raise QueryError(f"column {f.name!r} isn't double")
    rows = wide
    if start_ms is not None:
        rows = rows.where(F.col("timestamp") >= start_ms)
    if end_ms is not None:
        rows = rows.where(F.col("timestamp") <= end_ms)
    labels = [column_labels(f.name) for f in values]
    quoted = [f"`{f.name.replace('`', '``')}`" for f in values]
    numbered = ", ".join(f"{i}, {q}" for i, q in enumerate(quoted))
    long = rows.selectExpr("timestamp AS ts_ms", f"stack({len(values)}, {numbered}) AS (column, value)").where("value IS NOT NULL")
    # a table of the columns' labels, as a plan with a literal map for each column would outgrow the compiler
    named = wide.sparkSession.createDataFrame(list(enumerate(labels)), "column int, labels map<string,string>")
    out = long.join(named, "column").select("labels", "ts_ms", "value", F.lit(False).alias("is_stale"))
    return apply_nan_policy(out.withColumn("labels_key", labels_key(F.col("labels"))), policy)


