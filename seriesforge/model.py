"""Schemas and label helpers that every part of the engine shares.

* series:  series_id, labels (map), labels_key (canonical text of the labels)
* samples: series_id, ts_ms, value, is_stale
* vector:  labels, labels_key, step_ms, value
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = "__name__"
TENANT = "__account_id"
ROLLUP_MS = 300_000
LOOKBACK_MS = 300_000
RAW_PARTITION_DAYS, ROLLUP_PARTITION_DAYS = 5, 80
DAY_MS = 86_400_000
MAX_SAMPLES = 50_000_000
#: Request headers, after the product prefix.
HEADERS = ("Forced-Matcher", "Max-Evaluated-Series", "Max-Evaluated-Points", "ForcePreAggregated", "ForceRaw", "Tenant", "TTL")

LABELS = T.MapType(T.StringType(), T.StringType())
SERIES = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("labels", LABELS)])
SAMPLES = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("ts_ms", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("is_stale", T.BooleanType())])

NAN, INF = float("nan"), float("inf")


class QueryError(ValueError):
    """A query, a label or a request that the engine must refuse."""


def labels_key(labels: Column) -> Column:
    """``name="value",...`` sorted by name, empty values left out; equal for equal label sets."""
    entries = F.array_sort(F.map_entries(labels))
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    full = F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(full, lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")


def label(labels: Column, name: str) -> Column:
    """A label's value; a missing label is the empty string."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def drop_labels(labels: Column, *names: str) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names))


def keep_labels(labels: Column, *names: str) -> Column:
    if not names:
        return F.create_map().cast(LABELS)
    return F.map_filter(labels, lambda k, v: k.isin(*names) & (v != ""))


def with_labels(df: DataFrame, labels: Column) -> DataFrame:
    """df with other labels and the key that belongs to them."""
    return df.withColumn("labels", labels).withColumn("labels_key", labels_key(F.col("labels")))


def as_series(df: DataFrame) -> DataFrame:
    """Adds the labels_key to (series_id, labels)."""
    return df if "labels_key" in df.columns else df.withColumn("labels_key", labels_key(F.col("labels")))


@dataclass(frozen=True)
class QueryContext:
    """What a request can set besides its query; 0 means without limit."""

    forced_matchers: tuple = ()
    tenant: str | None = None
    tenant_required: bool = False
    tenant_label: str = TENANT
    max_series: int = 0
    max_points: int = 0
    force_rollup: bool = False
    force_raw: bool = False
    lookback_ms: int = LOOKBACK_MS

    @classmethod
    def from_headers(cls, headers: dict[str, str], tenant_required: bool = False) -> QueryContext:
        """From the request headers of the HTTP surface; bad numbers are refused."""
        from .plans.matchers import parse_matcher

        got = {name: v for k, v in headers.items() for name in HEADERS if k == name or k.endswith(f"-{name}")}
        number = lambda k: cls._number(got.get(k, "0"), k)
        forced = tuple(parse_matcher(m) for m in [got["Forced-Matcher"]] if m) if "Forced-Matcher" in got else ()
        return cls(
            forced_matchers=forced,
            tenant=got.get("Tenant"),
            tenant_required=tenant_required,
            max_series=number("Max-Evaluated-Series"),
            max_points=number("Max-Evaluated-Points"),
            force_rollup=cls._flag(got.get("ForcePreAggregated", "")),
            force_raw=cls._flag(got.get("ForceRaw", "")),
        )

    @staticmethod
    def _number(text: str, name: str) -> int:
        try:
            return int(text)
        except ValueError as e:
            raise QueryError(f"{name} isn't a number: {text!r}") from e

    @staticmethod
    def _flag(text: str) -> bool:
        if text.lower() not in ("", "true", "false", "1", "0"):
            raise QueryError(f"not a boolean: {text!r}")
        return text.lower() in ("true", "1")


@dataclass(frozen=True)
class Grid:
    """The evaluation times of a query: start, start + step, ... up to end."""

    start_ms: int
    end_ms: int
    step_ms: int = 1

    @property
    def count(self) -> int:
        return (self.end_ms - self.start_ms) // self.step_ms + 1

    @property
    def last_ms(self) -> int:
        return self.start_ms + (self.count - 1) * self.step_ms


@dataclass
class Store:
    """The tables that a query reads. Rollup and hot samples are optional.

    Samples (hot ones too) may have a column ``point`` that tells different samples of a series at one time apart;
    reads then merge repeated samples of one point only.
    """

    series: DataFrame
    samples: DataFrame
    rollup: DataFrame | None = None
    hot: DataFrame | None = None
    rollup_until_ms: int | None = None
    mutable: object | None = None
    options: dict = field(default_factory=dict)
    #: Samples have one row for each series and time already; otherwise reads merge repeated ones.
    merged: bool = False

    def __post_init__(self):
        self.series = as_series(self.series)
