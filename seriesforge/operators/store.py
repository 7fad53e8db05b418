"""Selection of series and samples: tenants, virtual labels, limits, and the source of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DAY_MS, RAW_PARTITION_DAYS, ROLLUP_MS, QueryContext, QueryError, Store
from ..plans.matchers import Matcher, all_of
from . import rollup as R
from .dedup import dedup_samples, hot_over_cold
from .mutable import NoValues


def effective_matchers(store: Store, matchers, context: QueryContext) -> list[Matcher] | None:
    """The query's matchers with the request's; None if they stand for nothing."""
    out = [*context.forced_matchers, *matchers]
    if context.tenant_required and not context.tenant:
        raise QueryError("a tenant is required")
    if context.tenant:
        out.insert(0, Matcher(context.tenant_label, "=", context.tenant))
    if store.mutable is not None:
        tenant = next((m.value for m in out if m.name == context.tenant_label and m.op == "="), None)
        try:
            out = store.mutable.rewrite(out, tenant)
        except NoValues:
            return None
    return out


class Budget:
    """What a query may still evaluate: all its selectors together count against the limits (0: no limit, nothing is counted)."""

    def __init__(self, context: QueryContext):
        self.left = {"series": context.max_series or None, "points": context.max_points or None}

    def spend(self, kind: str, rows: DataFrame) -> None:
        left = self.left[kind]
        if left is None:
            return
        self.left[kind] = left - rows.limit(left + 1).count()
        if self.left[kind] < 0:
            raise QueryError(f"too many {kind} evaluated")


def select_series(store: Store, matchers, context: QueryContext, budget: Budget | None = None) -> DataFrame:
    """The series that match, within the limit on series."""
    found = effective_matchers(store, matchers, context)
    chosen = store.series.where(all_of(found) if found is not None else F.lit(False))
    (budget or Budget(context)).spend("series", chosen)
    return chosen


def uses_rollup(store: Store, step_ms: int, context: QueryContext) -> bool:
    if store.rollup is None or context.force_raw:
        return False
    return context.force_rollup or step_ms >= ROLLUP_MS


def within(samples: DataFrame, low_ms: int, high_ms: int, column: str = "ts_ms") -> DataFrame:
    """Samples in (low, high]; the partition column, if there is one, is filtered by the same range."""
    out = samples.where((F.col(column) > low_ms) & (F.col(column) <= high_ms))
    if "base_day5" in samples.columns:
        width = RAW_PARTITION_DAYS * DAY_MS
        out = out.where(F.col("base_day5").between(low_ms // width * width, high_ms // width * width))
    return out


def raw_samples(store: Store, low_ms: int, high_ms: int) -> DataFrame:
    columns = ["series_id", "ts_ms", "value", "is_stale"]
    if "point" in store.samples.columns and (store.hot is None or "point" in store.hot.columns):
        columns.append("point")
    cold = within(store.samples, low_ms, high_ms).select(*columns)
    if not store.merged:
        cold = dedup_samples(cold)
    if store.hot is None:
        return cold
    # the first hot sample of a series cuts its cold ones, wherever the range begins
    cut = hot_over_cold(cold, dedup_samples(store.hot, "seq" if "seq" in store.hot.columns else None))
    return within(cut, low_ms, high_ms)


def read_samples(store: Store, low_ms: int, high_ms: int, function: str, step_ms: int, context: QueryContext) -> DataFrame:
    """Raw samples, or the rollup column of the function with newer raw samples rolled up behind it."""
    if not uses_rollup(store, step_ms, context):
        return raw_samples(store, low_ms, high_ms)
    until = store.rollup_until_ms
    if until is None:
        last = store.rollup.agg(F.max("bucket_ms")).first()[0]
        until = 0 if last is None else last + ROLLUP_MS
    old = within(store.rollup, low_ms, high_ms, "bucket_ms").where(F.col("bucket_ms") < until)
    low_aligned = max(until, low_ms - low_ms % ROLLUP_MS) - 1
    high_aligned = high_ms - high_ms % ROLLUP_MS + ROLLUP_MS - 1  # the whole of the last bucket, as a rollup has it
    new = R.rollup(raw_samples(store, low_aligned, high_aligned)) if high_ms >= until else None
    both = old.select("series_id", "bucket_ms", "min", "max", "avg", "cnt")
    both = both if new is None else both.unionByName(new.where(F.col("bucket_ms") > low_ms))
    return R.as_samples(both, function)


def selected_points(points: DataFrame, series: DataFrame, budget: Budget) -> DataFrame:
    """The samples of the selected series, within the limit on points."""
    out = points.join(series.select("series_id"), "series_id", "left_semi")
    budget.spend("points", out)
    return out
