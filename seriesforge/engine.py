"""The query API: instant and range queries, catalog lookups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import NAME, Grid, QueryContext, QueryError, Store
from .operators import catalog
from .operators.store import Budget, effective_matchers, raw_samples, select_series, selected_points
from .plans.evaluator import Evaluator
from .plans.matchers import Matcher
from .plans.parser import parse

#: Ranges outside these years are cut: 1971 to 3000.
EARLIEST_MS, LATEST_MS = 31_536_000_000, 32_503_680_000_000
MOST_STEPS = 11_000_000


class Engine:
    """Runs PromQL over a store. Results are vectors (labels, labels_key, step_ms, value)."""

    def __init__(self, store: Store, context: QueryContext = QueryContext()):
        self.store, self.context = store, context

    def with_context(self, **changes) -> Engine:
        return Engine(self.store, replace(self.context, **changes))

    def query(self, promql: str, time_ms: int) -> DataFrame:
        """The value of an expression at one time."""
        return self._run(promql, Grid(time_ms, time_ms))

    def query_range(self, promql: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        """The values at start, start + step, ... up to end."""
        start_ms, end_ms = clamp_range(start_ms, end_ms)
        if step_ms <= 0 or end_ms < start_ms:
            raise QueryError("a range query needs a step above zero and an end at or after its start")
        if (end_ms - start_ms) // step_ms >= MOST_STEPS:
            raise QueryError("too many steps")
        return self._run(promql, Grid(start_ms, end_ms, step_ms))

    def _run(self, promql: str, grid: Grid) -> DataFrame:
        out = Evaluator(self.store, grid, self.context).result(parse(promql))
        if self.store.mutable is not None and self.context.tenant:
            out = self.store.mutable.decorate(out, self.context.tenant).select("labels", "labels_key", "step_ms", "value")
        return out

    # -- catalog

    def series(self, selectors: list[str], start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """Series that some selector matches and that have a sample in the range."""
        found = self._selected(selectors, Budget(self.context))
        return catalog.with_samples(found, self.store.samples, start_ms, end_ms)

    def _selected(self, selectors: list[str], budget: Budget) -> DataFrame:
        found = None
        for text in selectors:
            part = select_series(self.store, parse(text).matchers, self.context, budget)
            found = part if found is None else found.unionByName(part)
        return found.dropDuplicates(["series_id"])

    def read(self, selectors: list[str], start_ms: int, end_ms: int) -> DataFrame:
        """(labels, labels_key, series_id, ts_ms, value, is_stale): the raw samples of the selected series from start to end, both included."""
        budget = Budget(self.context)
        series = self._selected(selectors, budget)
        points = selected_points(raw_samples(self.store, start_ms - 1, end_ms), series, budget)
        return points.join(series.select("series_id", "labels", "labels_key"), "series_id").select("labels", "labels_key", "series_id", "ts_ms", "value", "is_stale")

    def _matching(self, matchers: list[Matcher] | None) -> DataFrame:
        own = matchers or []
        if not own and not self.context.forced_matchers and not self.context.tenant:
            return self.store.series
        found = effective_matchers(self.store, own, self.context)
        from .plans.matchers import all_of

        return self.store.series.where(all_of(found) if found is not None else F.lit(False))

    def label_values(self, name: str, matchers: list[Matcher] | None = None) -> DataFrame:
        mutable, tenant = self.store.mutable, self.context.tenant
        if mutable is not None and tenant and name in mutable.name_map(tenant):
            return mutable.values.where((F.col("tenant") == tenant) & (F.col("name") == name)).select("value").distinct().orderBy("value")
        return catalog.label_values(self._matching(matchers), name)

    def label_names(self, matchers: list[Matcher] | None = None) -> DataFrame:
        names = catalog.label_names(self._matching(matchers))
        mutable, tenant = self.store.mutable, self.context.tenant
        if mutable is not None and tenant:
            names = names.unionByName(mutable.names.where(F.col("tenant") == tenant).select("name")).distinct().orderBy("name")
        return names


def clamp_range(start_ms: int, end_ms: int) -> tuple[int, int]:
    return min(max(start_ms, EARLIEST_MS), LATEST_MS), min(max(end_ms, EARLIEST_MS), LATEST_MS)


__all__ = ["NAME", "Engine", "clamp_range"]
