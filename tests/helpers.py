"""Small stores and results for the tests."""

from seriesforge.engine import Engine
from seriesforge.model import SAMPLES, SERIES, QueryContext, Store

T0 = 1_700_000_000_000


def store(spark, *series, **more):
    """Each series: (labels, [(ts_ms, value) or (ts_ms, value, stale)])."""
    rows = [(i, labels) for i, (labels, _) in enumerate(series, 1)]
    samples = [(i, p[0], float(p[1]), len(p) > 2) for i, (_, points) in enumerate(series, 1) for p in points]
    return Store(series=spark.createDataFrame(rows, SERIES), samples=spark.createDataFrame(samples, SAMPLES), **more)


def at(store, promql, time_ms=T0, **context):
    """{labels_key: value} of an instant query."""
    got = Engine(store, QueryContext(**context)).query(promql, time_ms).collect()
    out = {r["labels_key"]: r["value"] for r in got}
    assert len(out) == len(got), "duplicate labels in a result"
    return out


def over(store, promql, start, end, step, **context):
    got = Engine(store, QueryContext(**context)).query_range(promql, start, end, step).collect()
    return {(r["labels_key"], r["step_ms"]): r["value"] for r in got}
