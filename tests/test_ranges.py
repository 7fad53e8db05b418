import math
import statistics
import time

import pytest
from helpers import T0, at, over, store

from seriesforge.model import QueryError, Store


def counter(spark, points, name="request_total"):
    return store(spark, ({"__name__": name}, [(T0 + round(s * 1000), v) for s, v in points]))


FIRST = [(-50, 0), (-40, 200), (-30, 400), (-20, 600), (-10, 800), (0, 1000)]


@pytest.mark.parametrize(("query", "points", "when", "value"), [
    ("rate(request_total[1m])", FIRST, 0, 16.66666),
    ("rate(request_total[2m])", [(-70, 500), (-60, 510), (-50, 520), (-40, 530), (-30, 540)], 0, 0.41666),
    ("rate(request_total[1m])", [(-49.877, 0), (-39.877, 200), (-29.876, 400), (-19.878, 600), (-9.877, 800), (0.123, 1000)], 0.257, 16.711),
    ("rate(request_total[1m])", [(-50, 0), (-40, 207), (-30, 410), (-20, 580), (-10, 800), (0, 1000)], 0, 16.6666),
    ("rate(request_total[1m])", [(-50, 0), (-40, 207), (-30, 410), (-20, 580), (-10, 800)], 0, 16.666),
    ("rate(request_total[1m])", [(-55.488, 2524386), (-45.488, 2525197), (-35.488, 2525945), (-25.488, 2526637), (-15.488, 2527391)], 0, 61.99315),
    ("rate(request_total[1m])", [(-55.488, 2524386), (-45.488, 2525197), (-35.488, 2525945), (-25.488, 2526637), (-15.488, 2527391), (-5.488, 2528114)], 0, 74.56),
])
def test_worked_rates(spark, query, points, when, value):
    got = at(counter(spark, points), query, T0 + round(when * 1000))
    assert list(got) == [""] and math.isclose(got[""], value, rel_tol=1e-3)


def test_reset_and_zero_cut(spark):
    s = counter(spark, [(-40, 90), (-30, 100), (-20, 5), (-10, 15)])
    # gained 100 - 90 + 5 + 10 = 25 over 30 s; 20 s (over 1.1 * 10) before the first become 5 s, 10 s after the last stay
    assert math.isclose(at(s, "increase(request_total[1m])")[""], 25 * 45 / 30)
    assert at(s, "resets(request_total[1m])")[""] == 1.0
    assert at(s, "changes(request_total[1m])")[""] == 3.0
    assert math.isclose(at(s, "delta(request_total[1m])")[""], -75 * 45 / 30)


def test_left_open_pairs(spark):
    s = counter(spark, [(-60, 10), (-30, 4), (0, 6)])
    assert at(s, "resets(request_total[1m])")[""] == 0.0  # the pair's first sample is at the open end
    assert at(s, "count_over_time(request_total[1m])")[""] == 2.0


def test_instant_rates(spark):
    s = counter(spark, [(-20, 100), (-10, 30)])
    assert at(s, "irate(request_total[1m])")[""] == 3.0
    assert at(s, "idelta(request_total[1m])")[""] == -70.0
    assert at(s, "irate(request_total[15s])") == {}


def test_over_time(spark):
    s = counter(spark, [(-40, 1), (-30, 2), (-20, 3), (-10, 4)])
    for f, v in {"avg": 2.5, "min": 1, "max": 4, "sum": 10, "count": 4, "stdvar": 1.25, "stddev": math.sqrt(1.25), "present": 1, "mad": 1}.items():
        assert math.isclose(at(s, f"{f}_over_time(request_total[1m])")[""], v), f
    assert at(s, "last_over_time(request_total[1m])") == {'__name__="request_total"': 4.0}
    assert at(s, "quantile_over_time(0.5, request_total[1m])")[""] == 2.5
    assert at(s, "quantile_over_time(2, request_total[1m])")[""] == math.inf
    assert at(s, "quantile_over_time(-1, request_total[1m])")[""] == -math.inf
    assert math.isclose(at(s, "deriv(request_total[1m])")[""], 0.1)
    assert math.isclose(at(s, "predict_linear(request_total[1m], 60)")[""], 11.0)
    assert at(s, "rate(nothing[5m])") == {}


def test_median_distance(spark):
    s = counter(spark, [(k * 7 - 100, v) for k, v in enumerate([5, 1, 5, 9, 2, 5, 30, 1])])
    for seconds in (7, 20, 60, 200):
        inside = [v for k, v in enumerate([5, 1, 5, 9, 2, 5, 30, 1]) if k * 7 - 100 > -51 - seconds]
        distances = [abs(v - statistics.median(inside)) for v in inside]
        assert math.isclose(at(s, f"mad_over_time(request_total[{seconds}s])", T0 - 51_000)[""], statistics.median(distances)), seconds
    assert at(s, "mad_over_time(request_total[5m:1s] offset 51s)")[""] == at(s, "mad_over_time(request_total[5m:1s])", T0 - 51_000)[""]


def test_median_distance_of_long_window(spark):
    # a window's samples are neither held in one array nor gone through again for each of them
    points = spark.range(20_000).selectExpr("1L AS series_id", f"{T0}L - id AS ts_ms", "double(id * 7919 % 20011) AS value", "false AS is_stale")
    s = Store(series=counter(spark, [(0, 1)]).series, samples=points)
    values = [k * 7919 % 20011 for k in range(20_000)]
    middle = statistics.median(values)
    begin = time.monotonic()
    assert at(s, "mad_over_time(request_total[1m])")[""] == statistics.median(abs(v - middle) for v in values)
    assert time.monotonic() - begin < 60


def test_nan_rules(spark):
    s = counter(spark, [(-40, 1), (-30, math.nan), (-20, 3)])
    assert at(s, "max_over_time(request_total[1m])")[""] == 3.0
    assert at(s, "min_over_time(request_total[1m])")[""] == 1.0
    assert math.isnan(at(s, "avg_over_time(request_total[1m])")[""])


def holt(values, sf, tf):
    level, slope = values[0], values[1] - values[0]
    for x in values[1:]:
        new = sf * x + (1 - sf) * (level + slope)
        slope, level = tf * (new - level) + (1 - tf) * slope, new
    return level


def test_holt_winters(spark):
    values = [1.0, 4.0, 2.0, 8.0, 5.0]
    s = counter(spark, [(-50 + 10 * i, v) for i, v in enumerate(values)])
    assert math.isclose(at(s, "holt_winters(request_total[1m], 0.3, 0.6)")[""], holt(values, 0.3, 0.6))
    with pytest.raises(QueryError):
        at(s, "holt_winters(request_total[1m], 0, 1)")


def test_subquery(spark):
    s = counter(spark, [(k * 10 - 600, k) for k in range(61)])
    inner = over(s, "rate(request_total[1m])", T0 - 110_000 - T0 % 10_000, T0 - T0 % 10_000, 10_000)
    expected = [v for (_, t), v in inner.items() if T0 - 120_000 < t <= T0]
    assert math.isclose(at(s, "avg_over_time(rate(request_total[1m])[2m:10s])")[""], sum(expected) / len(expected))
    assert at(s, "max_over_time((time() - max(request_total) < 0)[5m:10s] offset 5m)") == {}


def test_range_query_equals_instant_queries(spark):
    s = counter(spark, [(k * 7, (k * 37) % 101) for k in range(-60, 60)])
    steps = list(range(T0 - 120_000, T0 + 120_001, 30_000))
    for q in ("rate(request_total[1m])", "avg_over_time(request_total[45s])", "request_total", "changes(request_total[2m])"):
        got = over(s, q, steps[0], steps[-1], 30_000)
        for t in steps[::4]:
            single = at(s, q, t)
            assert all(math.isclose(got[k, t], v) for k, v in single.items()), q
