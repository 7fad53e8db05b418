import random
import re

import pytest
from helpers import T0, at, over, store

from seriesforge.engine import Engine
from seriesforge.model import QueryContext, QueryError, Store
from seriesforge.operators.store import select_series
from seriesforge.plans.parser import parse

NAMES, SITES, FLOORS = ("pump_flow", "pump_heat", "door"), ("east", "west", "eastern", ""), ("", "1", "10", "2")
LABELS = [{"__name__": n, **({"site": s} if s else {}), **({"floor": f} if f else {})} for n in NAMES for s in SITES for f in FLOORS]
PATTERNS = ("east", "east.*", "east|west", "(e|w)est", ".*", ".+", "", "^$", "^west$", "|east", r"ea\\wt(ern)?", "[ew].st", "1|2", "1.?", r"\\d\\d")


@pytest.fixture(scope="module")
def small(spark):
    return store(spark, *((labels, [(T0, 1)]) for labels in LABELS))


def holds(labels, name, op, value):
    """A matcher by its definition: a missing label is empty, patterns are anchored."""
    have = labels.get(name, "")
    if op in ("=", "!="):
        return (have == value) == (op == "=")
    return bool(re.fullmatch(value.replace("\\\\", "\\"), have)) == (op == "=~")


@pytest.mark.parametrize("seed", range(30))
def test_matchers(small, seed):
    rng = random.Random(seed)
    asked = [("__name__", rng.choice(("=", "=~")), rng.choice(NAMES))]
    for name in rng.sample(("site", "floor"), rng.randrange(1, 3)):
        op = rng.choice(("=", "!=", "=~", "!~"))
        asked.append((name, op, rng.choice((SITES, FLOORS)[name == "floor"] if op in ("=", "!=") else PATTERNS)))
    text = "{" + ",".join(f'{n}{o}"{v}"' for n, o, v in asked) + "}"
    want = {i for i, labels in enumerate(LABELS, 1) if all(holds(labels, *m) for m in asked)}
    got = select_series(small, parse(text).matchers, QueryContext()).collect()
    assert {r["series_id"] for r in got} == want, text


def test_no_matchers_select_nothing(small):
    assert select_series(small, (), QueryContext()).count() == 0


def test_anchored_to_the_very_end(spark):
    s = store(spark, ({"__name__": "m", "a": "x\n"}, [(T0, 1)]), ({"__name__": "m", "a": "x"}, [(T0, 2)]))
    assert list(at(s, 'm{a=~"[x]"}').values()) == [2.0]
    assert sorted(at(s, 'm{a=~"[x].?"}').values()) == [1.0, 2.0]


def test_lookback_is_left_open_and_stale_ends(spark):
    s = store(
        spark,
        ({"__name__": "m", "i": "edge"}, [(T0 - 300_000, 1)]),
        ({"__name__": "m", "i": "inside"}, [(T0 - 299_999, 2)]),
        ({"__name__": "m", "i": "stale"}, [(T0 - 2000, 3), (T0 - 1000, float("nan"), True)]),
        ({"__name__": "m", "i": "later"}, [(T0 + 1, 4)]),
        ({"__name__": "m", "i": "nan"}, [(T0, float("nan"))]),
    )
    got = at(s, "m")
    assert set(got) == {'__name__="m",i="inside"', '__name__="m",i="nan"'}
    assert at(s, "count_over_time(m[5m])") == {'i="inside"': 1.0, 'i="stale"': 1.0, 'i="nan"': 1.0}


def test_two_series(spark):
    s = store(spark, ({"__name__": "m", "a": "1"}, [(T0, 10)]), ({"__name__": "m", "a": "2"}, [(T0 - 60_000, 9)]))
    assert at(s, "m") == {'__name__="m",a="1"': 10.0, '__name__="m",a="2"': 9.0}
    assert at(s, "sum(m)") == {"": 19.0}


def test_offset_and_at(spark):
    s = store(spark, ({"__name__": "m"}, [(T0 + k * 60_000, k) for k in range(-10, 11)]))
    assert at(s, "m offset 5m") == {'__name__="m"': -5.0}
    assert at(s, "m offset -5m") == {'__name__="m"': 5.0}
    assert at(s, f"m @ {(T0 + 120_000) / 1000}") == {'__name__="m"': 2.0}
    got = over(s, "m @ end()", T0, T0 + 180_000, 60_000)
    assert len(got) == 4 and set(got.values()) == {3.0}
    assert list(over(s, "m", T0, T0 + 180_000, 60_000).values()).count(2.0) == 1


def test_tenant_forced_and_limits(spark):
    rows = [({"__name__": n, "__account_id": t, "mountpath": m}, [(T0 - k * 1000, k) for k in range(100)]) for n, t, m in (("disk_used", "1234", "/home"), ("disk_used", "5678", "/home"), ("disk_free", "5678", "/srv"))]
    s = store(spark, *rows)
    assert len(at(s, "disk_used")) == 2 and len(at(s, '{__name__=~"disk_.*"}')) == 3
    assert len(at(s, '{__name__=~"disk_.*"}', tenant="1234")) == 1
    forced = QueryContext.from_headers({"X-Any-Forced-Matcher": '__account_id="1234"'})
    assert Engine(s, forced).query('{__name__=~"disk_.*"}', T0).count() == 1
    with pytest.raises(QueryError):
        at(s, '{__name__=~"disk_.*"}', max_series=2)
    assert len(at(s, '{__name__=~"disk_.*"}', max_series=3)) == 3
    with pytest.raises(QueryError):
        at(s, "count_over_time(disk_used[1h])", max_points=199)
    assert len(at(s, "count_over_time(disk_used[1h])", max_points=200)) == 2
    with pytest.raises(QueryError):  # all selectors together
        at(s, "disk_used + on(__account_id) disk_free", max_series=2)
    with pytest.raises(QueryError):
        at(s, "sum(count_over_time(disk_used[1h])) + sum(count_over_time(disk_free[1h]))", max_points=299)
    assert at(s, "sum(count_over_time(disk_used[1h])) + sum(count_over_time(disk_free[1h]))", max_points=300) == {"": 300.0}
    with pytest.raises(QueryError):
        at(s, "disk_used", tenant_required=True)
    with pytest.raises(QueryError):
        QueryContext.from_headers({"Max-Evaluated-Series": "x"})


def test_hot_cuts_cold(spark):
    cold = [(1, k * 10_000, float(k), False) for k in range(5)] + [(2, 0, 7.0, False)]
    hot = [(1, 30_000, 100.0, False), (1, 50_000, 101.0, False)]
    schema = "series_id long, ts_ms long, value double, is_stale boolean"
    base = store(spark, ({"__name__": "m", "a": "1"}, [(0, 0)]), ({"__name__": "m", "a": "2"}, [(0, 0)]))
    cold += [(1, 10_000, float("nan"), False), (2, 0, 6.0, False)]  # stored again
    s = Store(series=base.series, samples=spark.createDataFrame(cold, schema), hot=spark.createDataFrame(hot, schema))
    assert at(s, "sum_over_time(m[1h])", 60_000) == {'a="1"': 0.0 + 1 + 2 + 100 + 101, 'a="2"': 7.0}
